import zlib
from collections import Counter

import numpy as np

from blockloom.llm import langid as L

ROWS = "doc_id long, text string, lang string, lang_pred string"


def test_bundle_is_the_sum_of_bound_ngrams():
    space = L.Space(dim=256)
    texts = ["Où va-t-il, 12 fois?", "a", "", "!! 7", "the cat " * 40]
    got, sizes = space.bundle(texts)
    for text, v, n in zip(texts, got, sizes):
        s = L.symbols(text)
        want = np.zeros(space.dim)
        if len(s):
            s = list(s) + [0] * max(0, space.n - len(s))
            base = space.letters[space.n - 1]
            grams = Counter(tuple(s[i : i + space.n]) for i in range(len(s) - space.n + 1))
            for gram, count in grams.items():
                bound = np.sqrt(count)
                for k, letter in enumerate(gram):
                    bound = bound * np.roll(base[letter], space.n - 1 - k)
                want += bound
            want /= np.linalg.norm(want)
        assert np.allclose(v, want, atol=1e-5)
        assert (n == 0) == (not any(c.isalpha() for c in text))


def test_symbols():
    assert L.symbols("Ab  c1").tolist() == [0, 1, 2, 0, 3, 0]
    assert L.symbols("é")[1] >= 27 and L.symbols("É").tolist() == L.symbols("é").tolist()
    assert len(L.symbols("12 !?")) == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = L.op2_hyperdimensional_language(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    both = out.merge(docs, on="doc_id")
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert both.score.between(0, 1).all()


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "x") for i in range(40)]
    model = L.train(spark.createDataFrame(rows, ROWS), L.Space(dim=512))
    assert model.langs == ["de", "en"]
    assert model.predict(["the dog", "die katze"])[0] == ["en", "de"]


def test_null_empty_long_and_clashing(spark):
    space = L.Space(dim=512)
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", "x"), (3, None, "fr", "x"), (4, "un deux", None, "x")]
    model = L.train(spark.createDataFrame(rows, ROWS), space)
    assert model.langs == ["de", "en"]
    more = [(5, None, None, None), (6, "", None, None), (7, "12 !", None, None), (8, "the dog " * 50_000, None, None), (8, "the dog " * 50_000, None, None), (None, "die", "x", "y")]
    docs = spark.createDataFrame(more, ROWS).withColumnRenamed("lang_pred", "score_of")
    out = [r for r in L.identify(docs, model, ["doc_id", "score_of"]).collect()]
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "en", "de"]
    assert [r.score for r in out[:3]] == [0, 0, 0]
    none = L.train(spark.createDataFrame(rows, ROWS).limit(0), space)
    assert [r.lang_pred for r in L.identify(docs, none, ["doc_id"]).collect()] == ["und"] * 6
    assert L.identify(docs.limit(0), model, ["doc_id"]).count() == 0


def test_copies_count_once(spark):
    space = L.Space(dim=256)
    rows = [(i, "the dog", "en", "x") for i in range(500)] + [(500, "a quite other line", "en", "x"), (501, "der hund", "de", "x")]
    model = L.train(spark.createDataFrame(rows, ROWS), space)
    v, _ = space.bundle(["the dog", "a quite other line"])
    want = v.astype(float).sum(axis=0)
    assert np.allclose(model.vectors[model.langs.index("en")], want / np.linalg.norm(want), atol=1e-6)
