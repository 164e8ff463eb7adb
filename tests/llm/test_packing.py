import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece: the sorted fill of all bins."""
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= x]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= x
        else:
            left.append(capacity - x)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_runs_place_as_one_by_one(lengths):
    hist = {x: lengths.count(x) for x in set(lengths)}
    runs, n = P.best_fit_decreasing(hist, 40)
    used, seen = {}, {x: 0 for x in hist}
    for length, a, b, first, per, offset in runs:
        assert seen[length] == a
        seen[length] = b
        for r in range(a, b):
            cells = used.setdefault(first + (r - a) // per, set())
            at = offset + (r - a) % per * length
            new = set(range(at, at + length))
            assert not cells & new and max(new) < 40
            cells |= new
    assert seen == hist and sorted(used) == list(range(n))
    assert all(c == set(range(len(c))) for c in used.values())
    assert sorted(40 - len(c) for c in used.values()) == one_by_one(lengths, 40)


def test_capacity_tree():
    t, have = P.CapacityTree(2048), set()
    rng = random.Random(3)
    for _ in range(3000):
        c = rng.randrange(2049)
        if c in have:
            have.remove(c)
            t.add(c, -1)
        else:
            have.add(c)
            t.add(c, 1)
        least = rng.randrange(2049)
        assert t.tightest(least) == min((x for x in have if x >= least), default=None)


def test_word_tokenizer_equals_the_library(spark, sf):
    lib, own = Tokenizer.from_file(PATH), P.WordTokenizer(PATH, max_words=500)
    rng = random.Random(5)
    odd = ["", " ", "don't 'S 'start ''s _a_b 1a2 x's'll", "<|endoftext|> a", "é   x", "İ ŉ ĸ ſ ß × ÷ µ ²", "日本 語", "a\x85b\x1cc", "퟿\U0001f600"]
    chars = [c for c in map(chr, range(9, 0x180))]
    odd += ["".join(rng.choice(chars) for _ in range(40)) for _ in range(300)]
    odd += ["".join(rng.choice("ab'stm re_-.1 É\n") for _ in range(40)) for _ in range(300)]
    odd += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text in odd:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_whole_table(spark, sf):
    lib = Tokenizer.from_file(PATH)
    out = P.op10_best_fit_packing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    want = []
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)
    assert sorted(got) == sorted(want)
    for _, bin_ in out.sort_values("offset").groupby("sequence_id"):
        ends = (bin_.offset + bin_.length).tolist()
        assert bin_.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    assert out.sequence_id.nunique() == len(one_by_one(out.length.tolist(), 2048))


def test_null_empty_repeated_and_clashing(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "hello " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = P.pack_documents(df, PATH, with_ids=True).toPandas()
    assert len(out) == 5 and out.length.sum() == 3 + 3001 and (out.ids.map(len) == 4 * out.length).all()
    assert P.pack_documents(df.limit(0), PATH).count() == 0
    again = P.pack(spark.createDataFrame([("x", 3, "q")] * 4, "id string, length int, offset string"), 7).toPandas()
    assert sorted(zip(again.sequence_id, again.offset)) == [(0, 0), (0, 3), (1, 0), (1, 3)]
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([("x", 9)], "id string, length int"), 7)
