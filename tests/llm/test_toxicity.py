import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from blockloom.llm import toxicity as X

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, toxic int, text string"


def corpus(n=600, seed=2):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        words = list(rng.choice(vocab, 30))
        toxic = i % 5 == 0
        if toxic:
            words[3] = rng.choice(["scum", "vermin", "scumbag"])
            words[9] = rng.choice(["scum", "vermin", "filth"])
        out.append((i, " ".join(words), toxic))
    return out


def test_learns_from_positives_and_unlabelled_alone():
    rows = corpus()
    p = [X.features(t) for _, t, y in rows[:300] if y]
    u = [X.features(t) for _, t, _ in rows[:300]]
    model = X.fit(p, u, 0.2)
    s, y = model.score([t for _, t, _ in rows[300:]]), np.array([y for *_, y in rows[300:]])
    assert ((s >= 0.7) == y).mean() > 0.97
    assert all(w >= 0 for w in model.weights.values())


def test_margins_are_sums_of_weights():
    scum, head, marks = (X.zlib.crc32(w) for w in (b"scum", b"<scum", b"!!"))
    model = X.Classifier({scum: 2.0, head: 1.0, marks: 0.5}, -1.0)
    assert model.margins(["Scum of scum", "scumbag scumbags !!", "", None, "fine"]).tolist() == [1.0, 0.5, -1.0, -1.0, -1.0]
    for text in ("Scumbag, scum: the scums !!", "été à l'école"):
        want = model.bias + sum(model.weights.get(f, 0) for f in X.features(text).tolist())
        assert model.margins([text]).tolist() == [want]


def test_near_copies_count_once():
    base = np.arange(10, 500, 10, dtype=np.uint32)
    other, empty = np.arange(7, 500, 10, dtype=np.uint32), np.empty(0, np.uint32)
    kept = X.once([base, base[1:], np.append(base, 7_000), other, empty, empty])
    assert [k.tolist() for k in kept] == [base.tolist(), other.tolist(), [], []]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = X.op3_positive_unlabelled_toxicity(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id) and out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert ((out.score >= 0.7).astype(int) == out.predicted).all()
    held = out.merge(labels, on="doc_id")
    held = held[held.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / (held.toxic == 1).sum() > 0.75 and hit / (held.predicted == 1).sum() > 0.75


def test_null_empty_repeated_and_clashing(spark):
    rows = [(i, t, "x") for i, t, _ in corpus()]
    docs = spark.createDataFrame([*rows, (None, "scum", None), (900, None, "x"), (901, "", "x"), (902, "scum vermin " * 50_000, "x"), (902, "scum vermin " * 50_000, "x")], DOCS)
    labels = spark.createDataFrame([(i, int(y), "z") for i, _, y in corpus()] + [(None, 1, None), (3, None, None), (4, 0, None), (900, 1, None)], LABELS)
    model = X.train(docs, labels)
    out = X.score(docs.withColumnRenamed("score", "old"), model, ["doc_id", "old"]).toPandas()
    assert len(out) == 605
    last = out.score.tolist()[-5:]
    assert last[1] == last[2] < 0.7 <= last[3] == last[4]
    for d, y in ((docs.limit(0), labels), (docs, labels.limit(0))):
        assert (X.score(docs, X.train(d, y), ["doc_id"]).toPandas().score < 0.7).all()
    assert X.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_a_text_that_fills_half_the_table_is_read_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "fit", lambda p, u, prior: seen.append((len(p), len(u), prior)))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "scum again").otherwise(F.concat(F.lit("w"), "id")).alias("text"))
    labels = spark.range(0, 20_000, 5).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 5).cast("int").alias("toxic"))
    X.train(docs, labels, max_positive=150, max_unlabelled=400)
    X.train(docs.unionByName(docs), labels, max_positive=10_000, max_unlabelled=100_000)
    X.train(docs, labels.withColumn("toxic", F.lit(1)), max_positive=5_000, max_unlabelled=5_000)
    assert seen[0][0] == 150 and 100 < seen[0][1] <= 400 and seen[0][2] == 0.5
    assert seen[1] == (2_000, 10_001, 0.5)
    assert seen[2][0] == 2_001 and seen[2][1] <= 5_000


def loss(P, U, w, b, prior):
    """The positive and the negative part of the risk, by loops."""
    z = lambda row: b + sum(w[j] for j in row)
    minus = lambda x: math.log1p(math.exp(-x))
    positive = prior * sum(minus(z(r)) for r in P) / len(P)
    return positive, sum(minus(-z(r)) for r in U) / len(U) - prior * sum(minus(-z(r)) for r in P) / len(P)


def test_descend_follows_the_risk_and_ascends_where_its_negative_part_is_negative():
    """Every step again by finite differences of the risk."""
    rng = np.random.default_rng(4)
    n, decay, rate = 4, 1e-3, 0.1
    P = [[0, 1], [0], [0, 2], [1]]
    U = [sorted(rng.choice(4, rng.integers(0, 3), replace=False).tolist()) for _ in range(12)]
    to_sparse = lambda rows: (np.repeat(np.arange(len(rows)), list(map(len, rows))), np.array([j for r in rows for j in r]), len(rows))
    for prior in (0.2, 0.9):
        w, b, m, v, ascents = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1), 0
        for step in range(1, 61):
            def part(x, up):
                positive, negative = loss(P, U, x[:n], x[n], prior)
                return -negative if up else positive + negative

            x = np.append(w, b)
            up = loss(P, U, w, b, prior)[1] < 0
            ascents += up
            h = 1e-6
            g = np.array([(part(x + h * e, up) - part(x - h * e, up)) / (2 * h) for e in np.eye(n + 1)])
            g[:n] += decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = np.maximum(0, x[:n]), x[n]
        got_w, got_b = X.descend(to_sparse(P), to_sparse(U), n, prior, 60, rate, decay)
        assert np.allclose(got_w, w, atol=1e-3) and abs(got_b - b) < 1e-3
        assert (ascents > 0) == (prior == 0.9)


def test_long_texts_are_read_in_parts():
    text = "Scum, " + "filler words and more " * 120_000 + " VERMIN!!"
    assert X.words(text) == set(X.TOKEN.findall(text.lower()))
