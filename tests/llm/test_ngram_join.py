import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import ngram_join as J

COLUMNS = "doc_id long, text string, class_id string"


def plain_sets(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else None)
    return out


def brute(ids, texts, threshold=0.8):
    """(doc_id, class_id, n_links) by comparing all pairs."""
    sets, n = plain_sets(texts), len(ids)
    where = {}
    for i, s in enumerate(sets):
        for x in s or ():
            where.setdefault(x, []).append(i)
    linked = [set() for _ in range(n)]
    for i, s in enumerate(sets):
        if s is None:
            linked[i] = {j for j in range(n) if j != i and sets[j] is None and (texts[j] or "") == (texts[i] or "")}
            continue
        for j in {j for x in s for j in where[x]} - {i}:
            both = len(s & sets[j])
            if both >= threshold * (len(s) + len(sets[j]) - both) - 1e-9:
                linked[i].add(j)
    up = J.Sets(n)
    for i in range(n):
        for j in linked[i]:
            up.join(i, j)
    roots = [up.root(i) for i in range(n)]
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, (True, 0)), (ids[i] is None, ids[i] or 0))
    return sorted((ids[i], None if least[r][0] else least[r][1], len(linked[i])) for i, r in enumerate(roots) if ids[i] is not None)


def rows(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect() if r.doc_id is not None)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    want = brute([r.doc_id for r in docs], [r.text for r in docs])
    assert sum(x[2] > 0 for x in want) > 10
    assert rows(J.op6_ngram_jaccard_join(spark, f"/root/testdata/{sf}")) == want


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    columns = ["doc_id", "class_id", "rep_id", "n_links"]
    want = sorted(con.execute(f"select {', '.join(columns)} from ({J.ORACLE_SQL})").fetchall())
    assert sorted(map(tuple, J.op6_ngram_jaccard_join(spark, d).select(columns).collect())) == want


def near_texts(n, seed=4, words=120):
    """One group of near copies, in chains as well, beside texts that share a passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    base, passage = rng.choices(vocab, k=words), rng.choices(vocab, k=60)
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(words)] = rng.choice(vocab)
        out.append(" ".join(t))
    out += [" ".join(rng.choices(vocab, k=60) + passage) for _ in range(n)]
    return out


def test_large_groups_in_blocks(spark, monkeypatch):
    texts = near_texts(150)
    ids = list(range(len(texts)))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], COLUMNS)
    want = brute(ids, texts)
    assert rows(J.jaccard_join(df, block=16)) == want
    assert rows(J.jaccard_join(df, weight=3_000)) == want
    monkeypatch.setattr(J, "KEY_BLOCKS", 0)  # every key is a crowd
    assert rows(J.jaccard_join(df, block=16)) == want


def test_one_of_each_class_is_kept(spark):
    texts = near_texts(20) + near_texts(20)
    df = spark.createDataFrame([(99 - i, t, "x") for i, t in enumerate(texts)], COLUMNS)
    out = J.jaccard_join(df).toPandas()
    assert len(out) == len(texts)
    kept = out[out.kept]
    assert sorted(kept.class_id) == sorted(set(out.class_id)) and (kept.doc_id == kept.class_id).all()


def test_null_empty_short_repeated_and_clashing(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    data = [(1, None, "a"), (2, "", "b"), (3, "!!", None), (4, "!!", "x"), (5, "one two", "x"), (6, "One, two!", "x"), (7, long, "x"), (7, long, "x"), (None, "one two", "x"), (8, "alone here", None), (9, "one two three", None)]
    df = spark.createDataFrame(data, COLUMNS)
    out = J.jaccard_join(df)
    assert rows(out) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 5, 2), (6, 5, 2), (7, 7, 1), (7, 7, 1), (8, 8, 0), (9, 9, 0)]
    assert out.where("kept").count() == 6
    assert J.jaccard_join(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x y", None), (None, "x y", None)], COLUMNS)
    assert [(r.class_id, r.n_links) for r in J.jaccard_join(nulls).collect()] == [(None, 1), (None, 1)]


def test_posterior_bounds():
    least = J.least_matches(0.8, 1e-6)
    assert all(a <= b for a, b in zip(least, least[1:])) and least[-1] < 0.8 * J.SIZE
    rng = np.random.default_rng(0)
    for n, m in zip(J.STEPS, least):
        draws = rng.beta(m, n - m + 2, 200_000) if m else np.zeros(1)  # one match fewer
        assert (draws >= 0.8).mean() < 1e-3


def test_signature_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    equal = (J.signature(np.unique(J.mix(a))) == J.signature(np.unique(J.mix(b)))).mean()
    assert abs(equal - 900 / 1100) < 0.12


def test_sizes_in_bands(spark):
    """Texts that grow word by word: similar ones lie in neighbouring bands, others further apart."""
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(5, 160)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], COLUMNS)
    assert rows(J.jaccard_join(df, block=4)) == brute(list(range(len(texts))), texts)


def test_heavy_keys_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "heavy_limit", lambda rows: 3)
    texts = near_texts(60) + ["the same text said again and again"] * 30
    ids = list(range(len(texts)))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], COLUMNS)
    assert rows(J.jaccard_join(df, block=8)) == brute(ids, texts)


def test_exact_counts_by_pairs_and_by_matrices():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(300) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 40), dtype=np.uint64)))) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) / len(set(sets[a].tolist()) | set(sets[b].tolist())) >= 0.8 for a, b in zip(i, j)]
    assert 0 < sum(want) < len(want)
    assert J.alike(sets, i, j, 0.8).tolist() == want
    assert [bool(J.alike(sets, i[k : k + 1], j[k : k + 1], 0.8)[0]) for k in range(0, len(i), 9)] == want[::9]


def test_the_filter_lets_every_wanted_row_pass(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    wanted = rows.where("id % 50 = 0")
    for bits, most in ((1 << 27, 800), (1 << 12, 3_000), (64, 20_000)):
        out = [r.id for r in J.may_have(rows, wanted, "h", bits).collect()]
        assert {i for i in range(0, 20_000, 50)} <= set(out) and len(out) == len(set(out)) <= most
    assert J.may_have(rows, wanted.limit(0), "h").count() == 0


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(J, "heavy_limit", lambda rows: 3)
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    pairs = [((b, a) if rng.random() < 0.5 else (a, b)) for a, b in pairs if a != b] * 2
    up = J.Sets(400)
    for a, b in pairs:
        up.join(a, b)
    want = sorted((x << 33, up.root(x) << 33) for x in {x for p in pairs for x in p})
    edges = spark.createDataFrame([(a << 33, b << 33) for a, b in pairs], "a long, b long").repartition(5)
    found = lambda few, e: monkeypatch.setattr(J, "FEW_EDGES", few) or sorted(map(tuple, J.components(e, "test").select("tag", "root").collect()))
    assert found(J.FEW_EDGES, edges) == found(0, edges) == want
    assert found(10, edges.limit(0)) == found(-1, edges.limit(0)) == []


def test_few_edges_take_one_table(spark, monkeypatch):
    """Each table is a job and starts processes; chains of near copies took two tables for each round of stars."""
    texts = near_texts(40)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], COLUMNS)
    tables = []
    real = J.written
    monkeypatch.setattr(J, "written", lambda df, label: tables.append(label) or real(df, label))
    want = brute(list(range(len(texts))), texts)
    assert rows(J.jaccard_join(df)) == want
    assert sorted(tables) == sorted(set(tables))
    monkeypatch.setattr(J, "FEW_EDGES", 0)
    assert rows(J.jaccard_join(df)) == want


def test_bands_are_planned_only_for_components_of_many_blocks(spark):
    wanted = spark.range(60).select(F.col("id").alias("tag"), (F.col("id") % 3).alias("root"), F.lit(1).alias("copies"), (F.col("id") + 5).alias("size"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    one, cut = J.placed(wanted, 0.8, 1_024, 2_000_000), J.placed(wanted, 0.8, 4, 2_000_000)
    assert "Union" not in plan(one) and "Union" in plan(cut)
    assert sorted(map(tuple, one.select("root", "side", "tag", "copies").collect())) == sorted((i % 3, 0, i, 1) for i in range(60))
    assert {r.tag for r in cut.collect()} == set(range(60))
