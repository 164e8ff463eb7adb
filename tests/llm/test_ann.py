import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from blockloom.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(ids, v, every, k):
    out = {}
    for q, x in zip(ids, v):
        if q % every == 0 and q not in out:
            score = A.cosines(v, np.broadcast_to(x, v.shape))
            order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
            out[q] = [(ids[i], score[i]) for i in order]
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in want[q]} & set(part.vec_id)) for q, part in got.groupby("query_id"))
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got, want = A.op1_adaptive_dimension_scan(spark, d).toPandas(), brute(ids, v, 50, 5)
    assert set(got.query_id) == set(want)
    assert recall(got, want) >= 0.9
    for q, part in got.sort_values("rank").groupby("query_id"):
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) == [1, 2, 3, 4, 5]
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))
        at = {i: n for n, i in enumerate(ids)}
        x, y = v[[at[i] for i in part.vec_id]], v[[at[q]]]
        assert part.score.tolist() == A.cosines(x, y).tolist()


def test_ties_repeated_and_unusable(spark):
    hot = [0.6, 0.8, 0.0]
    rows = [(i, hot, None, "x") for i in range(1, 400)] + [(i, hot, None, "x") for i in (7, 7)]
    rows += [(1000, [0.5, 0.5, 0.1], None, None), (1050, [0.0, 0.0, 0.0], None, None), (1100, None, None, None)]
    rows += [(1150, [1.0, None, 0.0], None, None), (1200, [1.0, float("nan"), 0.0], None, None), (1250, [1.0], None, None)]
    rows += [(1300, [1.0, float("inf"), 0.0], None, None), (None, hot, None, None), (1350, [], None, None)]
    got = A.search(spark.createDataFrame(rows, SCHEMA)).toPandas().sort_values(["query_id", "rank"])
    assert sorted(set(got.query_id)) == [50, 100, 150, 200, 250, 300, 350, 1000]
    assert got[got.query_id == 50].vec_id.tolist() == [1, 2, 3, 4, 5]
    assert got[got.query_id == 1000].vec_id.tolist() == [1, 2, 3, 4, 5]
    assert got[got.query_id == 50].score.nunique() == 1


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "", ""), (1, [1.0, 1.0], "", ""), (2, [-1.0, 0.0], "", "")], SCHEMA)
    got = A.search(few).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == [1, 2] and got.score.tolist()[1] == -1.0
    assert A.search(few.limit(0)).count() == 0


def test_many_copies_of_one_id_hide_no_other(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((12, 8)).round(3).tolist()
    rows = [(50, v[0], "", "")] + [(1, v[1], "", "")] * 3000 + [(i, v[i], "", "") for i in range(2, 12)]
    got = A.search(spark.createDataFrame(rows, SCHEMA)).toPandas().sort_values("rank")
    ids, x = np.array([50, *range(1, 12)]), np.array(v, np.float32).astype(float)
    assert list(zip(got.vec_id, got.score)) == brute(ids, x, 50, 5)[50]


def test_repeated_ids_with_different_vectors(spark):
    rows = [(50, [0.0, 1.0], "", ""), (50, [1.0, 0.0], "", ""), (50, [1.0, 0.0], "", ""), (1, [0.0, 1.0], "", ""), (1, [1.0, 0.0], "", ""), (2, [1.0, 1.0], "", ""), (3, [0.0, 2.0], "", "")]
    got = A.search(spark.createDataFrame(rows, SCHEMA)).toPandas().sort_values("rank")
    first = min(([0.0, 1.0], [1.0, 0.0]), key=lambda x: np.array(x, "<f8").tobytes())
    assert first == [0.0, 1.0]
    assert got.vec_id.tolist() == [1, 3, 2] and got.score.round(9).tolist() == [1.0, 1.0, round(0.5**0.5, 9)]


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """60,000 vectors in loose clusters: a sixth equal, a tenth near copies, some ids repeated."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((300, 64))
    v = centres[rng.integers(300, size=60_000)] + 1.2 * rng.standard_normal((60_000, 64))
    v[20_000:30_000] = v[77]
    v[30_000:36_000] = v[:6_000] + 0.02 * rng.standard_normal((6_000, 64))
    v, ids = v.astype(np.float32), np.arange(60_000)
    ids[59_000:] = ids[100]
    v[59_000:] = v[100]
    at = str(tmp_path_factory.mktemp("many") / "embeddings.parquet")
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(v), pa.list_(pa.float32()))}), at, row_group_size=8_000)
    once = np.unique(ids, return_index=True)[1]
    x = v[once].astype(float)
    turned, want = A.unit(x).T, {}
    for q in range(0, len(once), 50):
        score = np.round(A.unit(x[q : q + 1]) @ turned, 12)[0]
        score[q] = -2
        near = np.lexsort((ids[once], -score))[:5]
        want[q] = list(zip(ids[once][near].tolist(), score[near].tolist()))
    return spark.read.parquet(at), want


def test_recall_of_the_scan_on_many(many):
    got = A.search(many[0], block=4_096).toPandas()
    assert set(got.query_id) == set(many[1]) and (got.groupby("query_id").size() == 5).all()
    found = recall(got, many[1])
    print("recall", found)
    assert found >= 0.95
    equal = got[(got.query_id > 20_004) & (got.query_id < 30_000)].sort_values(["query_id", "rank"])
    assert equal.groupby("query_id").vec_id.agg(list).map(tuple).nunique() == 1  # ties to the smaller ids


def test_answers_come_from_the_scan(many, monkeypatch):
    """Where the tests reject all they can, hardly anything is found."""
    assert recall(A.search(many[0], eps=-4.0).toPandas(), many[1]) < 0.5
    rng = np.random.default_rng(2)
    q, v = rng.standard_normal((3, 16)), rng.standard_normal((500, 16))
    args = (np.arange(3), q, np.full(3, np.inf), np.arange(500), v, np.eye(16), 5, 4, 2.1)
    assert len(A.search_block(*args)[0]) == 15
    monkeypatch.setattr(A, "scan", lambda *_: (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert len(A.search_block(*args)[0]) == 0


def test_scan_abandons_only_far_candidates():
    rng = np.random.default_rng(1)
    q, v = A.unit(rng.standard_normal((20, 64))), A.unit(rng.standard_normal((5000, 64)))
    d = ((q[:, None] - v[None]) ** 2).sum(2)
    bound = np.sort(d, axis=1)[:, 49]
    i, j = A.scan(q, v, bound, 16, 2.1)
    assert (d[i, j] <= bound[i] + 1e-8).all() and len(i) >= 0.97 * 20 * 50
