import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import models as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 1_500
    x = rng.standard_normal((n, 3))
    y = rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    data = [(i, *map(float, v), "yes" if t else "no") for i, (v, t) in enumerate(zip(x, y))] + [(n, None, 0.0, 0.0, "yes")]
    return spark.createDataFrame(data, "id int, a double, b double, c double, t string").persist()


def test_interpolate(spark):
    xs, ys = [0.0, 1.0, 1.0, 3.0], [0.1, 0.2, 0.5, 0.9]
    for x, want in ((-1, 0.1), (0.5, 0.15), (2, 0.7), (9, 0.9), (None, None)):
        got = spark.range(1).select(L.interpolate(F.lit(x).cast("double"), xs, ys)).first()[0]
        assert got == (want if want is None else pytest.approx(want))
    assert spark.range(1).select(L.interpolate(F.lit(5.0), [1.0], [0.3])).first()[0] == 0.3


def test_long_curves_keep_every_knot(spark):
    rng = np.random.default_rng(6)
    xs, ys = np.sort(rng.normal(size=3_000)).tolist(), np.sort(rng.random(3_000)).tolist()
    at = [*rng.normal(size=300).tolist(), xs[0], xs[-1], xs[7], -99.0, 99.0]
    rows = spark.createDataFrame([(x,) for x in at] + [(None,)], "x double")
    got = [r.p for r in rows.select(L.interpolate(F.col("x"), xs, ys).alias("p")).collect()]
    assert got[-1] is None and np.allclose(got[:-1], np.interp(at, xs, ys))
    few = rows.select(L.interpolate(F.col("x"), xs[::60], ys[::60]).alias("a"), L.interpolate(F.col("x"), xs[::60], ys[::60], most=2).alias("b")).collect()
    assert all(r.a == r.b for r in few)
    assert L.knots([1, 2, 3, 4, 5], [0, 1, 1, 1, 2]) == ([1, 2, 4, 5], [0, 1, 1, 2])


def test_folds_have_equal_shares_of_each_class(spark):
    rows = spark.range(1_003).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    for df in (rows, rows.repartition(5)):
        out = L.stratified(df, 4, ["id"], buckets=16)
        counts = out.groupBy("y").pivot("fold__", [0, 1, 2, 3]).count().toPandas().drop(columns="y")
        assert (counts.max(axis=1) - counts.min(axis=1) <= 1).all() and counts.to_numpy().sum() == 1_003
    first = {r.id: r.fold__ for r in L.stratified(rows, 4, ["id"]).collect()}
    assert first == {r.id: r.fold__ for r in L.stratified(rows.repartition(3), 4, ["id"]).collect()}
    assert first != {r.id: r.fold__ for r in L.stratified(rows, 4, ["id"], seed=1).collect()}


def test_regression_meets_the_optimum(spark, rows):
    """The gradient of the balanced, penalised loss is 0, up to the subgradient of the absolute values."""
    data = L.Scale.of(rows, ["a", "b", "c"]).vectors(rows).withColumn("y", (F.col("t") == "yes").cast("int"))
    model = L.regression(data, c=0.05, max_iter=300)
    got = data.select("features", "y").collect()
    x, y = np.array([r.features.toArray() for r in got]), np.array([r.y for r in got])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    coef = np.array(model.coefficients)
    p = 1 / (1 + np.exp(-(x @ coef + model.intercept)))
    g = 0.05 * ((p - y) * w) @ x + 0.5 * coef
    assert np.all(np.abs(g) <= 0.5 + 0.1) and np.allclose(g[coef != 0], -0.5 * np.sign(coef[coef != 0]), atol=0.1)


def test_evaluate_stage(rows):
    s = L.evaluate_stage(rows, ["a", "b", "c"], "t", "yes", "s", ["id"], n_splits=3, n_repeats=1, outer=2, inner=2)
    assert 0.8 < s.auc < 0.95 and s.brier < 0.18 and s.ece < 0.12 and len(s.aucs) == 3 == len(s.fits)
    assert [c["metric"] for c in s.coefficients] == ["a", "b", "c"] and s.coefficients[0]["sign"] == "YES"
    assert [t["threshold"] for t in s.thresholds] == L.THRESHOLDS
    out = s.model.transform(rows, "p").select("id", "p").collect()
    assert len(out) == 1_501 and [r.id for r in out if r.p is None] == [1_500] and all(0 <= r.p <= 1 for r in out if r.p is not None)


def test_path_and_trees(rows):
    path = L.regularization_path(rows, ["a", "b", "c"], "t", "yes", n=12)
    assert [p["metric"] for p in path][:2] == ["a", "b"]
    trees = L.boosted(rows, ["a", "b", "c"], "t", "yes", ["id"], rounds=8, depth=3, repeats=2, outer=2, inner=2)
    cost = {k: v[0] for k, v in trees["importance"].items()}
    assert 0.75 < trees["auc"] < 0.95 and 0.1 < trees["brier"] < 0.2 and max(cost, key=cost.get) == "a"
    stage = L.evaluate_stage(rows, ["a", "b", "c"], "t", "yes", "s", ["id"], n_splits=2, n_repeats=1, outer=2, inner=2)
    both = L.compare_models(stage, trees)
    assert both["difference"] == trees["auc"] - stage.auc and both["linear_is_enough"] == (abs(both["difference"]) < 0.02)


def test_quality_by_hand(spark):
    rng = np.random.default_rng(9)
    p, y = rng.random(400).round(2), rng.integers(0, 2, 400)
    auc, brier, ece = L.quality(spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double"))
    wins = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    assert auc == pytest.approx(np.mean(wins)) and brier == pytest.approx(((p - y) ** 2).mean()) and 0 < ece < 1


def test_trees_weigh_both_classes_alike(spark):
    rows = spark.createDataFrame([(i, float(i % 10), int(i % 10 == 0)) for i in range(400)], "id int, a double, y int")
    sums = {r.y: r.w for r in L.balanced(rows).groupBy("y").agg(F.sum("w").alias("w")).collect()}
    assert sums[0] == pytest.approx(sums[1]) == pytest.approx(200)
    assert L.trees(3, 2)(L.Scale.of(rows, ["a"]).vectors(rows.where("y = 1"))) is None


def test_components_and_factors(spark):
    rng = np.random.default_rng(2)
    f = rng.standard_normal((2_000, 2))
    x = np.hstack([f[:, :1] + 0.4 * rng.standard_normal((2_000, 3)), f[:, 1:] + 0.4 * rng.standard_normal((2_000, 3))])
    names = list("abcdef")
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    pca = L.components(rows, names)
    want = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    assert np.allclose(pca["eigenvalues"], want) and pca["n_retain"] == pca["n_kaiser"] == 2 and pca["cumulative"][-1] == pytest.approx(1)
    assert np.allclose(pca["loadings"] @ pca["loadings"].T, np.corrcoef(x.T))
    fa = L.factors(rows, names, 2)
    assert len(set(fa["dominant"][:3])) == 1 == len(set(fa["dominant"][3:])) and fa["dominant"][0] != fa["dominant"][3]
    assert not any(fa["cross_loading"]) and np.allclose(fa["communalities"], 1 / 1.16, atol=0.05) and fa["kmo"] > 0.7 and fa["df"] == 15


def test_cascade_and_scores(spark):
    rng = np.random.default_rng(3)
    n = 900
    x = rng.random((n, len(L.ALL)))
    built = x[:, 9] + 0.2 * rng.random(n) > 0.3
    planned = x[:, 5] + 0.2 * rng.random(n) > 0.6
    data = [(i, "a" if i % 2 else "b", *map(float, v), int(b) * 5, 650.0 + i, "built_up" if b else "open_space", "subdivision" if p else "irregular_settlement") for i, (v, b, p) in enumerate(zip(x, built, planned))]
    rows = spark.createDataFrame(data, "block_id int, city string, " + ", ".join(f"{m} double" for m in L.ALL) + ", n_buildings int, block_area double, built_vs_open string, subdivisions_settlements string")
    stages = L.run_cascade(rows, ["city", "block_id"], n_splits=2, n_repeats=1, outer=2, inner=2)
    assert set(stages) == {"stage1", "stage3_reg", "stage3_comp"} and stages["stage1"].auc > 0.85 and stages["stage3_reg"].auc > 0.85
    out = L.score_blocks(rows, stages).toPandas()
    assert len(out) == n - 50 and (out.block_area >= 700).all()
    assert set(out[out.n_buildings == 0].classification) == {"open_space"} and {"subdivision", "irregular_settlement"} <= set(out.classification)
    counts, _ = L.open_space(rows.withColumns({"m10_raw": F.col("m10_std"), "m11_raw": F.col("m11_std")}))
    assert sum(r.n for r in counts.collect()) == n


def test_regressions_of_all_folds_at_once_are_those_of_each(spark, rows):
    data = L.Scale.of(rows, ["a", "b", "c"]).vectors(rows).withColumn("y", (F.col("t") == "yes").cast("int"))
    dealt = L.stratified(data, 3, ["id"]).persist()
    for c in (1.0, 0.02):
        for k, line in enumerate(L.regressions(dealt, 3, c=c)):
            one = L.regression(dealt.where(F.col("fold__") != k), c=c, max_iter=300)
            assert np.allclose(line.coefficients, one.coefficients.toArray(), atol=1e-4) and line.intercept == pytest.approx(one.intercept, abs=1e-4)
    dealt.unpersist()
    lone = data.withColumn("fold__", F.when(F.col("y") == 1, 0).otherwise(F.pmod("id", F.lit(2))))
    first, second = L.regressions(lone, 2)
    assert first is None and second is not None


def test_calibration_takes_few_jobs(spark, rows):
    """One pass a step for all folds: five times as many folds are no five times as many passes."""
    data = rows.withColumn("y", (F.col("t") == "yes").cast("int"))
    spark.sparkContext.setJobGroup("few", "")
    try:
        assert len(L.calibrated(data, ["a", "b", "c"], ["id"], 5).pairs) == 5
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 150
    finally:
        spark.sparkContext.setJobGroup("rest", "")


def test_quality_of_trees_reads_written_scores(spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "quality", lambda scored: (seen.append(scored.inputFiles()), (0.5, 0.2, 0.1))[1])
    L.boosted(rows, ["a"], "t", "yes", ["id"], rounds=1, depth=1, repeats=0, outer=2, inner=2)
    assert seen and seen[0] and all("blockloom-stages" in f for f in seen[0])
