"""Queries of the models over metrics made of line items; rows only, but for what has a closed form in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.standard import standardize
from ..operators import models as L
from .proxy import rounded, table
from .table_queries import RAW

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYS = ["l_orderkey", "l_linenumber"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def labelled(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*KEYS, "l_returnflag", "l_linestatus", *[F.expr(e).cast("double").alias(c) for c, e in RAW.items()])
    return standardize(rows).withColumns({
        "built_vs_open": F.when(F.col("l_returnflag") != "N", "open_space").otherwise("built_up"), "n_buildings": F.col("m9_raw").cast("long"), "block_area": F.col("m5_raw") + 600.0,
        "subdivisions_settlements": F.when(F.col("m2_std") + F.col("m11_std") + F.pmod(F.xxhash64(*KEYS), F.lit(100)) / 100.0 > 1.5, "subdivision").otherwise("irregular_settlement"),
    })


@query()
def lr_score(spark, d):
    """Blocks scored by a calibrated stage that was trained on the same table."""
    rows = labelled(spark, d)
    data = rows.withColumn("y", (F.col("subdivisions_settlements") == "subdivision").cast("int"))
    model = L.calibrated(data.select(*KEYS, *L.REGULARITY, "m11_std", "y"), [*L.REGULARITY, "m11_std"], KEYS, cv=5)
    return rounded(model.transform(rows, "p_subdivision").select(*KEYS, "p_subdivision"))


@query("WITH c AS (SELECT l_returnflag <> 'N' AS y, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(y AS INT) AS y, CAST(k AS INT) AS fold, CAST(n // 5 + CASE WHEN (k + 4) % 5 < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM c, range(5) r(k)")
def stratified_folds(spark, d):
    """Five folds of line items, each class dealt evenly."""
    rows = table(spark, d, "lineitem").select(*KEYS, (F.col("l_returnflag") != "N").cast("int").alias("y"))
    return L.stratified(rows, 5, KEYS).groupBy("y", F.col("fold__").alias("fold")).agg(F.count("*").alias("n"))


@query()
def boosted_trees(spark, d):
    """Calibrated boosted trees on labelled line items, over three metrics, with few rounds and folds."""
    metrics = ["m1_std", "m2_std", "m11_std"]
    rows = labelled(spark, d).select(*KEYS, *metrics, "subdivisions_settlements")
    tree = L.boosted(rows, metrics, "subdivisions_settlements", "subdivision", KEYS, rounds=3, depth=3, repeats=1, outer=2, inner=2)
    found = [(c, tree["auc"], tree["brier"], *tree["importance"][c]) for c in metrics]
    return rounded(spark.createDataFrame(found, "metric string, auc double, brier double, importance double, deviation double"), 4)


@query()
def principal_components(spark, d):
    out = L.components(labelled(spark, d), L.ALL)
    rows = [(i + 1, float(v), float(s), float(c), i < out["n_retain"]) for i, (v, s, c) in enumerate(zip(out["eigenvalues"], out["share"], out["cumulative"]))]
    return rounded(spark.createDataFrame(rows, "component int, eigenvalue double, share double, cumulative double, retained boolean"))


@query()
def factor_analysis(spark, d):
    out = L.factors(labelled(spark, d).withColumn("noise", F.pmod(F.xxhash64(*KEYS), F.lit(1000)) / 1000.0), ["m1_std", "m2_std", "m4_std", "m5_std", "m12_std", "noise"], 2)
    rows = [(i, int(f), float(c), bool(x)) for i, (f, c, x) in enumerate(zip(out["dominant"], out["communalities"], out["cross_loading"]))]
    return rounded(spark.createDataFrame(rows, "metric int, dominant int, communality double, cross_loading boolean"), 4)


PAIRS = [("m1_std", "l_discount * 10"), ("m4_std", "l_tax * 10"), ("m9_std", "1 - l_quantity / 90")]


@query("SELECT round(corr(l_discount * 10, l_tax * 10), 6) + 0.0 AS r12, round(corr(l_discount * 10, 1 - l_quantity / 90), 6) + 0.0 AS r13, round(corr(l_tax * 10, 1 - l_quantity / 90), 6) + 0.0 AS r23, count(*) AS n FROM lineitem")
def correlation_matrix(spark, d):
    m, n = L.correlations(labelled(spark, d), [c for c, _ in PAIRS])
    return rounded(spark.createDataFrame([(float(m[0, 1]), float(m[0, 2]), float(m[1, 2]), n)], "r12 double, r13 double, r23 double, n long"))
