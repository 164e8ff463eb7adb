"""Relational operators on block tables: consolidation, checks, summaries, set operations, classification, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio

MIN_BLOCK_AREA = 700.0


def consolidate(groups: list[DataFrame | None], keys: list[str], prefixes: dict[int, str] | None = None) -> DataFrame:
    """Left joins of metric groups on ``keys``, the first one that is there being the base; of columns with one name
    the first group's wins. ``prefixes`` gives the columns of a group, by its number, a prefix, but for names that
    have it. A group that is None is left out."""
    def prepared(i: int, g: DataFrame) -> DataFrame:
        p = (prefixes or {}).get(i)
        return g.select([F.col(c).alias(c if c in keys or not p or c.startswith(p) else p + c) for c in g.columns]) if p else g

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        new = [c for c in right.columns if c not in keys and c not in left.columns and c != "geometry"]
        return left.join(right.select(*keys, *new), keys, "left")

    there = [prepared(i, g) for i, g in enumerate(groups) if g is not None]
    if not there:
        raise ValueError("no group of metrics is there")
    return reduce(add, there)


def large_blocks(blocks: DataFrame, least: float = MIN_BLOCK_AREA) -> DataFrame:
    return blocks.where(F.col("block_area") >= least)


def with_fill_blocks(base: DataFrame, fill: DataFrame) -> DataFrame:
    """Base and fill blocks in one table, with where they come from."""
    none = F.lit(None).cast("string")
    a = base.withColumns({"is_fill_block": F.lit(False), "fill_method": none})
    b = fill.withColumns({"is_fill_block": F.lit(True)} | ({} if "fill_method" in fill.columns else {"fill_method": F.lit("polygonized")}))
    return a.unionByName(b, allowMissingColumns=True)


def number_blocks(blocks: DataFrame, order: list[str], cells: dict[str, Column] | None = None) -> DataFrame:
    """block_id 0, 1, ... of each city in a fixed order. With ``cells``, columns that divide a city, a block's number
    is its cell's offset and its place in the cell, so that no task orders a whole city."""
    if not cells:
        return blocks.withColumn("block_id", (F.row_number().over(Window.partitionBy("city").orderBy(*order)) - 1).cast("long"))
    names = [f"cell__{c}" for c in cells]
    dealt = blocks.withColumns(dict(zip(names, cells.values())))
    before = Window.partitionBy("city").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("city", *names).agg(F.count("*").alias("n__")).select("city", *names, F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("offset__"))
    place = F.row_number().over(Window.partitionBy("city", *names).orderBy(*order)) - 1
    out = dealt.withColumn("place__", place).join(offsets, ["city", *names])
    return out.withColumn("block_id", (F.col("offset__") + F.col("place__")).cast("long")).drop(*names, "offset__", "place__")


def key_check(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows and distinct keys there are, how many keys repeat, and whether the key is unique."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"),
    ).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def missing_from(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose key ``done`` lacks."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows of each value, NULL among them."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, mean, sample deviation, least, exact quartiles, greatest, missing."""
    stats = lambda c: F.struct(
        F.lit(c).alias("metric"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("low"),
        F.percentile(c, 0.25).alias("q25"), F.percentile(c, 0.5).alias("q50"), F.percentile(c, 0.75).alias("q75"), F.max(c).cast("double").alias("high"), F.count_if(F.col(c).isNull()).alias("n_missing"),
    )
    return rows.agg(F.array(*map(stats, columns)).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores (sample deviation) as ``c_zc`` and their min-max scale as ``c_mm``, over the whole table."""
    parts = [f(c).alias(f"{n}__{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    one = rows.agg(*parts)
    out = rows.crossJoin(F.broadcast(one))  # one row
    for c in columns:
        z = lambda v, c=c: ratio(v - F.col(f"mean__{c}"), F.col(f"std__{c}"))
        low, high = z(F.col(f"min__{c}")), z(F.col(f"max__{c}"))
        out = out.withColumns({f"{c}_zc": z(F.col(c)), f"{c}_mm": ratio(z(F.col(c)) - low, high - low)})
    return out.drop(*one.columns)


def quartiles_by(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per class the number of rows and each column's exact quartiles."""
    parts = [F.percentile(c, q).alias(f"{c}_q{int(q * 100)}") for c in columns for q in (0.25, 0.5, 0.75)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *parts)


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Exact replacements in order, each on what the last one left."""
    for old, new in pairs:
        c = F.when(c == old, F.lit(new)).otherwise(c)
    return c


def composites(rows: DataFrame) -> DataFrame:
    """The mean of the standardised M1 and M2, and of M3 and M7."""
    return rows.withColumns({"m1_m2_composite": (F.col("m1_std") + F.col("m2_std")) / 2.0, "m3_m7_composite": (F.col("m3_std") + F.col("m7_std")) / 2.0})


def without_featureless(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``has_features``, whether a block has buildings, roads or intersections, and the standardised metrics (twelve,
    those that are there) NULL where it has none. A flag that is NULL is false."""
    flag = F.lit(False)
    for c in ("has_buildings", "has_roads", "has_intersections"):
        flag = flag | F.coalesce(F.col(c), F.lit(False))
    columns = columns or [f"m{i}_std" for i in range(1, 13) if f"m{i}_std" in rows.columns]
    return rows.withColumn("has_features", flag).withColumns({c: F.when(F.col("has_features"), F.col(c)) for c in columns})


def tooltip(rows: DataFrame, out: str = "tooltip") -> DataFrame:
    """A label of three lines for each scored block: its class in words, the index to two digits, the area."""
    words = F.initcap(F.translate(F.coalesce("classification", F.lit("unclassified")), "_", " "))
    index = F.coalesce(F.format_string("%.2f", "regularity_index"), F.lit("N/A")) if "regularity_index" in rows.columns else F.lit("N/A")
    index = F.when(F.col("regularity_index").isNull(), F.lit("N/A")).otherwise(index) if "regularity_index" in rows.columns else index
    area = F.format_number(F.coalesce("block_area", F.lit(0.0)), 0)
    return rows.withColumn(out, F.concat(F.lit("<b>"), words, F.lit("</b><br>Regularity index: "), index, F.lit("<br>Block area: "), area, F.lit(" m²")))


# Thresholds of the hierarchy.
BUILT, RESIDENTIAL, SUBDIVISION, FORMAL = 0.5, 0.5, 0.8, 0.5


def classify(rows: DataFrame, subdivision: float = SUBDIVISION) -> DataFrame:
    """The class of each block from its stage probabilities, its regularity index and the cascade's confidence.

    A NULL probability fails every comparison, so a block goes on past the stage it is unknown for, and is
    ``unclassified`` where the last one needed is. A column that is missing is 1 for the first stages, and
    ``n_buildings`` never 0. Without any formal probability in the whole table, subdivisions are not divided."""
    have = set(rows.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    under = lambda c, t: F.coalesce(get(c) < t, F.lit(False))
    empty = F.coalesce(F.col("n_buildings") == 0, F.lit(False)) if "n_buildings" in have else F.lit(False)
    is_open = empty | under("p_built", BUILT)
    other_use = ~is_open & under("p_residential", RESIDENTIAL)
    residential = ~is_open & ~other_use
    planned = residential & F.coalesce(get("p_subdivision") >= subdivision, F.lit(False))
    formal_known = F.lit(False)
    if "p_formal" in have:
        known = rows.agg(F.count("p_formal").alias("formal__n"))
        rows = rows.crossJoin(F.broadcast(known))  # one row
        formal_known = F.col("formal__n") > 0
    name = (
        F.when(is_open, "open_space").when(other_use, "non_residential").when(under("p_subdivision", subdivision), "irregular_settlement")
        .when(planned & ~formal_known, "subdivision").when(planned & F.coalesce(get("p_formal") >= FORMAL, F.lit(False)), "formal_subdivision")
        .when(planned & under("p_formal", FORMAL), "informal_subdivision").otherwise("unclassified")
    )
    return rows.withColumns({
        "classification": name, "regularity_index": F.when(residential, get("p_subdivision")), "cascade_confidence": get("p_built") * get("p_residential"),
    }).drop("formal__n")


def calibration_error(rows: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    """One row: the mean over quantile bins of the gap between observed and predicted rates, and the Brier score.

    Bins are between the distinct exact quantiles of the score, the value on an edge in the lower bin."""
    rows = rows.select(F.col(truth).cast("double").alias("y"), F.col(score).alias("s"))
    edges = rows.agg(F.array_distinct(F.percentile("s", [i / bins for i in range(1, bins)])).alias("edges"))
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("s"))))  # one row
    per = binned.groupBy("bin").agg(F.avg("y").alias("observed"), F.avg("s").alias("predicted"), F.sum(F.pow(F.col("s") - F.col("y"), 2)).alias("square"), F.count("*").alias("n"))
    return per.agg(F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("ece"), ratio(F.sum("square"), F.sum("n")).alias("brier"), F.count("*").alias("n_bins"))


def threshold_table(rows: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold, 0 where undefined, in one pass over the rows."""
    y = F.col(truth) == 1
    parts = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(y & (F.col(score) >= t)).alias("tp"), F.count_if(~y & (F.col(score) >= t)).alias("fp"), F.count_if(y & (F.col(score) < t)).alias("fn")) for t in thresholds]
    out = rows.agg(F.array(*parts).alias("t")).select(F.explode("t").alias("t")).select("t.*")
    share = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def roc_auc(rows: DataFrame, truth: str, score: str, cells: int = 4_096) -> DataFrame:
    """One row: the area under the ROC curve of scores in [0, 1], ties counted half. Distinct scores are ordered within
    cells of the range; the cells' totals, ``cells`` + 1 rows at most, carry the negatives below each cell."""
    kept = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).select(F.col(score).alias("s"), (F.col(truth) == 1).alias("y"))
    per = kept.groupBy("s").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    per = per.withColumn("cell", F.floor(F.col("s") * cells))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy("cell").agg(F.sum("neg").alias("n")).select("cell", F.coalesce(F.sum("n").over(before(Window.orderBy("cell"))), F.lit(0)).alias("under"))
    here = F.coalesce(F.sum("neg").over(before(Window.partitionBy("cell").orderBy("s"))), F.lit(0))
    ranked = per.withColumn("here", here).join(F.broadcast(totals), "cell")
    wins = F.col("pos") * (F.col("under") + F.col("here") + F.col("neg") / 2.0)
    return ranked.agg(ratio(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def bounds(rows: DataFrame) -> DataFrame:
    """The box of all boxes."""
    return rows.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
