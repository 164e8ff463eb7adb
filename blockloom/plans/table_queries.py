"""Queries of the relational operators over the plain tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.numeric import fill_median, ratio, row_mean
from ..functions.projection import from_utm, to_utm, utm_epsg
from ..functions.standard import standardize
from ..operators import matching as A
from ..operators import tables as R
from .proxy import rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Raw metrics out of line items.
RAW = {
    "m1_raw": "l_discount * 10", "m2_raw": "l_quantity * 3", "m3_raw": "l_quantity * 2", "m4_raw": "l_tax * 10", "m5_raw": "l_extendedprice / 100", "m6_raw": "l_discount",
    "m7_raw": "l_quantity * 5", "m8_raw": "1 - l_tax * 2", "m9_raw": "l_quantity", "m10_raw": "l_extendedprice / 10", "m11_raw": "l_discount * 5", "m12_raw": "l_quantity * 6", "k_complexity": "l_quantity / 2",
}
STD_SQL = {
    "m1": "m1_raw", "m2": "1 - least(m2_raw, 100) / 100", "m3": "least(m3_raw, 80) / 80", "m4": "m4_raw", "m5": "least(m5_raw, 324) / 324", "m6": "m6_raw", "m7": "1 - (least(greatest(m7_raw, 30), 200) - 30) / 170",
    "m8": "greatest(m8_raw, 0.9)", "m9": "1 - m9_raw / 90", "m10": "1 - least(m10_raw, 4000) / 4000", "m11": "1 - m11_raw", "m12": "least(m12_raw, 200) / 200", "k_complexity": "1 - least(k_complexity, 13) / 13",
}
RAW_SQL = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_partkey % 11 <> {i} THEN CAST({e} AS DOUBLE) END AS {c}" for i, (c, e) in enumerate(RAW.items())) + " FROM lineitem"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.when(F.col("l_partkey") % 11 != i, F.expr(e).cast("double")).alias(c) for i, (c, e) in enumerate(RAW.items())])


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(CASE WHEN {m if m == 'k_complexity' else m + '_raw'} IS NOT NULL THEN {e} END, 8) + 0.0 AS {m}_std' for m, e in STD_SQL.items())} FROM ({RAW_SQL})")
def standardize_all(spark, d):
    return rounded(standardize(raw(spark, d)).select("l_orderkey", "l_linenumber", *[f"{m}_std" for m in STD_SQL]), 8)


@query(f"SELECT l_orderkey, l_linenumber, round((m1_std + m2_std) / 2, 6) + 0.0 AS m1_m2_composite, round((m3_std + m7_std) / 2, 6) + 0.0 AS m3_m7_composite FROM (SELECT *, {', '.join(f'CASE WHEN {m}_raw IS NOT NULL THEN {STD_SQL[m]} END AS {m}_std' for m in ('m1', 'm2', 'm3', 'm7'))} FROM ({RAW_SQL}))")
def composite_features(spark, d):
    return rounded(R.composites(standardize(raw(spark, d))).select("l_orderkey", "l_linenumber", "m1_m2_composite", "m3_m7_composite"))


COLUMNS = ["m1_raw", "m4_raw", "m6_raw", "m8_raw", "m11_raw"]


@query(f"SELECT l_orderkey, l_linenumber, round(list_aggregate(list_filter([{', '.join(COLUMNS)}], lambda x: x IS NOT NULL), 'avg'), 6) + 0.0 AS mean_metric, {' + '.join(f'CAST({c} IS NULL AS INT)' for c in COLUMNS)} AS n_missing FROM ({RAW_SQL})")
def regularity_index_ab(spark, d):
    missing = sum((F.col(c).isNull().cast("int") for c in COLUMNS), F.lit(0))
    return rounded(raw(spark, d).select("l_orderkey", "l_linenumber", row_mean([F.col(c) for c in COLUMNS]).alias("mean_metric"), missing.alias("n_missing")))


@query("WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 3 = 0 AND c_nationkey <> 4 THEN c_acctbal END AS b FROM customer) SELECT c_custkey, c_nationkey, round(coalesce(a, quantile_cont(a, 0.5) OVER w, 0), 6) AS a, round(coalesce(b, quantile_cont(b, 0.5) OVER w, 7), 6) + 0.0 AS b FROM c WINDOW w AS (PARTITION BY c_nationkey)")
def median_fill(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("a"), F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_nationkey") != 4), F.col("c_acctbal")).alias("b"))
    return rounded(fill_median(c, ["c_nationkey"], {"a": 0.0, "b": 7.0}).select("c_custkey", "c_nationkey", "a", "b"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / nullif(stddev_samp(c_acctbal) OVER (), 0), 6) + 0.0 AS c_acctbal_zc, round((c_acctbal - min(c_acctbal) OVER ()) / nullif(max(c_acctbal) OVER () - min(c_acctbal) OVER (), 0), 6) + 0.0 AS c_acctbal_mm FROM customer")
def zscore_minmax(spark, d):
    return rounded(R.scaled(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", "c_acctbal_zc", "c_acctbal_mm"))


@query("SELECT 'p_size' AS metric, count(p_size) AS n, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS std, CAST(min(p_size) AS DOUBLE) AS low, quantile_cont(CAST(p_size AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(p_size AS DOUBLE), 0.75) AS q75, CAST(max(p_size) AS DOUBLE) AS high, count(*) FILTER (WHERE p_size IS NULL) AS n_missing FROM part "
       "UNION ALL SELECT 'p_retailprice', count(p_retailprice), round(avg(p_retailprice), 6), round(stddev_samp(p_retailprice), 6), round(min(p_retailprice), 6), round(quantile_cont(p_retailprice, 0.25), 6), round(quantile_cont(p_retailprice, 0.5), 6), round(quantile_cont(p_retailprice, 0.75), 6), round(max(p_retailprice), 6), count(*) FILTER (WHERE p_retailprice IS NULL) FROM part")
def describe_summary(spark, d):
    return rounded(R.describe(table(spark, d, "part"), ["p_size", "p_retailprice"]))


@query("SELECT CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    p = F.col("o_orderpriority")
    return R.value_counts(table(spark, d, "orders").select(F.when(~p.startswith("5"), p).alias("o_orderpriority")), "o_orderpriority")


@query("WITH k AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_repeated, sum(n) = count(*) AS is_unique FROM k")
def key_uniqueness_check(spark, d):
    return R.key_check(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT o_orderkey, o_totalprice AS block_area FROM orders WHERE o_totalprice >= 700")
def block_min_area_filter(spark, d):
    return R.large_blocks(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("block_area")))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def missing_city_antijoin(spark, d):
    done = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return R.missing_from(table(spark, d, "customer").select("c_custkey", "c_nationkey"), done, ["c_custkey"])


@query("SELECT s_suppkey AS block_id, s_acctbal AS block_area, CAST(NULL AS VARCHAR) AS name, false AS is_fill_block, CAST(NULL AS VARCHAR) AS fill_method FROM supplier UNION ALL SELECT c_custkey, NULL, c_name, true, 'polygonized' FROM customer")
def union_fill_blocks(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("block_id"), F.col("s_acctbal").alias("block_area"))
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("block_id"), F.col("c_name").alias("name"))
    return R.with_fill_blocks(b, f).select("block_id", "block_area", "name", "is_fill_block", "fill_method")


@query("SELECT o_custkey AS city, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS block_id FROM orders")
def number_blocks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("city"), "o_orderkey", "o_totalprice")
    return R.number_blocks(o, ["o_totalprice", "o_orderkey"]).select("city", "o_orderkey", "block_id")


PROBABILITIES = "SELECT l_orderkey, l_linenumber, l_partkey % 4 AS n_buildings, CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_quantity / 50 AS DOUBLE) END AS p_built, CASE WHEN l_suppkey % 7 <> 0 THEN CAST(l_discount * 10 AS DOUBLE) END AS p_residential, CASE WHEN l_partkey % 5 <> 0 THEN CAST(1 - l_tax * 5 AS DOUBLE) END AS p_subdivision, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_tax * 12 AS DOUBLE) END AS p_formal FROM lineitem"
CLASSES = f"""WITH p AS ({PROBABILITIES}), f AS (SELECT *, coalesce(n_buildings = 0, false) OR coalesce(p_built < 0.5, false) AS o FROM p), g AS (SELECT *, NOT o AND coalesce(p_residential < 0.5, false) AS u FROM f)
SELECT l_orderkey, l_linenumber, CASE WHEN o THEN 'open_space' WHEN u THEN 'non_residential' WHEN p_subdivision < 0.8 THEN 'irregular_settlement' WHEN p_subdivision >= 0.8 AND p_formal >= 0.5 THEN 'formal_subdivision' WHEN p_subdivision >= 0.8 AND p_formal < 0.5 THEN 'informal_subdivision' ELSE 'unclassified' END AS classification,
    round(CASE WHEN NOT o AND NOT u THEN p_subdivision END, 6) + 0.0 AS regularity_index, round(p_built * p_residential, 6) + 0.0 AS cascade_confidence FROM g"""


def probabilities(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*[c.strip() for c in PROBABILITIES[len("SELECT "):].split(" FROM ")[0].split(", ")])


@query(CLASSES)
def hierarchical_class(spark, d):
    return rounded(R.classify(probabilities(spark, d)).select("l_orderkey", "l_linenumber", "classification", "regularity_index", "cascade_confidence"))


@query(f"SELECT classification, count(*) AS n, round(avg(regularity_index), 6) + 0.0 AS mean_index FROM ({CLASSES}) GROUP BY classification")
def scored_classes(spark, d):
    out = R.classify(probabilities(spark, d))
    return rounded(out.groupBy("classification").agg(F.count("*").alias("n"), F.avg("regularity_index").alias("mean_index")))


LABELLED = "SELECT d.doc_id, l.toxic, l.quality, least(1, n_chars / 3000 + l.toxic * 0.2::DOUBLE) AS score, n_chars FROM documents d JOIN labels l USING (doc_id)"


def labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", "toxic", "quality", F.least(F.lit(1.0), F.col("n_chars") / 3000.0 + F.col("toxic") * F.lit(0.2)).alias("score"), "n_chars")


@query(f"WITH l AS ({LABELLED}), e AS (SELECT list_distinct(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM l), b AS (SELECT toxic, score, len(list_filter(edges, lambda x: x < score)) AS bin FROM l, e), p AS (SELECT bin, avg(toxic) AS o, avg(score) AS p, sum((score - toxic) ** 2) AS s, count(*) AS n FROM b GROUP BY bin) SELECT round(avg(abs(o - p)), 6) AS ece, round(sum(s) / sum(n), 6) AS brier, count(*) AS n_bins FROM p")
def ece_quantile_bins(spark, d):
    return rounded(R.calibration_error(labelled(spark, d), "toxic", "score"))


THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]


@query(f"WITH l AS ({LABELLED}), t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE toxic = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE toxic <> 1 AND score >= threshold) AS fp, count(*) FILTER (WHERE toxic = 1 AND score < threshold) AS fn FROM l, t GROUP BY threshold) "
       "SELECT threshold, tp, fp, fn, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM c")
def precision_recall_f1(spark, d):
    return rounded(R.threshold_table(labelled(spark, d), "toxic", "score", THRESHOLDS))


@query(f"WITH l AS ({LABELLED}) SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS auc FROM l a JOIN l b ON a.toxic = 1 AND b.toxic <> 1")
def roc_auc(spark, d):
    return rounded(R.roc_auc(labelled(spark, d), "toxic", "score"))


@query(f"SELECT toxic, quality, count(*) AS n, {', '.join(f'round(quantile_cont(CAST(n_chars AS DOUBLE), {q}), 6) AS n_chars_q{int(q * 100)}' for q in (0.25, 0.5, 0.75))} FROM ({LABELLED}) GROUP BY toxic, quality")
def open_space_quartiles(spark, d):
    return rounded(R.quartiles_by(labelled(spark, d).withColumn("n_chars", F.col("n_chars").cast("double")), ["toxic", "quality"], ["n_chars"]))


@query("WITH f AS (SELECT l_orderkey, l_linenumber, l_discount > 0.05 AS b, CASE WHEN l_partkey % 3 > 0 THEN l_tax > 0.04 END AS r, l_quantity > 40 AS i, l_discount * 10 AS m1, l_tax * 10 AS m4 FROM lineitem) SELECT l_orderkey, l_linenumber, b OR coalesce(r, false) OR i AS has_features, round(CASE WHEN b OR coalesce(r, false) OR i THEN m1 END, 6) AS m1_std, round(CASE WHEN b OR coalesce(r, false) OR i THEN m4 END, 6) AS m4_std FROM f")
def featureless_mask(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).alias("has_buildings"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_tax") > 0.04).alias("has_roads"),
        (F.col("l_quantity") > 40).alias("has_intersections"), (F.col("l_discount") * 10).alias("m1_std"), (F.col("l_tax") * 10).alias("m4_std"),
    )
    return rounded(R.without_featureless(rows).select("l_orderkey", "l_linenumber", "has_features", "m1_std", "m4_std"))


@query("SELECT n_nationkey, CASE n_name WHEN 'CHINA' THEN 'Zhongguo' WHEN 'FRANCE' THEN 'Hexagone' ELSE n_name END AS n_name FROM nation")
def replace_names(spark, d):
    pairs = [("CHINA", "FRANCE_"), ("FRANCE_", "Zhongguo"), ("FRANCE", "Hexagone")]
    return table(spark, d, "nation").select("n_nationkey", R.replaced(F.col("n_name"), pairs).alias("n_name"))


PHRASES = "SELECT doc_id, unnest(range(len(x))) AS phrase, unnest(x) AS name FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[\\n|.]') AS x FROM documents)"
CLEARED = "CASE WHEN lower(trim(name)) IN ('', 'nan', 'none') THEN '' ELSE trim(name) END"


@query(f"SELECT doc_id, CAST(phrase AS INT) AS phrase, regexp_replace(lower(strip_accents({CLEARED})), '[^a-z0-9]+', '', 'g') AS name_key, regexp_replace(regexp_replace(strip_accents({CLEARED}), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS token, regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '', 'g') AS join_key FROM ({PHRASES})")
def city_name_keys(spark, d):
    """Keys of every phrase of every text, up to its end; phrases end at a line, a bar or a full stop."""
    every = F.posexplode(F.split(F.coalesce("text", F.lit("")), "[\n|.]")).alias("phrase", "name")
    p = table(spark, d, "documents").select("doc_id", every)
    return p.select("doc_id", "phrase", N.name_key(F.col("name")).alias("name_key"), N.folder_token(F.col("name")).alias("token"), N.join_key(F.col("name")).alias("join_key"))


@query("SELECT n_nationkey, replace(n_name, ' ', '_') || '__' || replace(r_name, ' ', '_') AS folder FROM nation JOIN region ON n_regionkey = r_regionkey")
def city_folders(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", N.city_folder(F.col("n_name"), F.col("r_name")).alias("folder"))


@query("SELECT DISTINCT c_name FROM customer WHERE lower(c_name) LIKE '%c%r%1%' ORDER BY c_name LIMIT 50")
def city_like_match(spark, d):
    """The first 50 names of a report, whatever their case."""
    return A.names_like(table(spark, d, "customer"), "c_name", "%C%R%1%")


@query("SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def distinct_names(spark, d):
    return A.distinct_names(table(spark, d, "part"), "p_type")


def wanted(spark, d) -> DataFrame:
    """Names of nations as they are, with a letter less, with a prefix, or of nobody."""
    n = table(spark, d, "nation")
    name = F.initcap(F.lower("n_name"))
    odd = F.when(F.col("n_nationkey") % 4 == 1, F.concat(F.substring(name, 1, 3), F.substr(name, F.lit(5)))).when(F.col("n_nationkey") % 4 == 2, F.substring(name, 1, 4)).when(F.col("n_nationkey") % 12 == 3, F.lit("  ")).otherwise(name)
    return n.select(F.col("n_nationkey").alias("row_index"), odd.alias("city"), F.lit("").alias("country"))


@query()
def city_match_plan(spark, d):
    catalogue = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    over = spark.createDataFrame([("Germany", "", "DEUTSCHLAND")], "city string, country string, name string")
    return rounded(A.match_plan(wanted(spark, d), catalogue, over))


@query()
def city_fuzzy_match(spark, d):
    a = table(spark, d, "customer").select(N.name_key(F.concat("c_mktsegment", F.lit("s"))).alias("key"))
    b = table(spark, d, "customer").select(N.name_key(F.col("c_mktsegment")).alias("key"))
    return rounded(A.near_keys(a, b))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 32700 ELSE 32600 END + CAST(least(floor((c_custkey * 7 % 361 - 180 + 180) / 6) + 1, 60) AS INT) AS epsg FROM customer")
def utm_zones(spark, d):
    lon = (F.col("c_custkey") * 7 % 361 - 180).cast("double")
    return table(spark, d, "customer").select("c_custkey", utm_epsg(lon, F.col("c_acctbal")).alias("epsg"))


@query("SELECT c_custkey, CAST((c_custkey * 7 % 359 - 179.5::DOUBLE) AS DOUBLE) AS lon, CAST((c_custkey * 13 % 160 - 79.5::DOUBLE) AS DOUBLE) AS lat, true AS comes_back FROM customer")
def utm_round_trip(spark, d):
    lon, lat = (F.col("c_custkey") * 7 % 359).cast("double") - 179.5, (F.col("c_custkey") * 13 % 160).cast("double") - 79.5
    rows = table(spark, d, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    rows = rows.withColumn("epsg", utm_epsg(F.col("lon"), F.col("lat")))
    x, y = to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    rows = rows.withColumns({"x": x, "y": y})
    a, b = from_utm(F.col("x"), F.col("y"), F.col("epsg"))
    return rows.select("c_custkey", "lon", "lat", ((F.abs(a - F.col("lon")) < 1e-7) & (F.abs(b - F.col("lat")) < 1e-7)).alias("comes_back"))


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS weight, row_number() OVER (ORDER BY sum(p_size) DESC, p_brand) AS place, round(sum(CAST(sum(p_size) AS DOUBLE)) OVER (ORDER BY sum(p_size) DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(sum(p_size)) OVER (), 6) AS cumulative FROM part GROUP BY p_brand")
def ranked_shares(spark, d):
    """Places and running shares of the brands, a few dozen rows: a report."""
    w = Window.orderBy(F.desc("weight"), "p_brand")
    per = table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("weight"))
    running = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rounded(per.select("p_brand", "weight", F.row_number().over(w).cast("long").alias("place"), ratio(running, F.sum("weight").over(Window.partitionBy())).alias("cumulative")))
