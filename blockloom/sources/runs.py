"""Runs over cities: one job for all, a status for each, and a record of the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import polygon_road_distance, rectangle_azimuth, with_box
from .layers import cities_with, still_wanted, write_layer
from .staging import staged


def run_group(spark: SparkSession, cities: DataFrame, make: Callable[[DataFrame], DataFrame], out: str, ignore: list[str] = [], inputs: list[str] = [], again: bool = False) -> DataFrame:
    """Make and write a layer for the cities that lack it. ``make`` takes the cities to do and returns rows with a
    ``city`` column. One job does all; only if it fails is each city tried alone, so that a bad one does not stop the
    others. Returns (city, status, n_rows, error); statuses as of ``still_wanted``, ``ok``, ``empty`` and ``failed``.
    With ``again``, what is done is made anew."""
    plan = still_wanted(spark, cities, out, ignore, inputs)
    if again:
        plan = still_wanted(spark, cities, None, ignore, inputs)
    plan = staged(plan)  # as it was before the run, whatever is lost
    todo = plan.where("status = 'todo'").select("city")
    failures: list[tuple[str, str]] = []
    if not todo.isEmpty():
        try:
            write_layer(make(todo), out)
        except Exception:
            for r in todo.toLocalIterator():  # the way out of a failed run, not the way through it
                one = spark.createDataFrame([(r.city,)], "city string")
                try:
                    write_layer(make(one), out)
                except Exception as e:
                    failures.append((r.city, f"{type(e).__name__}: {e}"[:500]))
    errors = spark.createDataFrame(failures, "city string, error string")
    rows = plan.join(cities_with(spark, out), "city", "left").join(errors, "city", "left")
    status = (
        F.when(F.col("status") != "todo", F.col("status")).when(F.col("error").isNotNull(), "failed")
        .when(F.coalesce("n_rows", F.lit(0)) > 0, "ok").otherwise("empty")
    )
    return rows.select("city", status.alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "error")


def building_distances(spark: SparkSession, buildings: str, roads: str) -> Callable[[DataFrame], DataFrame]:
    """A step for ``run_group``: the buildings of cities with their distance to the nearest road."""
    def make(todo: DataFrame) -> DataFrame:
        own = lambda path: with_box(spark.read.parquet(path).join(todo, "city", "left_semi"))
        rows = own(buildings).withColumnRenamed("id", "building_id")
        drop = [c for c in ("kind", "x0", "y0", "x1", "y1") if c in rows.columns]
        return polygon_road_distance(rows, own(roads)).drop(*drop).withColumnRenamed("building_id", "id")

    return make


def building_azimuths(spark: SparkSession, distances: str) -> Callable[[DataFrame], DataFrame]:
    """A step for ``run_group``: what the step before wrote, with the direction of each footprint."""
    return lambda todo: spark.read.parquet(distances).join(todo, "city", "left_semi").withColumn("azimuth", rectangle_azimuth("geometry"))


def preprocess(spark: SparkSession, cities: DataFrame, buildings: str, roads: str, distances: str, azimuths: str) -> DataFrame:
    """Distances for the cities that lack them, then directions for all that have distances, anew each time. Returns
    (city, status, distances_skipped, error): ``ok``, ``error``, or ``missing_inputs`` without buildings or roads."""
    first = staged(run_group(spark, cities, building_distances(spark, buildings, roads), distances, inputs=[buildings, roads]))
    second = run_group(spark, cities, building_azimuths(spark, distances), azimuths, inputs=[distances], again=True)
    both = first.join(second.select("city", F.col("status").alias("then"), F.col("error").alias("then_error")), "city")
    status = F.when(F.col("then") == "ok", "ok").when(F.col("status") == "missing_input", "missing_inputs").otherwise("error")
    return both.select("city", status.alias("status"), (F.col("status") == "done").alias("distances_skipped"), F.coalesce("error", "then_error").alias("error"))


def gather(spark: SparkSession, cities: DataFrame, layers: dict[str, Callable[[DataFrame], DataFrame]], out: str) -> DataFrame:
    """Every layer for the cities that lack it, under ``out``; then (city, status, missing) as of ``gather_status``."""
    for name, make in layers.items():
        staged(run_group(spark, cities, make, f"{out}/{name}"))
    names = spark.createDataFrame([(n,) for n in layers], "layer string")
    found = [cities_with(spark, f"{out}/{n}").where("n_rows > 0").select("city", F.lit(n).alias("layer")) for n in layers]
    have = found[0]
    for f in found[1:]:
        have = have.unionByName(f)
    return gather_status(cities.select("city").distinct().crossJoin(F.broadcast(names)), have)  # a handful of layers


def record(statuses: DataFrame, path: str) -> None:
    """A run's statuses as lines of JSON, under the time that it ended."""
    at = F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
    statuses.withColumn("utc_end", at).write.mode("append").json(path)


def gather_status(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(city, status, missing): OK, PARTIAL or FAIL, from the layers that a city should have (city, layer) and has."""
    both = expected.join(found.select("city", "layer").distinct().withColumn("has", F.lit(1)), ["city", "layer"], "left")
    out = both.groupBy("city").agg(F.count("has").alias("n"), F.count("*").alias("of"), F.array_sort(F.collect_set(F.when(F.col("has").isNull(), F.col("layer")))).alias("missing"))
    status = F.when(F.col("n") == F.col("of"), "OK").when(F.col("n") > 0, "PARTIAL").otherwise("FAIL")
    return out.select("city", status.alias("status"), F.array_join("missing", ", ").alias("missing"))
