"""Column functions with one meaning for missing values: NULL. NaN becomes NULL at ingest, division by zero is NULL,
and caps leave NULL alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """A double, NaN and infinities as NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def at_most(c: Column, top: float) -> Column:
    return F.when(c > top, F.lit(float(top))).otherwise(c)


def at_least(c: Column, low: float) -> Column:
    return F.when(c < low, F.lit(float(low))).otherwise(c)


def bin_of(c: Column, low: float, high: float, bins: int) -> Column:
    """The number of the equal bin over [low, high], the last one closed on both sides; NULL outside."""
    inside = (c >= low) & (c <= high)
    return F.when(inside, F.least(F.floor((c - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int"))


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees from the x axis, counter-clockwise, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def histogram_divergence(rows: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int, out: str) -> DataFrame:
    """Per group the divergence of the histogram of ``value`` from uniform, over its maximum ``ln(bins)``; NULL for a
    group without a value in the range. Two aggregations, the first of at most ``bins`` rows a group and task."""
    counts = rows.withColumn("bin", bin_of(F.col(value), low, high, bins)).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    # With p = n / N: sum p ln(p * bins) = (sum n ln n) / N - ln N + ln bins.
    sums = counts.groupBy(*keys).agg(F.sum("n").cast("double").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"))
    value_ = (F.col("nlogn") / F.col("total") - F.ln("total") + F.lit(math.log(bins))) / F.lit(math.log(bins))
    return sums.select(*keys, value_.alias(out))


def fill_median(rows: DataFrame, keys: list[str], columns: dict[str, float]) -> DataFrame:
    """Missing values of each column replaced by the exact median of its group, else by the given value. One
    aggregation for all columns; groups are cities, so the joined side has one row for each."""
    medians = rows.groupBy(*keys).agg(*[F.percentile(F.col(c), 0.5).alias(f"median__{c}") for c in columns])
    out = rows.join(medians, keys, "left")
    for c, default in columns.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"median__{c}"), F.lit(float(default))))
    return out.drop(*[f"median__{c}" for c in columns])


def row_mean(columns: list[Column]) -> Column:
    """The mean over a row's values that are not NULL; NULL without any."""
    here = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return ratio(F.aggregate(here, F.lit(0.0), lambda a, x: a + x), F.size(here))
