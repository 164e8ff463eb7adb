"""Raw block metrics on a common scale, 0 irregular and 1 planned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import at_least, at_most

# The ranges that each metric's scale is set by.
WIDTH_RANGE = (30.0, 200.0)
FULL_MARKS = {"m2": 100.0, "m3": 80.0, "m5": 324.0, "m10": 4000.0, "m12": 200.0, "k_complexity": 13.0}
LEAST_STRAIGHTNESS = 0.9
RIGHT_ANGLE = 90.0


def _share(metric: str) -> Callable[[Column], Column]:
    return lambda c: at_most(c, FULL_MARKS[metric]) / FULL_MARKS[metric]


def _rest(metric: str) -> Callable[[Column], Column]:
    return lambda c: 1.0 - at_most(c, FULL_MARKS[metric]) / FULL_MARKS[metric]


def _width(c: Column) -> Column:
    low, high = WIDTH_RANGE
    return 1.0 - (at_most(at_least(c, low), high) - low) / (high - low)


STANDARD: dict[str, Callable[[Column], Column]] = {
    "m1": lambda c: c,
    "m2": _rest("m2"),
    "m3": _share("m3"),
    "m4": lambda c: c,
    "m5": _share("m5"),
    "m6": lambda c: c,
    "m7": _width,
    "m8": lambda c: at_least(c, LEAST_STRAIGHTNESS),
    "m9": lambda c: 1.0 - c / RIGHT_ANGLE,
    "m10": _rest("m10"),
    "m11": lambda c: 1.0 - c,
    "m12": _share("m12"),
    "k_complexity": _rest("k_complexity"),
}


def standardize(rows: DataFrame) -> DataFrame:
    """``m_std`` for each ``m_raw`` there is; the complexity's raw column is ``k_complexity`` or ``k_k_complexity``."""
    have = set(rows.columns)
    out = {f"{m}_std": f(F.col(f"{m}_raw").cast("double")) for m, f in STANDARD.items() if f"{m}_raw" in have}
    raw = next((c for c in ("k_complexity", "k_k_complexity") if c in have), None)
    if raw:
        out["k_complexity_std"] = STANDARD["k_complexity"](F.col(raw).cast("double"))
    return rows.withColumns(out) if out else rows
