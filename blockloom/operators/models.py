"""Statistical models of blocks: calibrated elastic-net regression, boosted trees, components, factors, the cascade.

Rows stay in Spark: scaling is two aggregates, folds are hashes of the row, fits are ``pyspark.ml``. What comes to the
driver is coefficients and matrices of features by features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .tables import calibration_error, classify, composites, large_blocks, quartiles_by, roc_auc, threshold_table, value_counts

ALL = [*[f"m{i}_std" for i in range(1, 13)], "k_complexity_std"]
# Which metrics each stage of the cascade reads.
OPEN_SPACE = ["m1_std", "m2_std", "m3_std", "m5_std", "m10_std", "m11_std", "m12_std"]
REGULARITY = [m for m in ALL if m not in ("m10_std", "m11_std", "m12_std")]
COMPOSITE = ["m1_m2_composite", "m3_m7_composite", "m4_std", "m5_std", "m6_std", "m8_std", "m9_std", "k_complexity_std"]
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]


def fold(n: int, keys: list[str], seed: int = 42) -> Column:
    """The fold of a row, 0 to n - 1, by a hash of its key: the same however the rows are dealt."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)).cast("int")


def stratified(rows: DataFrame, n: int, keys: list[str], label: str = "y", seed: int = 42, out: str = "fold__", buckets: int = 1_024) -> DataFrame:
    """``rows`` with a fold, 0 to n - 1: each class dealt in turn in the order of a hash of the key, so that its numbers
    in two folds differ by one at most. A place in that order is one within a bucket of hashes, after the bucket's
    predecessors, whose numbers are ``buckets`` rows a class."""
    hashed = rows.withColumns({"hash__": F.xxhash64(F.lit(seed), *keys), "bucket__": F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets))})
    before = Window.partitionBy(label).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy(label, "bucket__").agg(F.count("*").alias("n__"))
    starts = sizes.select(F.col(label).alias("label__"), F.col("bucket__").alias("at__"), F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("start__"))
    place = F.row_number().over(Window.partitionBy(label, "bucket__").orderBy("hash__", *keys))
    placed = hashed.withColumn("place__", place).join(F.broadcast(starts), (F.col(label) == F.col("label__")) & (F.col("bucket__") == F.col("at__")))
    return placed.withColumn(out, F.pmod(F.col("place__") + F.col("start__"), F.lit(n)).cast("int")).drop("hash__", "bucket__", "label__", "at__", "start__", "place__")


@dataclass
class Scale:
    """Means and population deviations; a constant column is only centred."""

    columns: list[str]
    mean: list[float]
    deviation: list[float]

    @classmethod
    def of(cls, rows: DataFrame, columns: list[str]) -> Scale:
        r = rows.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
        n = len(columns)
        return cls(columns, [x or 0.0 for x in r[:n]], [x or 1.0 for x in r[n:]])

    def vectors(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features``; a row that misses a column has none and is left out."""
        scaled = {f"scaled__{c}": (F.col(c) - m) / s for c, m, s in zip(self.columns, self.mean, self.deviation)}
        whole = rows.na.drop(subset=self.columns).withColumns(scaled)
        return VectorAssembler(inputCols=list(scaled), outputCol="features").transform(whole).drop(*scaled)


def balanced(rows: DataFrame) -> DataFrame | None:
    """Rows with ``y`` and a weight ``w`` that gives both classes the same sum; None where a class is missing."""
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    n = sum(counts.values())
    return rows.withColumn("w", F.when(F.col("y") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0])))


def regression(rows: DataFrame, c: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 100):
    """Elastic-net logistic regression of ``y`` on ``features`` with balanced classes. ``c`` weighs the summed loss, as
    opposed to a penalty on the mean loss; None where a class is missing."""
    weighted = balanced(rows)
    if weighted is None:
        return None
    n = rows.count()
    return LogisticRegression(labelCol="y", weightCol="w", elasticNetParam=l1_ratio, regParam=1 / (c * n), standardization=False, maxIter=max_iter).fit(weighted)


Learner = Callable[[DataFrame], "Callable[[DataFrame], DataFrame] | None"]


def margin(model) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``margin``, the linear score of ``features``."""
    weights, bias = [float(x) for x in model.coefficients], float(model.intercept)

    def add(rows: DataFrame) -> DataFrame:
        parts = F.zip_with(vector_to_array("features"), F.array(*map(F.lit, weights)), lambda x, w: x * w)
        return rows.withColumn("margin", F.aggregate(parts, F.lit(bias), lambda a, x: a + x))

    return add


def linear(rows: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
    """Learn the regression of ``y`` on ``features``; None where a class is missing."""
    model = regression(rows)
    return model and margin(model)


@dataclass
class Line:
    """A fitted regression."""

    coefficients: np.ndarray
    intercept: float


def _sums(lines: np.ndarray, weights: np.ndarray):
    """For blocks of rows, the sums that a step of Newton's method takes, for each fold left out: loss, gradient and
    second derivatives. One row a task."""
    k, d = lines.shape

    def over(batches):
        loss, slope, bend = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = np.frombuffer(data, float).reshape(-1, d + 1)
                fold, y, x = rows[:, 0], rows[:, 1], np.column_stack((rows[:, 2:], np.ones(len(rows))))
                for i in range(k):
                    own = fold != i
                    part, at = x[own], x[own] @ lines[i]
                    w, t = weights[i][y[own].astype(int)], y[own]
                    p = 0.5 * (1 + np.tanh(at / 2))
                    loss[i] += (w * (np.logaddexp(0, at) - t * at)).sum()
                    slope[i] += (w * (p - t)) @ part
                    bend[i] += part.T @ (part * (w * p * (1 - p))[:, None])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.concatenate((loss, slope.ravel(), bend.ravel())).tobytes()], pa.binary())})

    return over


def _step(at: np.ndarray, slope: np.ndarray, bend: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The least point of the quadratic around ``at`` with both penalties, but none on the last: solved for the signs of
    the values that are not 0, which are searched for, so that columns that depend on each other slow nothing."""
    free = np.append(np.zeros(len(at) - 1), 1.0)
    a, b, g1 = bend + np.diag(l2 * (1 - free)), slope - bend @ at, l1 * (1 - free)
    cost = lambda x: x @ a @ x / 2 + b @ x + g1 @ np.abs(x)
    x, most = at.copy(), 1e-10 * max(1.0, np.abs(b).max())
    sign = np.sign(x)
    for _ in range(1_000):
        on = np.flatnonzero((sign != 0) | (free > 0))
        new = np.zeros(len(x))
        new[on] = np.linalg.lstsq(a[np.ix_(on, on)], -(b + g1 * sign)[on], rcond=None)[0]
        # On the way the signs may change: the least of the places where they do, and of the end.
        tries = [new]
        for j in on:
            if free[j] == 0 and x[j] * new[j] < 0:
                y = x + x[j] / (x[j] - new[j]) * (new - x)
                y[j] = 0.0
                tries.append(y)
        x = min(tries, key=cost)
        slope_now = a @ x + b
        sign = np.sign(x)
        if (np.abs(slope_now + g1 * sign)[(x != 0) | (free > 0)] > most).any() and len(tries) > 1:
            continue
        excess = np.where((x == 0) & (free == 0), np.abs(slope_now) - g1, 0.0)
        j = int(excess.argmax())
        if excess[j] <= most:
            break
        sign[j] = -np.sign(slope_now[j])
    return x


def regressions(data: DataFrame, n: int, c: float = 1.0, l1_ratio: float = 0.5, steps: int = 100) -> list[Line | None]:
    """The regressions (``regression``) of ``data`` without each of its ``n`` folds, all in the same passes: Newton steps
    with both penalties, a pass each, until no coefficient moves. The passes read blocks of rows as numbers."""
    found = {(r.fold__, r.y): r.n for r in data.groupBy("fold__", "y").agg(F.count("*").alias("n")).collect()}
    counts = np.array([[sum(m for (f, y), m in found.items() if f != k and y == t) for t in (0, 1)] for k in range(n)], float)
    use = [k for k in range(n) if counts[k].min() > 0]
    out: list[Line | None] = [None] * n
    if not use:
        return out

    def pack(batches):
        for b in batches:
            fold, y, x = (b.column(i) for i in range(3))
            rows = np.column_stack((fold.to_numpy(False), y.to_numpy(False), x.flatten().to_numpy(False).reshape(len(fold), -1))).astype(float)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([rows.tobytes()], pa.binary())})

    blocks = data.select("fold__", "y", vector_to_array("features").alias("x")).mapInArrow(pack, "rows binary").persist()
    try:
        d = len(data.select("features").first().features) + 1
        total = counts.sum(axis=1)
        weights = np.array([[total[k] / (2 * counts[k, t]) if k in use else 0.0 for t in (0, 1)] for k in range(n)])
        l1, l2 = l1_ratio / c, (1 - l1_ratio) / c  # of the summed loss

        def price(x: np.ndarray) -> float:
            return l1 * np.abs(x[:-1]).sum() + l2 / 2 * (x[:-1] ** 2).sum()

        now, best, kept = np.zeros((n, d)), [np.inf] * n, np.zeros((n, d))
        way, share, open_ = np.zeros((n, d)), np.ones(n), set(use)
        for _ in range(steps):
            parts = [np.frombuffer(r.sums, float) for r in blocks.mapInArrow(_sums(now, weights), "sums binary").collect()]
            sums = np.sum(parts, axis=0)
            loss, slope, bend = sums[:n], sums[n : n + n * d].reshape(n, d), sums[n + n * d :].reshape(n, d, d)
            for k in sorted(open_):
                cost = loss[k] + price(now[k])
                if cost > best[k] * (1 + 1e-12):  # too far: half the way
                    share[k] /= 2
                    now[k] = kept[k] + share[k] * way[k]
                else:
                    best[k], kept[k], share[k] = cost, now[k].copy(), 1.0
                    way[k] = _step(now[k], slope[k], bend[k], l1, l2) - now[k]
                    now[k] = kept[k] + way[k]
                if share[k] * np.abs(way[k]).max() <= 1e-9 * max(1.0, np.abs(kept[k]).max()):
                    open_.remove(k)
            if not open_:
                break
    finally:
        blocks.unpersist()
    for k in use:
        out[k] = Line(kept[k][:-1], float(kept[k][-1]))
    return out


def trees(rounds: int = 200, depth: int = 6) -> Learner:
    """A learner of boosted trees with balanced classes, whose margin is the trees' sum."""

    def learn(rows: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
        weighted = balanced(rows)
        if weighted is None:
            return None
        model = GBTClassifier(labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=42).fit(weighted)
        return lambda df: model.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")

    return learn


@dataclass
class Calibrated:
    """The mean of pairs of a model and the isotonic curve fitted on the rows that it has not seen."""

    scale: Scale
    pairs: list[tuple[Callable[[DataFrame], DataFrame], list[float], list[float]]]

    def transform(self, rows: DataFrame, out: str = "p") -> DataFrame:
        """``rows`` with the probability; NULL where a feature is missing."""
        whole = F.lit(True)
        for c in self.scale.columns:
            whole = whole & F.col(c).isNotNull()
        has = self.scale.vectors(rows)
        names = []
        for k, (add, xs, ys) in enumerate(self.pairs):
            has = add(has).withColumn(f"p__{k}", interpolate(F.col("margin"), xs, ys)).drop("margin")
            names.append(F.col(f"p__{k}"))
        mean = sum(names[1:], names[0]) / len(names) if names else F.lit(None).cast("double")
        scored = has.withColumn(out, mean).drop("features", *[f"p__{k}" for k in range(len(names))])
        return scored.unionByName(rows.where(~whole).withColumn(out, F.lit(None).cast("double")))


def interpolate(x: Column, xs: list[float], ys: list[float], most: int = 16) -> Column:
    """The value at ``x`` of the line through the knots, flat beyond them. A curve of more than ``most`` knots is looked
    up in arrays outside the plan, by the same sums."""
    if len(xs) == 1:
        return F.when(x.isNotNull(), F.lit(float(ys[0])))
    if len(xs) > most:
        return _curve(np.array(xs, float), np.array(ys, float))(x)
    ax, ay = F.array(*map(F.lit, map(float, xs))), F.array(*map(F.lit, map(float, ys)))
    i = F.size(F.filter(ax, lambda k: k <= x))
    lo = F.least(F.greatest(i - 1, F.lit(0)), F.lit(len(xs) - 2))
    x0, x1, y0, y1 = F.get(ax, lo), F.get(ax, lo + 1), F.get(ay, lo), F.get(ay, lo + 1)
    t = F.coalesce((x - x0) / F.nullif(x1 - x0, F.lit(0.0)), F.lit(0.0))
    t = F.when(t < 0, F.lit(0.0)).when(t > 1, F.lit(1.0)).otherwise(t)
    return F.when(x.isNotNull(), y0 + t * (y1 - y0))


def _curve(xs: np.ndarray, ys: np.ndarray) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def at(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        lo = np.clip(np.searchsorted(xs, v, side="right") - 1, 0, len(xs) - 2)
        wide = xs[lo + 1] - xs[lo]
        t = np.clip(np.divide(v - xs[lo], wide, out=np.zeros(len(v)), where=wide != 0), 0, 1)
        return pd.Series(ys[lo] + t * (ys[lo + 1] - ys[lo])).where(x.notna().to_numpy(), None)

    return at


def knots(xs: list[float], ys: list[float]) -> tuple[list[float], list[float]]:
    """The knots without those within a flat run, which change no value."""
    keep = [i for i in range(len(xs)) if i in (0, len(xs) - 1) or not ys[i - 1] == ys[i] == ys[i + 1]]
    return [xs[i] for i in keep], [ys[i] for i in keep]


def calibrated(rows: DataFrame, columns: list[str], keys: list[str], cv: int = 5, seed: int = 42, learn: Learner = linear) -> Calibrated:
    """Fit on rows with ``y``: scale on all, then a pair for each of ``cv`` folds, in which the classes have equal shares."""
    scale = Scale.of(rows, columns)
    data = stratified(scale.vectors(rows).select(*keys, "features", "y"), cv, keys, seed=seed).persist()
    pairs = []
    lines = [model and margin(model) for model in regressions(data, cv)] if learn is linear else None
    for k in range(cv):
        add = lines[k] if lines else learn(data.where(F.col("fold__") != k))
        held = data.where(F.col("fold__") == k)
        if add is None or held.select("y").distinct().count() < 2:
            continue
        curve = IsotonicRegression(featuresCol="margin", labelCol="y").fit(add(held).select("margin", F.col("y").cast("double")))
        pairs.append((add, *knots([float(x) for x in curve.boundaries], [float(y) for y in curve.predictions])))
    data.unpersist()
    return Calibrated(scale, pairs)


def out_of_fold(data: DataFrame, columns: list[str], keys: list[str], outer: int = 5, inner: int = 3, learn: Learner = linear) -> DataFrame | None:
    """(y, p): the calibrated probability of each row by a model that has not seen its fold; None if none can be fitted."""
    dealt, found = stratified(data, outer, keys, seed=7, out="part__").persist(), None
    for k in range(outer):
        model = calibrated(dealt.where(F.col("part__") != k), columns, keys, inner, 11, learn)
        if model.pairs:
            scored = model.transform(dealt.where(F.col("part__") == k)).select("y", "p")
            found = scored if found is None else found.unionByName(scored)
    return found


def quality(scored: DataFrame) -> tuple[float | None, float | None, float | None]:
    """Area under the curve, Brier score and calibration error of (y, p)."""
    c = calibration_error(scored, "y", "p").first()
    return roc_auc(scored, "y", "p").first().auc, c.brier, c.ece


@dataclass
class Stage:
    """What evaluating a stage gives: the model for scoring, and small tables."""

    name: str
    model: Calibrated
    coefficients: list[dict]
    aucs: list[float]
    auc: float | None
    brier: float | None
    ece: float | None
    thresholds: list[dict]
    fits: np.ndarray = field(repr=False)


def evaluate_stage(rows: DataFrame, columns: list[str], target: str, positive: str, name: str, keys: list[str], n_splits: int = 10, n_repeats: int = 5, outer: int = 5, inner: int = 3) -> Stage:
    """Repeated folds for coefficients, calibrated out-of-fold probabilities for scores, and a model of all rows."""
    data = rows.select(*keys, *columns, target).na.drop(subset=[*columns, target]).withColumn("y", (F.col(target) == positive).cast("int")).persist()
    scale = Scale.of(data, columns)
    vectors = scale.vectors(data).select(*keys, "features", "y").persist()
    fits, aucs = [], []
    for repeat in range(n_repeats):
        dealt = stratified(vectors, n_splits, keys, seed=42 + repeat).persist()
        for k in range(n_splits):
            model = regression(dealt.where(F.col("fold__") != k))
            if model is None:
                continue
            fits.append(np.array(model.coefficients))
            scored = margin(model)(dealt.where(F.col("fold__") == k)).select("y", (1 / (1 + F.exp(-F.col("margin")))).alias("p"))
            area = roc_auc(scored, "y", "p").first().auc
            if area is not None:
                aucs.append(area)
        dealt.unpersist()
    vectors.unpersist()
    scored = out_of_fold(data, columns, keys, outer, inner)
    table: list[dict] = []
    auc = brier = ece = None
    if scored is not None:
        scored = scored.persist()
        auc, brier, ece = quality(scored)
        table = [r.asDict() for r in threshold_table(scored, "y", "p", THRESHOLDS).collect()]
        scored.unpersist()
    final = calibrated(data, columns, keys, 5)
    data.unpersist()
    return Stage(name, final, coefficient_table(columns, fits), aucs, auc, brier, ece, table, np.array(fits))


def coefficient_table(columns: list[str], fits: list[np.ndarray]) -> list[dict]:
    """Mean, population deviation and 95 % range of each coefficient over fits, its share of non-zero values, how
    stable its sign is, and mean over standard error; the largest first."""
    if not fits:
        return []
    a = np.array(fits)
    out = []
    for i, c in enumerate(columns):
        x = a[:, i]
        share = max((x > 0).mean(), (x < 0).mean())
        error = x.std(ddof=1) / np.sqrt(len(x)) if len(x) > 1 else 0.0
        out.append({
            "metric": c, "mean": float(x.mean()), "std": float(x.std()), "low": float(np.percentile(x, 2.5)), "high": float(np.percentile(x, 97.5)),
            "nonzero": float((np.abs(x) > 1e-6).mean()), "sign": "YES" if share == 1 else "mostly" if share > 0.9 else "NO", "t": float(x.mean() / error) if error > 0 else None,
        })
    return sorted(out, key=lambda r: -abs(r["mean"]))


def boosted(rows: DataFrame, columns: list[str], target: str, positive: str, keys: list[str], rounds: int = 200, depth: int = 6, repeats: int = 10, outer: int = 5, inner: int = 3) -> dict:
    """Boosted trees with balanced classes: area under the curve and Brier score of calibrated out-of-fold
    probabilities, and, for a model of all rows, how much of its area shuffling each feature costs."""
    data = rows.select(*keys, *columns, target).na.drop().withColumn("y", (F.col(target) == positive).cast("int")).persist()
    learn = trees(rounds, depth)
    scored = out_of_fold(data, columns, keys, outer, inner, learn)
    scored = scored and staged(scored)  # read several times
    auc, brier, _ = quality(scored) if scored is not None else (None, None, None)
    vectors = Scale.of(data, columns).vectors
    add = learn(vectors(data))

    def area(df: DataFrame) -> float | None:
        # Written, so that the curve's steps do not shuffle the column and score all rows again.
        scored = add(vectors(df)).select("y", (1 / (1 + F.exp(-2 * F.col("margin")))).alias("p"))
        return roc_auc(staged(scored), "y", "p").first().auc

    whole = area(data) if add else None
    importance = {}
    for c in columns if add else []:
        drops = []
        for seed in range(repeats):
            # Each value goes to the next row of a random order, within random groups: a shuffle without one sorted task.
            group = Window.partitionBy(fold(64, keys, seed)).orderBy(F.xxhash64(F.lit(seed + 1_000), *keys))
            first = F.first(c).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            score = area(data.withColumn(c, F.coalesce(F.lead(c).over(group), first)))
            drops.append((whole or 0) - (score or 0))
        importance[c] = (float(np.mean(drops)), float(np.std(drops)))
    data.unpersist()
    return {"auc": auc, "brier": brier, "importance": importance}


def compare_models(linear_stage: Stage, tree: dict, close: float = 0.02) -> dict:
    """The two kinds of model side by side; the linear one is enough where the trees gain less than ``close``."""
    gain = None if linear_stage.auc is None or tree["auc"] is None else tree["auc"] - linear_stage.auc
    return {
        "auc_linear": linear_stage.auc, "brier_linear": linear_stage.brier, "ece_linear": linear_stage.ece, "auc_trees": tree["auc"], "brier_trees": tree["brier"],
        "difference": gain, "linear_is_enough": None if gain is None else abs(gain) < close, "importance": tree["importance"],
    }


def full_analysis(rows: DataFrame, keys: list[str], target: str = "subdivisions_settlements", positive: str = "subdivision", factors_of: int = 3, rounds: int = 200, **options) -> dict:
    """All analyses of labelled blocks in one run: correlations with components, factors, both variants of the stage,
    the order in which metrics enter, and trees against the linear model."""
    data = rows.na.drop(subset=[*ALL, target])
    stage = evaluate_stage(data, REGULARITY, target, positive, "regularity", keys, **options)
    tree = boosted(data, REGULARITY, target, positive, keys, rounds=rounds, repeats=options.get("n_repeats", 10), outer=options.get("outer", 5), inner=options.get("inner", 3))
    return {
        "components": components(data, ALL), "factors": factors(data, ALL, factors_of), "variants": compare_variants(data, target, positive, keys, **options),
        "path": regularization_path(data, ALL, target, positive), "stage": stage, "comparison": compare_models(stage, tree),
    }


def regularization_path(rows: DataFrame, columns: list[str], target: str, positive: str, n: int = 60) -> list[dict]:
    """For each metric the least C, of ``n`` from 0.001 to 100, at which its coefficient is not zero: who enters first."""
    data = rows.select(*columns, target).na.drop().withColumn("y", (F.col(target) == positive).cast("int"))
    vectors = Scale.of(data, columns).vectors(data).select("features", "y").persist()
    entered: dict[str, float] = {}
    for c in np.logspace(-3, 2, n):
        model = regression(vectors, float(c), 1.0)
        for name, w in zip(columns, model.coefficients if model else []):
            if abs(w) > 1e-6:
                entered.setdefault(name, float(c))
        if len(entered) == len(columns):
            break
    vectors.unpersist()
    return [{"metric": m, "enters_at": c, "place": i + 1} for i, (m, c) in enumerate(sorted(entered.items(), key=lambda x: (x[1], x[0])))]


def correlations(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """The matrix of correlations over whole rows, in one aggregation, and their number."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = rows.na.drop(subset=columns).agg(F.count("*"), *[F.corr(a, b) for a, b in pairs]).first()
    m = np.eye(len(columns))
    for (a, b), x in zip(pairs, r[1:]):
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = 0.0 if x is None else x
    return m, r[0]


def components(rows: DataFrame, columns: list[str], draws: int = 100, seed: int = 42) -> dict:
    """Eigenvalues, shares and loadings of the correlations, and how many exceed the 95th percentile of those of random
    data of the same size. Such a random matrix is drawn as a whole (Bartlett's decomposition), not from rows."""
    m, n = correlations(rows, columns)
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors.sum(axis=0) < 0, -1, 1)
    rng, p, random = np.random.default_rng(seed), len(columns), []
    for _ in range(draws):
        low = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(np.maximum(1, n - 1 - np.arange(p)))))
        w = low @ low.T
        d = np.sqrt(np.diag(w))
        random.append(np.linalg.eigvalsh(w / np.outer(d, d))[::-1])
    limit = np.percentile(random, 95, axis=0)
    above = values > limit
    return {
        "eigenvalues": values, "share": values / p, "cumulative": np.cumsum(values) / p, "loadings": vectors * np.sqrt(np.maximum(values, 0)), "random": limit,
        "n_retain": int(p if above.all() else np.argmin(above)), "n_kaiser": int((values > 1).sum()),
    }


def sphericity(m: np.ndarray, n: int) -> dict:
    """Bartlett's statistic and its degrees of freedom, and the Kaiser-Meyer-Olkin measure, whole and by column."""
    p = len(m)
    _, log = np.linalg.slogdet(m)
    inverse = np.linalg.pinv(m)
    d = np.sqrt(np.diag(inverse))
    partial = -inverse / np.outer(d, d)
    off = ~np.eye(p, dtype=bool)
    r2, q2 = np.where(off, m**2, 0), np.where(off, partial**2, 0)
    return {"chi_square": float(-(n - 1 - (2 * p + 5) / 6) * log), "df": p * (p - 1) // 2, "kmo": float(r2.sum() / (r2.sum() + q2.sum())), "kmo_each": r2.sum(axis=1) / (r2.sum(axis=1) + q2.sum(axis=1))}


def factors(rows: DataFrame, columns: list[str], k: int, steps: int = 500, power: int = 4) -> dict:
    """Maximum-likelihood factors by expectation and maximisation on the correlations, turned by promax."""
    m, n = correlations(rows, columns)
    values, vectors = np.linalg.eigh(m)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-6))
    unique = np.clip(1 - (load**2).sum(axis=1), 0.05, 1)
    for _ in range(steps):
        inner = np.linalg.inv(np.eye(k) + (load.T / unique) @ load)
        beta = inner @ (load.T / unique)
        both = m @ beta.T
        load = both @ np.linalg.inv(inner + beta @ both)
        unique = np.clip(np.diag(m - load @ both.T), 1e-3, 1)
    turn, total = np.eye(k), 0.0
    for _ in range(200):  # varimax
        x = load @ turn
        u, s, v = np.linalg.svd(load.T @ (x**3 - x @ np.diag((x**2).mean(axis=0))))
        turn = u @ v
        if s.sum() < total * (1 + 1e-9):
            break
        total = s.sum()
    x = load @ turn
    target = x * np.abs(x) ** (power - 1)
    oblique = np.linalg.lstsq(x, target, rcond=None)[0]
    oblique = oblique * np.sqrt(np.diag(np.linalg.inv(oblique.T @ oblique)))
    pattern, phi = x @ oblique, np.linalg.inv(oblique.T @ oblique)
    strong = np.abs(pattern)
    return {
        "loadings": pattern, "factor_correlations": phi, "communalities": 1 - unique, "dominant": strong.argmax(axis=1).tolist(),
        "cross_loading": ((strong > 0.3).sum(axis=1) > 1).tolist(), **sphericity(m, n),
    }


def compare_variants(rows: DataFrame, target: str, positive: str, keys: list[str], **options) -> list[dict]:
    """The stage with all metrics and with those of regularity: areas and coefficients of both."""
    out = []
    for name, columns in (("all", ALL), ("regularity", REGULARITY)):
        s = evaluate_stage(rows, columns, target, positive, name, keys, **options)
        out.append({"variant": name, "n_features": len(columns), "auc": s.auc, "mean_auc": float(np.mean(s.aucs)) if s.aucs else None, "coefficients": s.coefficients})
    return out


def open_space(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many blocks are built up, and quartiles of the three raw densities by class."""
    return value_counts(rows, "built_vs_open"), quartiles_by(rows, ["built_vs_open"], ["n_buildings", "m10_raw", "m11_raw"])


def run_cascade(rows: DataFrame, keys: list[str], **options) -> dict[str, Stage]:
    """The stages, each on the blocks that the one before leaves: built up, residential, subdivision (with metrics, and
    with composites), formal. A stage whose label is not there is left out."""
    have = set(rows.columns)
    built = rows.where("built_vs_open = 'built_up'")
    homes = built.where("residential = 'residential'") if "residential" in have else built
    planned = homes.where("subdivisions_settlements = 'subdivision'") if "subdivisions_settlements" in have else homes
    plan = [
        ("stage1", rows, OPEN_SPACE, "built_vs_open", "built_up"), ("stage2", built, ALL, "residential", "residential"),
        ("stage3_reg", homes, REGULARITY, "subdivisions_settlements", "subdivision"), ("stage3_comp", composites(homes), COMPOSITE, "subdivisions_settlements", "subdivision"),
        ("stage4", planned, REGULARITY, "formal_informal_subdivisions", "formal_subdivisions"),
    ]
    return {name: evaluate_stage(data, columns, target, positive, name, keys, **options) for name, data, columns, target, positive in plan if target in have}


def score_blocks(blocks: DataFrame, stages: dict[str, Stage], subdivision: float = 0.8) -> DataFrame:
    """All cities' blocks of 700 square metres or more with the stages' probabilities, class and index."""
    out = large_blocks(blocks)
    for name, column in (("stage1", "p_built"), ("stage2", "p_residential"), ("stage3_reg", "p_subdivision"), ("stage4", "p_formal")):
        out = stages[name].model.transform(out, column) if name in stages else out.withColumn(column, F.lit(None).cast("double"))
    return classify(out, subdivision)
