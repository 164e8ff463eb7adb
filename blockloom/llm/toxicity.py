"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained from confirmed toxic texts (P) and unlabelled texts (U) alone. With the class prior
``p``, the risk on the negatives is estimated as ``E_U[loss(-)] - p E_P[loss(-)]``; that estimate is kept from going
negative, as it would once the model fits the positives among the unlabelled: a step that makes it negative is undone
by ascending it instead (Kiryo et al., 2017).

Features are the distinct words and runs of marks of a text, and the beginnings of its words, as 32-bit hashes.
Weights are fitted for
a bounded number of features: those whose counts in P and U speak most clearly against equal rates. Copies and near
copies among the training texts count once. Three models are fitted, each without a third of the rows; their mean is
the classifier, and the margins that each gives to the rows it has not seen place the threshold, where recall on P
squared over the share of U is largest (Lee and Liu, 2003), which needs no negative label either.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACE, parts, release, slices, table, with_text

TOKEN = re.compile(r"\w+|[^\w\s]+")
HEADS = (4, 5, 6)


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    return (zlib.crc32(word.encode("utf-8", "surrogatepass")), *(zlib.crc32(b"<" + word[:n].encode("utf-8", "surrogatepass")) for n in HEADS if len(word) > n))


def words(text: str) -> set[str]:
    """The distinct words and runs of marks of a text, which is read in bounded parts."""
    found: set[str] = set()
    for part in slices(text, SPACE):
        found.update(TOKEN.findall(part.lower()))
    return found


def features(text: str) -> np.ndarray:
    """The distinct features of a text, in ascending order."""
    found = {h for w in words(text) for h in word_features(w)}
    return np.array(sorted(found), np.uint32)


class Known(dict):
    """For each word seen those of its features that have a weight, which are few: mostly none."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        own = self[word] = tuple(h for h in word_features(word) if h in self.weights)
        return own


@dataclass
class Classifier:
    """Bounded: at most ``folds`` times as many weights as ``max_features``."""

    weights: dict[int, float]
    bias: float
    known: Known | None = field(default=None, repr=False)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The bias and the weights of a text's distinct features, added in ascending order of the features."""
        if self.known is None:
            self.known = Known(self.weights)
        known, get = self.known, self.weights.__getitem__
        z = np.empty(len(texts))
        for i, text in enumerate(texts):
            own = set(itertools.chain.from_iterable(map(known.__getitem__, words(text or ""))))
            z[i] = self.bias + sum(map(get, sorted(own)))
        return z

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The estimated chance of each text to be toxic."""
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -500, 500)))


def once(rows: list[np.ndarray]) -> list[np.ndarray]:
    """``rows`` without those whose features have a Jaccard similarity of 0.8 or more with those of a row kept before.

    Rows that similar share one of the rarest fifth and one more of the features of either, so that only rows with one
    of these in common are compared, on all their features.
    """
    if not rows:
        return []
    names, count = np.unique(np.concatenate(rows), return_counts=True)
    rank = np.empty(len(names), np.int32)
    rank[np.lexsort((names, count))] = np.arange(len(names))
    shared = int((count == 1).sum())  # those below are in one row alone, so no other row is found by them
    kept, ranks, sizes, holders = [], [], [], {}
    mine = np.zeros(len(names), bool)
    for f in rows:
        n = len(f)
        r = np.sort(rank[np.searchsorted(names, f)])
        rare = r[: n // 5 + 1]
        rare = rare[rare >= shared].tolist()
        near = set().union(*[holders[h] for h in rare if h in holders])
        mine[r] = True
        copy = any(4 * n <= 5 * sizes[i] and 4 * sizes[i] <= 5 * n and 9 * np.count_nonzero(mine[ranks[i]]) >= 4 * (n + sizes[i]) for i in near)
        mine[r] = False
        if copy:
            continue
        for h in rare:
            holders.setdefault(h, []).append(len(kept))
        kept.append(f)
        ranks.append(r)
        sizes.append(n)
    return kept


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: int, most: int, sure: float) -> np.ndarray:
    """Features in at least ``least`` positives that are more frequent in P than in U, by a log-likelihood ratio that
    among as many features as there are to choose from would rarely arise by chance; the ``most`` strongest."""
    n_p, n_u = len(positive), len(unlabelled)
    names, count = np.unique(np.concatenate(positive), return_counts=True)
    names, count = names[count >= least], count[count >= least].astype(float)
    others, other_count = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(others, names), max(0, len(others) - 1))
    other = np.where(others[at] == names, other_count[at], 0).astype(float) if len(others) else np.zeros(len(names))

    def part(x: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
        r = np.clip(rate, 1e-12, 1 - 1e-12)
        return x * np.log(r) + (n - x) * np.log1p(-r)

    both = (count + other) / (n_p + n_u)
    ratio = part(count, n_p, count / n_p) + part(other, n_u, other / n_u) - part(count, n_p, both) - part(other, n_u, both)
    ratio = np.where(count * n_u > other * n_p, ratio, 0)
    order = np.lexsort((names, -ratio))[:most]
    return np.sort(names[order[ratio[order] > np.log(max(1, len(names))) + sure]])


Sparse = tuple[np.ndarray, np.ndarray, int]


def sparse(rows: list[np.ndarray], names: np.ndarray) -> Sparse:
    """Row numbers and feature numbers of all of ``names`` present, and the number of rows."""
    if not rows or not len(names):
        return np.empty(0, np.int64), np.empty(0, np.int64), len(rows)
    row, have = np.repeat(np.arange(len(rows)), [len(f) for f in rows]), np.concatenate(rows)
    at = np.minimum(np.searchsorted(names, have), len(names) - 1)
    hit = names[at] == have
    return row[hit], at[hit], len(rows)


def margin(x: Sparse, w: np.ndarray, b: float) -> np.ndarray:
    return np.bincount(x[0], w[x[1]], minlength=x[2]) + b


def descend(P: Sparse, U: Sparse, n: int, prior: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights, none negative, and a bias that minimise the non-negative risk, by Adam over all rows."""
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)

    def gradient(x: Sparse, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(x[1], slope[x[0]], minlength=n), slope.sum()) / x[2]

    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        zp, zu = margin(P, w, b), margin(U, w, b)
        sp, su = logistic(zp), logistic(zu)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = gradient(U, su) - prior * gradient(P, sp)
        g = prior * gradient(P, sp - 1) + negative if rest >= 0 else -negative
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(0, w - change[:-1]), b - change[-1]
    return w, b


def fit(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    least: int = 3,
    max_features: int = 4_096,
    sure: float = 2.0,
    steps: int = 200,
    rate: float = 0.1,
    decay: float = 1e-3,
    threshold: float = 0.7,
    folds: int = 3,
) -> Classifier:
    """The mean of ``folds`` models. Without positives or without unlabelled rows nothing is scored as toxic."""
    positive, unlabelled = once(positive), once(unlabelled)
    if len(positive) < folds or len(unlabelled) < folds:
        return Classifier({}, -4.0)
    prior = float(np.clip(prior, 0.001, 0.95))
    zp, zu = np.zeros(len(positive)), np.zeros(len(unlabelled))
    weights, bias = Counter(), 0.0
    for k in range(folds):
        seen = lambda rows: [f for i, f in enumerate(rows) if i % folds != k]
        p, u = seen(positive), seen(unlabelled)
        names = choose(p, u, least, max_features, sure)
        w, b = descend(sparse(p, names), sparse(u, names), len(names), prior, steps, rate, decay)
        zp[k::folds] = margin(sparse(positive[k::folds], names), w, b)
        zu[k::folds] = margin(sparse(unlabelled[k::folds], names), w, b)
        for name, value in zip(names.tolist(), w.tolist()):
            weights[name] += value / folds
        bias += b / folds
    values = np.unique(np.round(np.concatenate((zp, zu)), 6))
    cuts = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values + 4.0
    recall = 1 - np.searchsorted(np.sort(zp), cuts) / len(zp)
    share = np.maximum(1 - np.searchsorted(np.sort(zu), cuts) / len(zu), prior * recall)
    cut = cuts[np.argmax(recall**2 / np.maximum(share, 1e-9))]
    return Classifier({w: x for w, x in weights.items() if x > 1e-6}, float(bias - cut + np.log(threshold / (1 - threshold))))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = 3_000,
    max_unlabelled: int = 9_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Classifier:
    """Learn from ``labels`` (1: confirmed toxic) of the rows given, and from all of ``docs`` as unlabelled texts.

    At most ``max_positive`` toxic texts are read, of ids chosen by their hash before any text is joined, and at most
    ``max_unlabelled`` unlabelled ones, chosen by a hash of the text; equal texts count once. The class prior is the
    share of label 1 among labelled documents. An id with several labels counts as toxic if one of them is 1; null
    ids, texts and labels are not learned from.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0))).first()
    n_texts = texts.where("text is not null").count()
    if not n_toxic or not n_texts:
        return fit([], [], 0.0)
    present = known.where("y = 1").join(texts.select("id"), "id", "left_semi").select("id")
    chosen = present.orderBy(F.xxhash64("id"), "id").limit(max_positive)
    toxic = texts.join(F.broadcast(chosen), "id", "left_semi")  # at most max_positive ids
    scale = 10**12
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(scale)) < min(scale, -(-max_unlabelled * scale // n_texts)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "toxicity"):
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()).tobytes() for t in b.column(0)], pa.binary())], names=["f"])

    def rows(df: DataFrame, most: int) -> list[np.ndarray]:
        once_each = df.where("text is not null").select("text").dropDuplicates()
        found = once_each.mapInArrow(hashed, "f binary").orderBy(F.xxhash64("f"), "f").limit(most).toArrow()["f"]
        return [np.frombuffer(f, np.uint32) for f in sorted(x.as_py() for chunk in found.chunks for x in chunk)]

    model = fit(rows(toxic, max_positive), rows(some, max_unlabelled), n_toxic / n)
    release()
    return model


def score(docs: DataFrame, model: Classifier, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Columns ``keep`` of each row with its toxicity ``score_col``, from the whole text alone.

    Defined results: a null text scores as an empty one; equal texts score alike; an empty table stays empty.
    ``keep`` may not name the added column.
    """
    schema = docs.select(*keep).schema.add(score_col, "double")
    sent, text = with_text(docs, keep, text_col)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "toxicity"):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(model.score(text(b).to_pylist()))], names=[f.name for f in schema])

    return sent.mapInArrow(rate, schema)


THRESHOLD = 0.7


def in_fold(id_col: str) -> Column:
    """Whether a row is held out from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op3_positive_unlabelled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from those whose checksum leaves no 1 when divided by 3."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(~in_fold("doc_id")), labels.where(~in_fold("doc_id")))
    rows = docs.select("doc_id", in_fold("doc_id").alias("held_out"), "text")
    return score(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
