"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted by its
place, by elementwise product; a text's vector bundles (adds) its n-grams' vectors, and a language's prototype
bundles its training texts' unit vectors. A text gets the language whose prototype has the largest cosine with it.

Letters are the code points that Unicode calls letters, in lower case; a run of anything else is one gap, which is a
symbol as well, and so is the gap before and after a text. The n-grams of a batch of texts are counted first, and one
matrix product of counts and n-gram vectors bundles them: exactly the sum over all n-grams of the whole text, each
n-gram by the square root of its count, so that a line said a thousand times does not drown the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import SPACE, int_seed, parts, slices, table, with_text

GAP = 0
PLACES = 1 << 7  # symbols: the gap and 127 classes of letters, 26 + 101


def letter_classes() -> np.ndarray:
    """The symbol of each code point: a to z have their own, other letters share 101 by a hash."""
    points = np.arange(0x110000, dtype=np.int64)
    symbol = np.zeros(len(points), np.uint8)
    lower = {}
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            lower[p] = ord(low[0])
    at = np.fromiter(lower.keys(), np.int64)
    low = np.fromiter(lower.values(), np.int64)
    plain = (low >= 97) & (low <= 122)
    symbol[at] = np.where(plain, low - 96, 27 + (low * 2_654_435_761 % (1 << 32)) % 101)
    return symbol


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        _classes.append(letter_classes())
    return _classes[0]


def symbols(text: str) -> np.ndarray:
    """Symbols of a text with single gaps, one at either end; empty if the text has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    s = classes()[points]
    if not s.any():
        return s[:0]
    s = np.concatenate(([GAP], s, [GAP]))
    keep = np.append(True, (s[1:] != GAP) | (s[:-1] != GAP))
    return s[keep]


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """The codes of the n-grams of symbols; all of them as one, shorter, if there are fewer."""
    s = s.astype(np.int64)
    if not len(s):
        return s
    if len(s) < n:
        s = np.append(s, np.zeros(n - len(s), np.int64))
    code = np.zeros(len(s) - n + 1, np.int64)
    for i in range(n):
        code = code * PLACES + s[i : len(s) - n + 1 + i]
    return code


def gram_counts(text: str, n: int, size: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and their numbers. A long text is read in parts; each takes up the last symbols
    of the one before, whose gap at the end is its own at the start."""
    if len(text) <= size:
        return np.unique(grams(symbols(text), n), return_counts=True)
    total: dict[int, int] = {}
    tail, started = np.empty(0, np.uint8), False
    for part in slices(text, SPACE, size):
        s = symbols(part)
        if len(s):
            s = np.concatenate((tail, s[1:])) if started else s
            codes, counts = np.unique(grams(s, n), return_counts=True) if len(s) >= n else ((), ())
            for c, k in zip(map(int, codes), map(int, counts)):
                total[c] = total.get(c, 0) + k
            tail, started = (s[-(n - 1) :] if n > 1 else s[:0]), True
    if not total and len(tail):
        return np.unique(grams(tail, n), return_counts=True)
    codes = np.array(sorted(total), np.int64)
    return codes, np.array([total[c] for c in codes.tolist()], np.int64)


@dataclass
class Space:
    """Random letter vectors of ``dim`` dimensions, the same in every process for a seed."""

    dim: int = 2_048
    n: int = 3
    seed: int = 11
    _letters: np.ndarray | None = field(default=None, repr=False)

    @property
    def letters(self) -> np.ndarray:
        """One table per place in the n-gram: the letter vectors rolled by that place."""
        if self._letters is None:
            base = np.random.default_rng(int_seed("letters", self.seed)).choice(np.array([-1, 1], np.float32), (PLACES, self.dim))
            self._letters = np.stack([np.roll(base, self.n - 1 - i, axis=1) for i in range(self.n)])
        return self._letters

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of n-gram codes."""
        out = np.ones((len(codes), self.dim), np.float32)
        for i in range(self.n):
            out *= self.letters[i][(codes >> (7 * (self.n - 1 - i))) & (PLACES - 1)]
        return out

    def bundle(self, texts: list[str], at_once: int = 1_024) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of texts (zero for one without letters), and their numbers of n-grams."""
        found = [gram_counts(t, self.n) for t in texts]
        sizes = np.array([int(k.sum()) for _, k in found])
        codes, inverse = np.unique(np.concatenate([c for c, _ in found]) if found else np.empty(0, np.int64), return_inverse=True)
        order = np.argsort(inverse, kind="stable")  # by n-gram, so that each block of them is a slice
        at_gram = inverse[order]
        doc = np.repeat(np.arange(len(texts)), [len(c) for c, _ in found])[order]
        root = np.sqrt(np.concatenate([k for _, k in found])[order].astype(np.float32)) if found else np.empty(0, np.float32)
        out = np.zeros((len(texts), self.dim), np.float32)
        for at in range(0, len(codes), at_once):
            lo, hi = np.searchsorted(at_gram, (at, at + at_once))
            block = np.zeros((len(texts), min(at_once, len(codes) - at)), np.float32)
            block[doc[lo:hi], at_gram[lo:hi] - at] = root[lo:hi]
            out += block @ self.bind(codes[at : at + at_once])
        norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))
        return (out / np.maximum(norm, 1e-9)[:, None]).astype(np.float32), sizes

    def groups(self, texts: list[str], chars: int = 400_000, most: int = 64) -> Iterator[tuple[int, int]]:
        """Ranges of texts to bundle together: bounded in number and, but for a single text, in size."""
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and (size + len(t) > chars or i - start >= most):
                yield start, i
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield start, len(texts)


@dataclass
class Profiles:
    """Language prototypes as unit vectors. Bounded by the number of languages."""

    space: Space
    langs: list[str]
    vectors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and cosine of the best prototype of each text.

        The score is a softmax of the cosines, sharpened by the length of the text; in (0, 1], and 0 for ``und``.
        """
        langs, scores, best = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        clean = [t or "" for t in texts]
        if not self.langs:
            return langs, scores, best
        for a, b in self.space.groups(clean):
            v, sizes = self.space.bundle(clean[a:b])
            cos = v.astype(np.float64) @ self.vectors.T
            top = cos.argmax(axis=1)
            sharp = 10 * np.sqrt(np.minimum(sizes, 400))[:, None]
            p = np.exp((cos - cos.max(axis=1, keepdims=True)) * sharp)
            p = p.max(axis=1) / p.sum(axis=1)
            for i in np.flatnonzero(sizes):
                langs[a + i], scores[a + i], best[a + i] = self.langs[top[i]], p[i], cos[i, top[i]]
        return langs, scores, best


def train(labelled: DataFrame, space: Space, per_lang: int = 4_000, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes from rows with a text and a language, at most ``per_lang`` texts of each, chosen by a hash of the
    text alone; equal texts of a language count once. Rows with a null text or language are not learned from; no rows
    give no languages."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles(space, [], np.empty((0, space.dim)))
    spark = labelled.sparkSession
    scale = 10**12
    shares = spark.createDataFrame([(x, min(scale, -(-per_lang * scale // n))) for x, n in counts.items()], "lang string, share long")
    some = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text"), F.lit(scale)) < F.col("share")).select("text", "lang")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    some = some.dropDuplicates(["lang", "text"]).withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= per_lang).select("text", "lang")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in parts(batches, "langid"):
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for x, y in space.groups(texts):
                v, _ = space.bundle(texts[x:y])
                for lang in set(langs[x:y]):
                    total[lang] = total.get(lang, 0) + v[langs[x:y] == lang].astype(np.float64).sum(axis=0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()])], names=["lang", "v"])

    # Sums over dimensions meet in Spark, so that the driver gets one row for each language.
    sums = (
        some.mapInArrow(add, "lang string, v array<double>")
        .select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("lang", F.col("v.x").alias("v"))
    )
    found = sorted((r.lang, r.v) for r in sums.collect())
    vectors = np.array([v for _, v in found])
    return Profiles(space, [x for x, _ in found], vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-9))


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of each row with lang_pred, score and lang_cosine, from the whole text alone.

    Defined results: ``und``, score 0 and cosine 0 for a null text, one without a letter, or when no language was
    learned; equal texts get equal results; an empty table stays empty. ``keep`` may not name the added columns.
    """
    sent, text = with_text(docs, keep, text_col)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("lang_cosine", "double")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "langid"):
            langs, scores, cos = profiles.predict(text(b).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores), pa.array(cos)], names=[f.name for f in schema])

    return sent.mapInArrow(tag, schema)


def op2_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose checksum leaves no 2 when divided by 4."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles = train(docs.where(~F.coalesce(held_out, F.lit(False))), Space())
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return identify(rows, profiles, ["doc_id", "held_out"])
