"""Jaccard join of documents on word n-grams, with Bayesian pruning of candidates.

1. Each text becomes its set of hashed five-word shingles, a hash of that set, a MinHash signature and band keys.
   Documents with the same set are copies: one represents them, with their number.
2. Representatives that share a band key are candidates. Within a key they are compared on their signatures a few
   values at a time; with ``m`` of ``n`` equal, the similarity has the posterior Beta(m + 1, n - m + 1), and a pair is
   dropped once the chance that it reaches the threshold is below the tolerance. What survives is kept as a spanning
   forest, a number of edges below the number of members, never as all pairs.
3. The components of these edges hold every pair that may be similar. In each, all pairs whose sizes allow the
   threshold are pruned in the same way and then verified exactly, on whole sets of hashes; links are counted where
   they are found, and again only a forest goes on.
4. Components of verified links are the classes.

A key with up to ``KEY_BLOCKS`` blocks of members is compared block by block, each pair of blocks a task of its own, so
that a member is sent to as many tasks as there are blocks; the members of a larger key are one component unseen, as
they are to be compared there anyway. A component that is more than one block is cut by the size of its sets, so that
only neighbouring sizes meet, and then into blocks of bounded weight. Counting the links of m sets that are all alike
needs m * m comparisons; with blocks of q members each set, not its text, is sent to m / q tasks.

Keys are drawn with 32 bands of 5 values: a pair at the threshold of 0.8 shares none with a probability of 3e-6, and is
dropped by a posterior below ``tolerance`` as rarely. No key of a join, however many rows it has, is one task: the
rows of heavy keys meet their partner by a broadcast of at most 1,000 rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACE, heavy_limit, keeps, lookup, parts, slices, table, written

BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
STEPS = (16, 32, 64, 96, 128, SIZE)
KEY_BLOCKS = 16
FEW_EDGES = 250_000
WORD = re.compile(r"\w+")
U = np.uint64
ODD, PLUS = np.random.default_rng(23).integers(0, 1 << 63, (2, SIZE), dtype=np.uint64) * U(2) + U(1)


class WordHash(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_words = WordHash()
keeps("ngram_join", _words.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """The sorted hashes of a text's distinct runs of ``n`` lower-case words; of all its words, if it has fewer."""
    parts = (WORD.findall(part.lower()) for part in slices(text, SPACE))
    one = np.concatenate([np.fromiter(map(_words.__getitem__, words), U, len(words)) for words in parts])
    if not len(one):
        return np.empty(0, U)
    size = min(n, len(one))
    out = np.full(len(one) - size + 1, size, U)
    for i in range(size):
        out = out * U(0x9E3779B97F4A7C15) + one[i : len(one) - size + 1 + i]
    return np.unique(mix(out))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes, which is not empty."""
    low = np.full(SIZE, (1 << 32) - 1, U)
    for at in range(0, len(s), 1_024):
        low = np.minimum(low, ((s[at : at + 1_024, None] * ODD + PLUS) >> U(32)).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, which also depends on the band's number."""
    key = np.arange(1, BANDS + 1, dtype=U)
    for i in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + low[i::ROWS])
    return key.view(np.int64)


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each step, the fewest equal values at which P(similarity >= threshold) is not below ``tolerance``.

    With a uniform prior that chance is P(Binomial(n + 1, threshold) <= matches)."""
    out = []
    for n in STEPS:
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def plausible(sig: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...], threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) have sizes that allow the threshold and are dropped by no step, as indices."""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    left = np.flatnonzero(small >= threshold * large - 1e-9)
    match, start = np.zeros(len(left), np.int64), 0
    for end, m in zip(STEPS, least):
        match = match + (sig[i[left], start:end] == sig[j[left], start:end]).sum(axis=1)
        keep = match >= m
        left, match, start = left[keep], match[keep], end
    return left


class Sets:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def forest(sig: np.ndarray, size: np.ndarray, side: np.ndarray, least: tuple[int, ...], threshold: float) -> list[tuple[int, int]]:
    """Edges that connect what plausible pairs connect, without cycles. With two sides, pairs across them alone."""
    n, sets, edges = len(sig), Sets(len(sig)), []
    label = np.arange(n)
    for i in range(n - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if side[0] != side[-1]:
            other = other[side[other] != side[i]]
        if not len(other):
            continue
        for j in other[plausible(sig, size, np.full(len(other), i), other, least, threshold)].tolist():
            if sets.join(i, j):
                edges.append((i, j))
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return edges


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of consecutive rows equal in the first ``keys`` columns, which may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[start] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(dealt: DataFrame, salt: int) -> DataFrame:
    """Rows with ``n``, the number of blocks of their group, dealt to pairs of blocks (b1 <= b2); ``own`` is theirs."""
    return (
        dealt.withColumn("own", F.pmod(F.xxhash64("tag", F.lit(salt)), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("b1", F.least("own", "other"))
        .withColumn("b2", F.greatest("own", "other"))
        .drop("n", "other")
    )


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, root) for each end of the edges (a, b) of one task, root the least tag of its component."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in parts(batches, "ngram_join", 100_000)]
    if not ends:
        return
    tags, at = np.unique(np.concatenate(ends, axis=1).ravel(), return_inverse=True)
    a, b = at.reshape(2, -1).tolist()
    sets = Sets(len(tags))
    for x, y in zip(a, b):
        sets.join(x, y)
    roots = np.array([sets.root(x) for x in range(len(tags))], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(tags[roots], pa.int64())], names=["tag", "root"])


def components(edges: DataFrame, label: str) -> DataFrame:
    """(tag, root) for each end of an edge, root the least tag of its component. Up to ``FEW_EDGES`` edges, which are
    at most 4 MB, are one task's. More go through rounds of large and small stars, each a written table, until a round
    changes nothing. Each table is a job, and its files are processes that a JVM without native Hadoop starts."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    if now.count() <= FEW_EDGES:
        return now.coalesce(1).mapInArrow(trees, "tag long, root long")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("tag"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        state = seen
        heavy = F.col("degree") > heavy_limit(2 * seen[0])
        # Large star: each node's larger neighbours go to the least of its neighbours and itself.
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
        large = written(lookup(both.where("b > a"), least, ["a"], heavy).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label)
        # Small star: each node and its smaller neighbours go to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = lookup(large, least, ["a"], heavy).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        now = written(small.distinct(), label)


SKETCH = "doc_id long, tag long, text_hash long, row_hash long, h1 long, h2 long, size long, keys array<long>, sig binary"


def hashes_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, row_hash, text): the two hashes of a text and of its row are 128 bits of that row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(7), "doc_id", "text").alias("row_hash"), "text")


def sketches(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "ngram_join"):
            h1, h2, sizes, keys, sigs = [], [], [], [], []
            for x in part.column(4):
                text = x.as_py() or ""
                s = shingles(text, n)
                whole = xxhash.xxh128_digest(s.tobytes() if len(s) else b"text:" + text.encode("utf-8", "surrogatepass"))
                a, c = np.frombuffer(whole, np.int64)
                h1.append(a)
                h2.append(c)
                sizes.append(len(s))
                low = signature(s) if len(s) else None
                keys.append(None if low is None else band_keys(low))
                sigs.append(None if low is None else short(low))
            made = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *made], names=["doc_id", "tag", "text_hash", "row_hash", "h1", "h2", "size", "keys", "sig"])

    return rows.select("doc_id", F.monotonically_increasing_id().alias("tag"), "text_hash", "row_hash", "text").mapInArrow(run, SKETCH)


def short(low: np.ndarray) -> bytes:
    """The low 16 bits of MinHash values."""
    return (low & U(0xFFFF)).astype(np.uint16).tobytes()


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    """(tag, sig, hashes) of rows (tag, text): the set of hashes of each text, in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "ngram_join"):
            sets = [shingles(x.as_py() or "", n) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([short(signature(s)) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["tag", "sig", "hashes"])

    return texts.select("tag", "text").mapInArrow(run, "tag long, sig binary, hashes binary")


def bucket_edges(members: DataFrame, least: tuple[int, ...], threshold: float) -> DataFrame:
    """Forests of plausible pairs from rows (key, b1, b2, own, tag, size, sig)."""

    def small(found: list[pa.Table]) -> pa.RecordBatch:
        tags, sizes, sigs, first, second, at = [], [], [], [], [], 0
        for g in found:
            n = g.num_rows
            i, j = np.triu_indices(n, 1)
            first.append(i + at)
            second.append(j + at)
            tags.append(g["tag"].to_numpy())
            sizes.append(g["size"].to_numpy())
            sigs += [np.frombuffer(x.as_py(), np.uint16) for x in g["sig"]]
            at += n
        i, j, tag = np.concatenate(first), np.concatenate(second), np.concatenate(tags)
        keep = plausible(np.stack(sigs), np.concatenate(sizes), i, j, least, threshold)
        return pa.RecordBatch.from_arrays([pa.array(tag[i[keep]]), pa.array(tag[j[keep]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for g in groups_of(parts(batches, "ngram_join", 10_000), 3):
            if g.num_rows == 1:
                continue
            if g.num_rows <= 8:
                held.append(g)
                rows += g.num_rows
                if rows > 8_000:
                    yield small(held)
                    held, rows = [], 0
                continue
            order = np.argsort(g["own"].to_numpy(), kind="stable")
            tag, size, side = (g[c].to_numpy()[order] for c in ("tag", "size", "own"))
            sig = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in g["sig"].take(pa.array(order))])
            edges = forest(sig, size, side, least, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(tag[[e[0] for e in edges]], pa.int64()), pa.array(tag[[e[1] for e in edges]], pa.int64())], names=["a", "b"])
        if held:
            yield small(held)

    dealt = members.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return dealt.select("key", "b1", "b2", "own", "tag", "size", "sig").mapInArrow(run, "a long, b long").distinct()


def alike(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of sets are exactly as similar as ``threshold``. Many pairs among few sets are counted by a
    product of matrices, block by block of the hashes that more than one of them has; few pairs one by one."""
    used = np.unique(np.concatenate((i, j)))
    sizes = np.array([len(s) for s in sets])
    if len(i) < 4 * len(used):
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    else:
        ids, flat, times = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True, return_counts=True)
        shared = times > 1
        place = np.cumsum(shared) - 1
        rows = np.repeat(np.arange(len(used)), sizes[used])[shared[flat]]
        columns = place[flat[shared[flat]]]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        common = np.zeros((len(used), len(used)), np.float32)
        for at in range(0, int(shared.sum()), 8_192):
            lo, hi = np.searchsorted(columns, (at, at + 8_192))
            m = np.zeros((len(used), min(8_192, int(shared.sum()) - at)), np.float32)
            m[rows[lo:hi], columns[lo:hi] - at] = 1
            common += m @ m.T
        both = common[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)
    return both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9


GROUP = ["root", "band", "far", "b1", "b2"]


def verify(members: DataFrame, least: tuple[int, ...], threshold: float, tile: int = 256) -> DataFrame:
    """Exact links from rows (root, band, far, b1, b2, side, tag, copies, sig, hashes): rows (a, null, links) with the
    number of documents that a group's documents link a representative to, and forests of linked pairs (a, b, 0).
    Where a group has two sides, pairs across them alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(parts(batches, "ngram_join", 10_000), len(GROUP)):
            if g.num_rows < 2:
                continue
            order = np.argsort(g["side"].to_numpy(), kind="stable")
            tag, side, copies = (g[c].to_numpy()[order] for c in ("tag", "side", "copies"))
            sets = [np.frombuffer(x.as_py(), U) for x in g["hashes"].take(pa.array(order))]
            sig = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in g["sig"].take(pa.array(order))])
            size, n = np.array([len(s) for s in sets]), len(sets)
            cut = int(np.searchsorted(side, side[0], side="right"))
            if cut == n and (g["far"][0].as_py() or g["b1"][0].as_py() != g["b2"][0].as_py()):
                continue  # the other side is empty
            links, joined, a, b = np.zeros(n), Sets(n), [], []
            for at in range(0, cut, tile):
                for to in range(cut if cut < n else at, n, tile):
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + tile, cut)), np.arange(to, min(to + tile, n)), indexing="ij"))
                    if to == at:
                        i, j = i[i < j], j[i < j]
                    keep = plausible(sig, size, i, j, least, threshold)
                    i, j = i[keep], j[keep]
                    if not len(i):
                        continue
                    linked = alike(sets, i, j, threshold)
                    i, j = i[linked], j[linked]
                    links += np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
                    for x, y in zip(i.tolist(), j.tolist()):
                        if joined.join(x, y):
                            a.append(tag[x])
                            b.append(tag[y])
            has = np.flatnonzero(links)
            columns = [pa.array([*tag[has], *a], pa.int64()), pa.array([None] * len(has) + b, pa.int64()), pa.array([*links[has].astype(np.int64), *[0] * len(a)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "links"])

    dealt = members.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.select(*GROUP, "side", "tag", "copies", "sig", "hashes").mapInArrow(run, "a long, b long, links long")


def may_have(rows: DataFrame, wanted: DataFrame, key: str, most_bits: int = 1 << 27) -> DataFrame:
    """``rows`` without most of those whose ``key``, a hash, no row of ``wanted`` has: a filter before a shuffle.

    About ten bits for each wanted row, one for each value of the hash, in pieces of 4 KB: a broadcast of
    ``most_bits``, 16 MB, at most. Beyond 13 million wanted rows more and more bits are set and other rows pass too."""
    bits = min(most_bits, 1 << max(15, (10 * wanted.count()).bit_length()))
    h = F.pmod(F.col(key), F.lit(bits)) + 1
    bitmap = F.broadcast(wanted.groupBy(F.bitmap_bucket_number(h).alias("piece__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits__")))
    at = F.bitmap_bit_position(h).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bits__, place__ div 8 + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumns({"piece__": F.bitmap_bucket_number(h), "place__": at}).join(bitmap, "piece__")
    here = F.call_function("shiftright", byte, F.col("place__") % 8).bitwiseAND(F.lit(1)) == 1
    return found.where(here).select(*rows.columns)


def placed(wanted: DataFrame, threshold: float, block: int, weight: int) -> DataFrame:
    """Rows (tag, root, copies, size) dealt to the groups in which pairs of a component meet.

    A component of one block is one group. Others are cut into bands of sizes, the ratio of a band's ends being the
    threshold, so that similar sets are in one band or in neighbouring ones; bands are cut into blocks of at most
    about ``block`` sets and ``weight`` hashes; a block meets those of its own band and those of the next."""
    n = lambda: F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / weight)).cast("int").alias("n")
    heavy = F.col("members") > heavy_limit(wanted.count())
    roots = wanted.groupBy("root").agg(n(), F.count("*").alias("members"))
    one, zero = roots.where("n = 1"), F.lit(0)
    alone = lookup(wanted, one, ["root"], F.lit(False)).select(
        "root", zero.alias("band"), zero.alias("far"), zero.alias("b1"), zero.alias("b2"), zero.alias("side"), "tag", "copies"
    )
    many = lookup(wanted, roots.where("n > 1").select("root", "members"), ["root"], heavy).withColumn(
        "band", F.floor(F.log("size") / (-math.log(threshold) + 1e-9)).cast("int")
    )
    many = written(many.drop("members"), "join-bands")
    if many.isEmpty():  # most of the plan is for the others, and a driver keeps what it plans
        return alone
    bands = many.groupBy("root", "band").agg(n(), F.count("*").alias("members"))
    near = lookup(many, bands, ["root", "band"], heavy)
    within = in_blocks(near.drop("members"), 1).withColumn("far", zero).withColumn("side", F.when(F.col("b1") == F.col("b2"), 0).otherwise(F.col("own")))
    # Across neighbouring bands: a row is on the lower side of its own band and on the upper one of the band before.
    above = bands.select("root", (F.col("band") - 1).alias("band"), F.col("n").alias("n2"))
    sizes = bands.select("root", "band", "n", "members").join(above, ["root", "band"])
    own = F.pmod(F.xxhash64("tag", F.lit(1)), F.col("n")).cast("int")
    lower = lookup(many, sizes, ["root", "band"], heavy).withColumn("b1", own).withColumn("b2", F.explode(F.sequence(zero, F.col("n2") - 1))).withColumn("side", zero)
    upper_sizes = bands.select("root", "band", F.col("n").alias("n2"), "members").join(
        bands.select("root", (F.col("band") + 1).alias("band"), "n"), ["root", "band"]
    )
    own = F.pmod(F.xxhash64("tag", F.lit(1)), F.col("n2")).cast("int")
    upper = lookup(many, upper_sizes, ["root", "band"], heavy).withColumn("b2", own).withColumn("b1", F.explode(F.sequence(zero, F.col("n") - 1)))
    upper = upper.withColumn("side", F.lit(1)).withColumn("band", F.col("band") - 1)
    names = [*GROUP, "side", "tag", "copies"]
    across = lower.select(*lower.columns).withColumn("far", F.lit(1)).select(*names).unionByName(upper.withColumn("far", F.lit(1)).select(*names))
    return alone.unionByName(within.select(*names)).unionByName(across)


def jaccard_join(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    tolerance: float = 1e-6,
    block: int = 1_024,
    weight: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id, rep_id, n_links, and whether it is ``kept``.

    Documents are linked if the Jaccard similarity of their sets of ``n``-word shingles is at least ``threshold``.
    class_id is the least doc_id among the documents that links connect; rep_id the least among those with the same
    set; n_links the number of other documents that this one is linked to. One row of each class is ``kept``: one
    that has its class_id.

    Defined results: words are runs of letters, digits and underscores in lower case; a text of fewer than ``n``
    words is one shingle; texts without words, null texts as empty ones, are linked only if they are equal; equal
    rows are separate documents, linked to each other; a null id is less than no other and is a class_id only where
    all of a class are null; an empty table gives no row; other columns are not read.
    """
    least = least_matches(threshold, tolerance)
    rows = hashes_of(docs, id_col, text_col)
    sketch = written(sketches(rows, n), "join-sketch")
    limit = heavy_limit(sketch.count())
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tag", "text_hash", "row_hash")
    copies = written(
        sketch.groupBy("h1", "h2").agg(F.min(order).alias("rep"), F.count("*").alias("copies")).select(
            "h1", "h2", F.col("rep.doc_id").alias("rep_id"), *[F.col(f"rep.{c}").alias(c) for c in ("tag", "text_hash", "row_hash")], "copies"
        ),
        "join-copies",
    )
    reps = sketch.where("keys is not null").select("tag", "size", "keys", "sig").join(copies.select("tag"), "tag", "left_semi")
    reps = written(reps, "join-reps")
    keyed = reps.select("tag", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("tag").alias("first")).where("members > 1")
    counts = written(counts.withColumn("n", F.ceil(F.col("members") / 512).cast("int")), "join-keys")
    heavy = F.col("members") > heavy_limit(BANDS * reps.count())
    met = written(lookup(keyed, counts, ["key"], heavy), "join-met")
    dealt = in_blocks(met.where(F.col("n") <= KEY_BLOCKS).select("key", "tag", "n"), 512)
    edges = bucket_edges(dealt.join(reps.select("tag", "size", "sig"), "tag"), least, threshold)
    crowds = met.where((F.col("n") > KEY_BLOCKS) & (F.col("tag") != F.col("first"))).select(F.col("first").alias("a"), F.col("tag").alias("b")).distinct()
    near = components(edges.union(crowds), "join-near")
    # The sets of representatives that have a plausible partner: one text each, however many copies there are.
    wanted = written(near.join(copies.select("tag", "copies", "text_hash", "row_hash"), "tag").join(reps.select("tag", "size"), "tag"), "join-wanted")
    key = ["text_hash", "row_hash"]
    texts = may_have(rows.select(*key, "text"), wanted, "row_hash").join(wanted.select(*key, "tag"), key).groupBy(*key, "tag").agg(F.first("text").alias("text"))
    sets = written(sets_of(texts, n), "join-sets")
    groups = placed(wanted.select("tag", "root", "copies", "size"), threshold, block, weight)
    found = written(verify(groups.join(sets, "tag"), least, threshold), "join-links")
    links = found.where("b is null").groupBy(F.col("a").alias("tag")).agg(F.sum("links").alias("links"))
    linked = written(components(found.where("b is not null").select("a", "b"), "join-classes").join(copies.select("tag", "rep_id"), "tag"), "join-linked")
    # The class of a component is its least (doc_id, tag); a component's root has the least tag.
    rank = F.struct(F.col("rep_id").isNull().alias("z"), F.col("rep_id").alias("id"), F.col("tag").alias("tag"))
    heads = linked.groupBy("root").agg(F.min(rank).alias("head"), F.count("*").alias("members"))
    headed = lookup(linked.select("tag", "root"), heads, ["root"], F.col("members") > limit).select("tag", "head")
    classes = written(
        copies.join(headed, "tag", "left").join(links, "tag", "left").select(
            "h1", "h2", "rep_id", "copies",
            F.when(F.col("head").isNotNull(), F.col("head.id")).otherwise(F.col("rep_id")).alias("class_id"),
            F.coalesce(F.col("head.tag"), F.col("tag")).alias("head_tag"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "join-class",
    )
    return lookup(sketch.select("doc_id", "tag", "text_hash", "h1", "h2"), classes, ["h1", "h2"], F.col("copies") > limit).select(
        "doc_id", "text_hash", "class_id", "rep_id", "n_links", (F.col("tag") == F.col("head_tag")).alias("kept")
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all documents whose five-word shingles are similar to 0.8 or more."""
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "rep_id", "n_links")


#: The same rows by all shared shingles. Words are what Unicode calls letters and numbers, and underscores.
ORACLE_SQL = r"""
WITH RECURSIVE word AS MATERIALIZED (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), shingle AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM word WHERE len(w) > 0)
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS MATERIALIZED (
    SELECT x, y, c = p.n AND c = q.n AS same FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE c >= 0.8::DOUBLE * (p.n + q.n - c) - 1e-9
    UNION ALL SELECT a.doc_id, b.doc_id, true FROM word a JOIN word b ON len(a.w) = 0 AND len(b.w) = 0 AND a.text = b.text AND a.doc_id <> b.doc_id
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM word UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
)
SELECT d.doc_id, c.class_id, least(d.doc_id, coalesce(s.least, d.doc_id)) AS rep_id, coalesce(n.n, 0) AS n_links
FROM word d JOIN (SELECT x, min(y) AS class_id FROM reach GROUP BY x) c ON c.x = d.doc_id
LEFT JOIN (SELECT x, min(y) AS least FROM link WHERE same GROUP BY x) s ON s.x = d.doc_id
LEFT JOIN (SELECT x, count(*) AS n FROM link GROUP BY x) n ON n.x = d.doc_id
"""
