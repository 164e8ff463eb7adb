"""Sharding by histogram sort: splitters from exact byte counts below candidate boundaries, then one exchange.

Only DataFrame functions run here. Rows are ordered by a key of three non-negative longs: a hash of the text (equal
texts are neighbours), a hash of the document's id, and a row tag that makes every key unique. A pass sums the bytes
and rows of each bin of every open bracket; the driver sees ``(n_shards - 1) * probes`` sums at most, whatever the
size of the table. A splitter is settled when the bytes below one of its bin's two boundaries meet the tolerance or
when one row is left between them; otherwise its bracket shrinks to that bin, and to the next part of the key once
the bin is a single value. So a group of equal texts is kept whole where the tolerance allows it, and a group of any
size is divided where it does not.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

KEY = ("k0", "k1", "k2")
KEY_END = 1 << 63


@dataclass
class Splitter:
    """Rows whose key is at least ``prefix`` + ``at`` lie above. ``prefix`` holds the settled parts of the key."""

    target: float
    prefix: tuple[int, ...] = ()
    lo: int = 0
    hi: int = KEY_END
    below: int = 0
    at: int | None = None
    history: list[int] = field(default_factory=list)

    def bracket(self) -> tuple:
        return self.prefix, self.lo, self.hi


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows of what sharding needs: id, size (UTF-8 bytes of the text plus 1), checksum and key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    half = lambda h: F.shiftrightunsigned(h, 1)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        half(F.xxhash64(text)).alias("k0"),
        half(F.xxhash64(F.col(id_col).cast("long"))).alias("k1"),
        F.monotonically_increasing_id().alias("k2"),
    )


def bin_sums(rows: DataFrame, brackets: list[tuple], probes: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Exact (bytes, rows) in each non-empty bin of each bracket: one aggregation, at most brackets * probes rows."""
    code: Column | None = None
    for i, (prefix, lo, hi) in enumerate(brackets):
        k = F.col(KEY[len(prefix)])
        inside = (k >= F.lit(lo)) & (k <= F.lit(hi - 1))
        for name, value in zip(KEY, prefix):
            inside = inside & (F.col(name) == F.lit(value))
        width = bin_width(lo, hi, probes)
        number = F.expr(f"{i * probes}L + ({KEY[len(prefix)]} - {lo}L) div {width}L")
        code = F.when(inside, number) if code is None else code.when(inside, number)
    sums = (
        rows.select(code.alias("code"), "size")
        .where("code is not null")
        .groupBy("code")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    )
    return {(r.code // probes, r.code % probes): (r.bytes, r.rows) for r in sums.collect()}


def bin_width(lo: int, hi: int, probes: int) -> int:
    return max(1, -(-(hi - lo) // probes))


def refine(s: Splitter, sums: dict[int, tuple[int, int]], probes: int, slack: float) -> None:
    """Settle ``s`` or shrink its bracket to the bin that holds its target."""
    width = bin_width(s.lo, s.hi, probes)
    below = s.below
    for i in sorted(sums):
        size, rows = sums[i]
        if below + size > s.target:
            lo, hi = s.lo + i * width, min(s.lo + (i + 1) * width, s.hi)
            under, over = s.target - below, below + size - s.target
            last = width == 1 and len(s.prefix) + 1 == len(KEY)
            if min(under, over) <= slack or rows == 1 or last:
                s.at, s.below = (lo, below) if under <= over else (hi, below + size)
            elif width == 1:
                s.prefix, s.lo, s.hi, s.below = (*s.prefix, lo), 0, KEY_END, below
            else:
                s.lo, s.hi, s.below = lo, hi, below
            return
        below += size
    s.at, s.below = s.hi, below


def splitters(
    rows: DataFrame, n_shards: int, tolerance: float, probes: int, by: str = "size"
) -> tuple[list[Splitter], int]:
    """Settled splitters in key order, and the number of rows."""
    total, n = rows.agg(F.coalesce(F.sum(by), F.lit(0)), F.count("*")).first()
    found = [Splitter(total * j / n_shards) for j in range(1, n_shards)]
    while n and (open_ := [s for s in found if s.at is None]):
        brackets = list(dict.fromkeys(s.bracket() for s in open_))
        sums = bin_sums(rows, brackets, probes)
        for s in open_:
            at = brackets.index(s.bracket())
            refine(s, {j: v for (i, j), v in sums.items() if i == at}, probes, tolerance * total / n_shards)
    return found, n


def reaches(s: Splitter) -> Column:
    """Whether a row's key is at or above the splitter, part by part."""
    parts = (*s.prefix, s.at)
    at_least = F.lit(parts[-1] >= KEY_END) & F.lit(False) if parts[-1] >= KEY_END else F.col(KEY[len(parts) - 1]) >= F.lit(parts[-1])
    for name, value in reversed(list(zip(KEY, parts[:-1]))):
        at_least = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & at_least)
    return at_least


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 16,
    tolerance: float = 0.001,
    probes: int = 512,
    rows_per_cell: int = 65_536,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row's shard, so that shards hold nearly the same number of bytes, and a gapless slot in it.

    ``tolerance`` is the accepted distance of a splitter from its target, as a part of a shard's mean size; beyond
    it a splitter stands at the nearest row boundary. Returns doc_id, size, text_crc32, shard, slot.

    Defined results: a null text has size 1 and the checksum of no bytes, as an empty one; a null id is kept; equal
    rows are separate rows, each with its own slot; with fewer rows than shards, some shards are empty; an empty
    table gives no row; further columns of ``docs`` are not read, so their names cannot clash.
    """
    rows = written(digest(docs, id_col, text_col), "shard-digest")
    found, n = splitters(rows, n_shards, tolerance, probes)
    shard = F.lit(0)
    for s in found if n else []:
        shard = shard + reaches(s).cast("int")
    # A shard is numbered in cells of bounded size, a bounded number of them: the cells' offsets fit a broadcast.
    cells = min(4_096, max(4, -(-n // (n_shards * rows_per_cell))))
    dealt = rows.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("k1", "k2"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "cell").count().select(
        "shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("shard", "cell").orderBy(*KEY)
    return (
        dealt.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).alias("slot"))
    )


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
