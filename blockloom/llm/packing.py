"""Packing of token sequences: best-fit decreasing over a segment tree of remaining capacities.

Best-fit decreasing looks only at lengths, and there are at most ``capacity`` of them. So the packing is computed
exactly, for a corpus of any size, from the histogram of lengths: pieces of one length are placed in runs, and bins
that are filled alike are kept as intervals of bin numbers under their remaining capacity. The segment tree finds the
tightest capacity that still fits in logarithmic time. What the driver holds depends on the capacity alone. The runs,
a bounded table, are then broadcast to the pieces, which know their rank among pieces of equal length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import SPACE, keeps, parts, slices, table, written

CAPACITY = 2048


class CapacityTree:
    """Segment tree over remaining capacities 0..top: how many bins have each, and the least one from a bound on."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= ``least`` that any bin has left."""
        i = self.leaves + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up until a right neighbour has bins
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:  # down to its leftmost leaf with bins
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Runs (length, first rank, end rank, first bin, pieces a bin, offset in the bin), and the number of bins.

    The piece of rank ``r`` of its length, in a run that starts at ``a``, lies in bin ``first + (r - a) // per`` at
    ``offset + (r - a) % per * length``. The same placement as of best-fit decreasing done piece by piece: after a
    piece goes to the tightest bin, that bin stays the tightest as long as another piece of this length fits.
    """
    tree, bins = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    runs: list[tuple] = []
    opened = 0

    def put(left: int, first: int, n: int) -> None:
        bins[left].append((first, n))
        tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit a bin of {capacity}")
        todo, rank = histogram[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, opened, -(-todo // (capacity // length))
                opened += n
            else:
                first, n = bins[left].popleft()
                tree.add(left, -n)
            per = left // length
            full = min(n, todo // per)
            if full:
                runs.append((length, rank, rank + full * per, first, per, capacity - left))
                put(left - per * length, first, full)
                rank, todo = rank + full * per, todo - full * per
            if full < n and todo:
                runs.append((length, rank, rank + todo, first + full, todo, capacity - left))
                put(left - todo * length, first + full, 1)
                rank, todo, full = rank + todo, 0, full + 1
            if full < n:
                bins[left].appendleft((first + full, n - full))
                tree.add(left, n - full)
    return runs, opened


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: bins of ``capacity`` filled by best-fit decreasing.

    ``pieces`` should be a written table, as it is read three times. Equal rows are separate pieces; an empty table
    stays empty; a length that is null, below 1 or above the capacity is an error of the caller and raises. Columns
    named ``sequence_id`` or ``offset`` are replaced; the working columns start with ``pack__``.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(F.col(length_col).cast("int")).count().collect()}  # <= capacity rows
    if None in counts:
        raise ValueError("a piece has no length")
    runs, _ = best_fit_decreasing(counts, capacity)
    places = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in runs],
        "pack__length int, pack__from long, pack__to long, pack__bin long, pack__per long, pack__offset long",
    )
    # Rank among pieces of equal length, numbered in cells so that a common length is shared by many tasks. The
    # offsets of the cells are at most capacity * 1024 narrow rows.
    cells = min(1_024, max(16, -(-sum(counts.values()) // 10_000_000)))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    dealt = pieces.select(
        *kept,
        F.col(length_col).cast("int").alias("pack__length"),
        F.pmod(F.xxhash64(*kept), F.lit(cells)).cast("int").alias("pack__cell"),
    )
    before = Window.partitionBy("pack__length").orderBy("pack__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("pack__length", "pack__cell").count().select(
        "pack__length", "pack__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("pack__before")
    )
    within = Window.partitionBy("pack__length", "pack__cell").orderBy(*kept)
    ranked = (
        dealt.withColumn("pack__rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["pack__length", "pack__cell"])
        .withColumn("pack__rank", F.col("pack__rank") + F.col("pack__before"))
    )
    step = F.col("pack__rank") - F.col("pack__from")
    return ranked.join(
        F.broadcast(places),
        (ranked["pack__length"] == places["pack__length"])
        & (F.col("pack__rank") >= F.col("pack__from"))
        & (F.col("pack__rank") < F.col("pack__to")),
    ).select(
        *kept,
        (F.col("pack__bin") + F.expr("(pack__rank - pack__from) div pack__per")).alias("sequence_id"),
        (F.col("pack__offset") + step % F.col("pack__per") * places["pack__length"]).alias("offset"),
    )


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer(dict):
    """Ids of a word-wise BPE tokenizer file: a cache from word to ids as bytes, filled by the library's model.

    Words are independent after the file's normalization and word pattern. The shortcut reads texts of printable
    ASCII and Latin letters up to U+017F only, where that pattern is plain; any other text goes to the library whole.
    """

    OTHER = re.compile(r"[^\n\t\r\x20-\x7eÀ-ÖØ-öø-įı-ſ]|<\|")
    WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str, max_words: int = 200_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.max_words = max_words
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers, little-endian as on every platform that Spark's Arrow runs on."""
        if self.OTHER.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > self.max_words:
            self.clear()
        return b"".join(b"".join(map(self.__getitem__, self.WORD.findall(part.lower()))) for part in slices(text, SPACE))


_tokenizers: dict[str, WordTokenizer] = {}
keeps("packing", _tokenizers.clear)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each document's ids plus ``end_id``, cut every ``capacity`` tokens if there are more.

    Returns doc_id, piece, start, length, ids_crc32 and, ``with_ids``, the ids as little-endian 32-bit binary. A null
    or empty text gives one piece that holds the end id; equal rows give equal pieces each; an empty table gives none.
    """
    end, step = end_id.to_bytes(4, "little"), 4 * capacity
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = None
        for batch in parts(batches, "packing"):
            if encode is None:
                if tokenizer_path not in _tokenizers:
                    _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
                encode = _tokenizers[tokenizer_path].encode
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names[:n])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Tokenize, cut and pack: the pieces with sequence_id and offset. See ``token_pieces`` and ``pack``."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
