"""Media columns: a Spark data source over archives of media members, and 8-bit images that hold texts.

An archive is a file of members one after the other, then a directory of fixed-width entries (offset, length,
checksum, key, aux), then a footer. Each job that commits adds a manifest to the folder, so that what failed or repeated
tasks leave behind is never read; one that overwrites adds a manifest that hides those before it. The planner looks at
the manifests alone (or at the footers, where there is none) and cuts each directory into byte ranges, whose number
follows the bytes of the archive. A task reads its
range of the directory, then runs of neighbouring members at once, and hands them on in Arrow batches of bounded size.
A member that arrives short or with a wrong checksum is read again on its own, by its offset.

Files are opened through ``pyarrow.fs``, so a folder may be in any store that it reaches.
"""

from __future__ import annotations

import json
import math
import re
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ._shared import shared_path, table

FORMAT = "blockloom_archive"
MANIFEST = re.compile(r"_members-(\d{8})-[0-9a-f]{32}\.json")  # the order of commits, and a name of its own
ENTRY = struct.Struct("<QQIIqq")  # offset, length, crc32, 1 if the key is null, key, aux
FOOTER = struct.Struct("<QQ8s")  # directory offset, members, magic
MAGIC = b"BLKARC01"
STORED = T.StructType().add("key", "long").add("aux", "long").add("media", "binary")
READ = T.StructType().add("key", "long").add("aux", "long").add("media", "binary").add("archive", "string").add("offset", "long")


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Archive:
    name: str
    directory: int
    members: int


@dataclass
class Written(WriterCommitMessage):
    archives: list[Archive]


@dataclass
class Range(InputPartition):
    """Entries ``start`` to ``end`` of the directory of an archive, as a range of its bytes."""

    name: str
    directory: int
    start: int
    end: int

    def __post_init__(self) -> None:
        InputPartition.__init__(self, None)


def manifests(fs: pafs.FileSystem, folder: str) -> list[tuple[int, str]]:
    """The order and the path of each manifest of a folder."""
    found = [(MANIFEST.fullmatch(i.base_name), i.path) for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]
    return sorted((int(m[1]), path) for m, path in found if m)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int, overwrite: bool = False):
        self.path, self.roll, self.overwrite = path, roll, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        done: list[Archive] = []
        out, at, entries = None, 0, []

        def close() -> None:
            out.write(b"".join(entries))
            out.write(FOOTER.pack(at, len(entries), MAGIC))
            out.close()
            done[-1].directory, done[-1].members = at, len(entries)

        for batch in iterator:
            for key, aux, media in zip(*(batch.column(i) for i in range(3))):
                if out is None:
                    done.append(Archive(f"{uuid.uuid4().hex}.arc", 0, 0))
                    out, at, entries = fs.open_output_stream(f"{folder}/{done[-1].name}"), 0, []
                data = media.as_py() or b""
                out.write(data)
                key = key.as_py()
                entries.append(ENTRY.pack(at, len(data), zlib.crc32(data), key is None, key or 0, aux.as_py() or 0))
                at += len(data)
                if at >= self.roll:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        before = manifests(fs, folder)
        order, own = (before[-1][0] if before else 0) + 1, uuid.uuid4().hex
        kept = {"replaces": self.overwrite, "archives": [vars(a) for m in messages if m for a in m.archives]}
        with fs.open_output_stream(f"{folder}/_part-{own}") as out:
            out.write(json.dumps(kept).encode())
        fs.move(f"{folder}/_part-{own}", f"{folder}/_members-{order:08}-{own}.json")
        if self.overwrite:  # what no manifest names any more
            for _, path in before:
                for a in json.loads(fs.open_input_stream(path).read())["archives"]:
                    fs.delete_file(f"{folder}/{a['name']}")
                fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = open_folder(self.path)
        for m in messages:
            for a in m.archives if m else []:
                fs.delete_file(f"{folder}/{a.name}")


def read_range(fs: pafs.FileSystem, file: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(file) as f:
        f.seek(offset)
        return f.read(length)


def read_member(fs: pafs.FileSystem, file: str, offset: int, length: int, crc: int, attempts: int, pause: float) -> bytes:
    """One member by its offset, read again until it is whole; an error after ``attempts``."""
    why = ""
    for attempt in range(attempts):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            data = read_range(fs, file, offset, length)
        except OSError as e:
            why = str(e)
            continue
        if len(data) == length and zlib.crc32(data) == crc:
            return data
        why = f"{len(data)} of {length} bytes" if len(data) != length else "the checksum differs"
    raise OSError(f"member at {offset} of {file}: {why}, in {attempts} attempts")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, batch_bytes: int, attempts: int, pause: float):
        self.path, self.range_bytes, self.batch_bytes, self.attempts, self.pause = path, range_bytes, batch_bytes, attempts, pause

    def archives(self) -> list[Archive]:
        fs, folder = open_folder(self.path)
        found: list[Archive] = []
        named = manifests(fs, folder)
        for _, path in named:
            commit = json.loads(fs.open_input_stream(path).read())
            found = ([] if commit["replaces"] else found) + [Archive(**a) for a in commit["archives"]]
        if named:
            return found
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.endswith(".arc"):
                directory, members, magic = FOOTER.unpack(read_range(fs, info.path, info.size - FOOTER.size, FOOTER.size))
                if magic != MAGIC:
                    raise OSError(f"{info.path} is no archive")
                found.append(Archive(info.base_name, directory, members))
        return found

    def partitions(self) -> list[Range]:
        out = []
        for a in self.archives():
            step = max(1, int(self.range_bytes * a.members / max(1, a.directory)))
            out += [Range(a.name, a.directory, s, min(s + step, a.members)) for s in range(0, a.members, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        fs, folder = open_folder(self.path)
        file = f"{folder}/{partition.name}"
        size = (partition.end - partition.start) * ENTRY.size
        raw = read_range(fs, file, partition.directory + partition.start * ENTRY.size, size)
        if len(raw) != size:
            raise OSError(f"the directory of {file} is cut short")
        run: list[tuple] = []
        total = 0
        for entry in ENTRY.iter_unpack(raw):
            run.append(entry)
            total += entry[1]
            if total >= self.batch_bytes or len(run) >= 4_096:
                yield self.batch(fs, file, partition.name, run)
                run, total = [], 0
        if run:
            yield self.batch(fs, file, partition.name, run)

    def batch(self, fs: pafs.FileSystem, file: str, name: str, run: list[tuple]) -> pa.RecordBatch:
        start = run[0][0]
        try:
            block = read_range(fs, file, start, run[-1][0] + run[-1][1] - start)
        except OSError:
            block = b""
        media = []
        for offset, length, crc, *_ in run:
            data = block[offset - start : offset - start + length]
            if len(data) != length or zlib.crc32(data) != crc:
                data = read_member(fs, file, offset, length, crc, self.attempts, self.pause)
            media.append(data)
        keys = [None if e[3] else e[4] for e in run]
        columns = [pa.array(keys, pa.int64()), pa.array([e[5] for e in run], pa.int64()), pa.array(media, pa.binary()), pa.array([name] * len(run)), pa.array([e[0] for e in run], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=READ.names)


class ArchiveSource(DataSource):
    """``spark.read.format("blockloom_archive").load(folder)`` gives key, aux, media, archive, offset; writing takes
    key, aux and media. Options: range_bytes, batch_bytes, attempts, pause (seconds, doubled each time), roll_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return READ

    def reader(self, schema: T.StructType) -> ArchiveReader:
        o = self.options
        return ArchiveReader(o["path"], int(o.get("range_bytes", 8 << 20)), int(o.get("batch_bytes", 4 << 20)), int(o.get("attempts", 4)), float(o.get("pause", 0.2)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        if schema.names != STORED.names:
            raise ValueError(f"archives take the columns {STORED.names}")
        return ArchiveWriter(self.options["path"], int(self.options.get("roll_bytes", 256 << 20)), overwrite)


def write_archives(members: DataFrame, path: str, mode: str = "append") -> None:
    """Store key (long or null), aux (long) and media (null: empty) of each row, in the order of its partition.

    ``append`` adds to the members of a folder, so that writing the same rows again doubles them; ``overwrite``
    replaces them, so that a job that is run again leaves its rows once."""
    members.sparkSession.dataSource.register(ArchiveSource)
    members.select("key", F.coalesce("aux", F.lit(0)).alias("aux"), "media").write.format(FORMAT).mode(mode).save(path)


def read_archives(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(path)


WIDTH = 64


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n"


def to_image(payload: bytes, level: int = 6) -> bytes:
    """A greyscale PNG of 8-bit samples, 64 wide; ``payload`` is a positive multiple of 64 bytes."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload is no positive multiple of 64 bytes")
    rows = len(payload) // WIDTH
    filtered = np.zeros((rows, WIDTH + 1), np.uint8)
    filtered[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + chunk(b"IEND", b"")


def from_image(image: bytes) -> np.ndarray:
    """The samples, row by row, of an 8-bit greyscale PNG that is not interlaced; any of its filters."""
    if image[:8] != PNG:
        raise ValueError("no PNG")
    at, data, shape = 8, [], None
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("not 8-bit greyscale")
            shape = h, w
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if not rows[:, 0].any():
        return rows[:, 1:]
    out = np.zeros((shape[0] + 1, shape[1] + 1), np.uint8)  # a row above and a sample to the left of zeros
    for y in range(shape[0]):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 2:
            out[y + 1, 1:] = line + out[y, 1:]
        else:
            for x in range(shape[1]):
                a, b, c = int(out[y + 1, x]), int(out[y, x + 1]), int(out[y, x])
                near = min((a, b, c), key=lambda v: abs(a + b - c - v))
                out[y + 1, x + 1] = (int(line[x]) + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) % 256
    return out[1:, 1:]


def image_features(samples: np.ndarray) -> str:
    """Size, mean, deviation and entropy of the samples, and a hash of which of 8 x 9 block sums grow to the right."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n, values = int(counts.sum()), np.arange(256)
    total, square = int((counts * values).sum()), int((counts * values * values).sum())
    mean = total / n
    entropy = sum(-c / n * math.log2(c / n) for c in counts[counts > 0].tolist())
    rows = np.linspace(0, len(samples), 9).astype(int)
    columns = np.linspace(0, samples.shape[1], 10).astype(int)[:9]
    bits = 0
    for a, b in zip(rows[:-1], rows[1:]):
        band = samples[a : max(b, a + 1)].sum(axis=0, dtype=np.int64)
        sums = np.add.reduceat(band, columns)
        for left, right in zip(sums[:-1], sums[1:]):
            bits = bits << 1 | int(right > left)
    return f"{samples.shape[1]}x{len(samples)};mean={mean:.6f};dev={math.sqrt(max(0.0, square / n - mean * mean)):.6f};entropy={entropy:.6f};grad={bits:016x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes of a text (null: none), and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def texts_to_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Members for ``write_archives``: key (the id), aux (bytes of the text) and the image of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                found = [payload_of(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([to_image(p) for _, p in found], pa.binary())], names=STORED.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, STORED)


MEASURED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measure_images(members: DataFrame) -> DataFrame:
    """Decode the stored images; digests of payload and stored form, and the features of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out: list[tuple] = []
            for key, aux, media in zip(*(b.column(i) for i in range(3))):
                image = media.as_py()
                samples = from_image(image)
                payload = samples.tobytes()
                out.append((key.as_py(), aux.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), image_features(samples)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in MEASURED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return members.select("key", "aux", "media").mapInArrow(run, MEASURED)


def store_and_measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an image in archives of the shared folder, read them back and measure them.

    Defined results: a null text is stored as an empty one, 64 bytes of zeros; a null id is kept; equal rows are
    separate members with equal values; an empty table gives no row; other columns are not read.
    """
    path = shared_path(docs.sparkSession, "archives")
    write_archives(texts_to_images(docs, id_col, text_col), path)
    return measure_images(read_archives(docs.sparkSession, path))


def op9_archive_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an 8-bit image in archives, read back and measured."""
    return store_and_measure(table(spark, sf_dir, "documents"))
