import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pafs

from blockloom.llm import media as M


def test_image_round_trip_and_other_filters():
    rng = np.random.default_rng(0)
    for rows in (1, 2, 9, 40):
        payload = rng.integers(0, 256, rows * 64, dtype=np.uint8).tobytes()
        assert M.from_image(M.to_image(payload)).tobytes() == payload
    for bad in (b"", b"x" * 63):
        with pytest.raises(ValueError):
            M.to_image(bad)
    want = rng.integers(0, 256, (5, 64), dtype=np.uint8)
    lines = []
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = [kind]
        for x in range(64):
            a = int(want[y, x - 1]) if x else 0
            b = int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= min(abs(p - b), abs(p - c)) else b if abs(p - b) <= abs(p - c) else c
            line.append((int(want[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines.append(bytes(line))
    image = M.PNG + M.chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 5, 8, 0, 0, 0, 0)) + M.chunk(b"IDAT", zlib.compress(b"".join(lines))) + M.chunk(b"IEND", b"")
    assert (M.from_image(image) == want).all()
    with pytest.raises(ValueError):
        M.from_image(image[:40] + b"\0" + image[41:])


def decoded(image):
    """Width, height and samples of a greyscale PNG of unfiltered lines, checked chunk by chunk."""
    assert image.startswith(b"\x89PNG\r\n\x1a\n")
    chunks, at = [], 8
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        body = image[at + 4 : at + 8 + n]
        assert int.from_bytes(image[at + 8 + n : at + 12 + n], "big") == zlib.crc32(body)
        chunks.append((body[:4], body[4:]))
        at += 12 + n
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    header = chunks[0][1]
    width, height = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big")
    assert header[8:] == bytes([8, 0, 0, 0, 0])
    raw = zlib.decompress(chunks[1][1])
    lines = [raw[y * (width + 1) : (y + 1) * (width + 1)] for y in range(height)]
    assert len(raw) == height * (width + 1) and all(line[0] == 0 for line in lines)
    return width, height, b"".join(line[1:] for line in lines)


def feature_by_hand(payload):
    """The feature from the bytes, by loops: mean, deviation and entropy, and 8 bands of 9 blocks compared."""
    n, height = len(payload), len(payload) // 64
    mean = sum(payload) / n
    dev = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    edge = [i * 64 // 9 for i in range(10)]
    bits = ""
    for band in range(8):
        low, high = band * height // 8, (band + 1) * height // 8
        lines = range(low, max(high, low + 1))
        sums = [sum(payload[y * 64 + x] for y in lines for x in range(edge[c], edge[c + 1])) for c in range(9)]
        bits += "".join("01"[right > left] for left, right in zip(sums, sums[1:]))
    return f"64x{height};mean={mean:.6f};dev={dev:.6f};entropy={entropy:.6f};grad={int(bits, 2):016x}"


def test_whole_table(spark, sf):
    out = M.op9_archive_media(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(out) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        image = M.to_image(payload)
        assert decoded(image) == (64, len(payload) // 64, payload)
        row = out.loc[doc_id]
        assert row.n_bytes == len(raw) and row.payload_bytes == len(payload)
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])
        assert row.media_bytes == len(image) and row.media_sha256 == hashlib.sha256(image).hexdigest()
        assert row.feature == feature_by_hand(payload)


def members(spark, n, path, parts=2):
    rows = [(i if i % 7 else None, i, bytes([i % 256]) * (i * 13 % 900)) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, aux long, media binary").repartition(parts)
    M.write_archives(df, f"file://{path}")
    return rows


def test_ranges_cover_every_member_once(spark, tmp_path):
    rows = members(spark, 500, tmp_path / "a")
    df = M.read_archives(spark, f"file://{tmp_path}/a", range_bytes=10_000, batch_bytes=2_000)
    assert df.rdd.getNumPartitions() > 10
    got = [(r.key, r.aux, bytes(r.media)) for r in df.collect()]
    assert sorted(got, key=lambda r: r[1]) == rows
    for manifest in (tmp_path / "a").glob("_members-*"):
        manifest.unlink()  # then by the footers
    assert M.read_archives(spark, f"file://{tmp_path}/a").count() == 500


def test_a_damaged_block_is_read_again_member_by_member(tmp_path, monkeypatch, spark):
    members(spark, 60, tmp_path / "b", 1)
    reader = M.ArchiveReader(f"file://{tmp_path}/b", 1 << 20, 1 << 20, 3, 0.0)
    real, calls = M.read_range, []

    def failing(fs, file, offset, length):
        calls.append((offset, length))
        data = real(fs, file, offset, length)
        if len(calls) == 2:
            return data[: len(data) // 2]  # the block arrives short
        if len(calls) in (4, 9):
            raise OSError("lost")
        if len(calls) == 6:
            return b"?" * length
        return data

    monkeypatch.setattr(M, "read_range", failing)
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 60
    again = calls[2:]
    assert len(again) < 60 + 3 and len(set(again)) < len(again)


def test_a_lost_member_is_an_error(tmp_path, spark):
    members(spark, 10, tmp_path / "c", 1)
    reader = M.ArchiveReader(f"file://{tmp_path}/c", 1 << 20, 1 << 20, 2, 0.0)
    (archive,) = reader.archives()
    file = tmp_path / "c" / archive.name
    raw = bytearray(file.read_bytes())
    raw[20] ^= 1
    file.write_bytes(bytes(raw))
    with pytest.raises(OSError, match="checksum"):
        list(reader.read(reader.partitions()[0]))


def test_null_empty_repeated_long_and_clashing(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x" * 300_000, None), (3, "é" * 32, "c"), (3, "é" * 32, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = M.store_and_measure(docs).toPandas()
    assert sorted(out.n_bytes) == [0, 0, 64, 64, 300_000] and sorted(out.payload_bytes)[:4] == [64] * 4
    assert out[out.doc_id == 3].media_sha256.nunique() == 1 and out.doc_id.isna().sum() == 1
    assert M.store_and_measure(docs.limit(0)).count() == 0


def test_appends_add_and_overwriting_replaces(spark, tmp_path):
    at = f"file://{tmp_path}/d"
    rows = spark.createDataFrame([(i, 0, bytes([i])) for i in (1, 2, 3)], "key long, aux long, media binary")
    keys = lambda: sorted(r.key for r in M.read_archives(spark, at).collect())
    M.write_archives(rows.where("key <= 2"), at)
    M.write_archives(rows.where("key = 3"), at)
    assert keys() == [1, 2, 3]
    M.write_archives(rows.where("key = 3"), at)
    assert keys() == [1, 2, 3, 3]
    for _ in range(2):  # run again, it leaves no doubles
        M.write_archives(rows, at, mode="overwrite")
        assert keys() == [1, 2, 3]
    assert len(list((tmp_path / "d").glob("_members-*"))) == 1
    M.write_archives(rows.limit(0), at, mode="overwrite")
    assert keys() == [] and not list((tmp_path / "d").glob("*.arc"))
    M.write_archives(rows.where("key = 1"), at)
    assert keys() == [1]


def test_archives_of_a_failed_job_are_not_read(spark, tmp_path):
    at = f"file://{tmp_path}/e"
    rows = spark.createDataFrame([(1, 0, b"a")], "key long, aux long, media binary")
    M.write_archives(rows, at)
    left = M.ArchiveWriter(at, 1 << 20).write(iter([pa.record_batch([pa.array([9]), pa.array([0]), pa.array([b"z"])], names=["key", "aux", "media"])]))
    assert left.archives[0].members == 1
    assert [r.key for r in M.read_archives(spark, at).collect()] == [1]
