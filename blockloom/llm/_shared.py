"""What the operators of this subpackage share: table access and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_local_dirs: dict[str, str] = {}
#: What a Python process keeps from one task to the next, by operator: functions that drop it, and whose task was last.
_kept: dict[str, Callable[[], None]] = {}
_last: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` if the session has it.

    Where it is unset and everything runs in one JVM, a temporary folder, removed at exit. Elsewhere an error:
    a machine-local folder would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = tempfile.mkdtemp(prefix="blockloom-")
        atexit.register(shutil.rmtree, _local_dirs[key], ignore_errors=True)
    return f"file://{_local_dirs[key]}"


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/blockloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_written(spark: SparkSession) -> None:
    """Remove all tables and archives that this application wrote here. What was made of them and not yet saved can no
    longer be read, so this is for the end of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/blockloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, so that a lost executor costs no earlier
    stage, and fixes values such as row tags that a second evaluation could change."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heavy_limit(rows: int) -> int:
    """How many of ``rows`` a key must have to be heavy; at most 1,000 keys have more."""
    return max(100, rows // 1_000)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], heavy: Column) -> DataFrame:
    """``left`` with the columns of the row of ``right`` that has its keys, which are unique there.

    ``heavy`` marks the rows of ``right`` for which ``left`` has more rows than ``heavy_limit``, at most 1,000: these
    are broadcast, so that the rows of a key never meet in one task. ``left`` is read twice.
    """
    hot = F.broadcast(right.where(heavy))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(~F.coalesce(heavy, F.lit(False))), keys)
    found = left.join(hot, keys)
    return found.unionByName(rest.select(*found.columns))


def release() -> None:
    """Give back to the system what this process has freed: a Python worker outlives its tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such function in this C library
        pass


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """Say how to drop what ``operator`` keeps in a process between tasks."""
    _kept[operator] = drop


def parts(batches: Iterator[pa.RecordBatch], operator: str, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A task's batches in slices of at most ``rows``, which bound the lists made of each. A worker that comes from
    another operator's task drops what that one kept, and every task gives back what it freed."""
    if _last != [operator]:
        for name, drop in _kept.items():
            if name != operator:
                drop()
        _last[:] = [operator]
        release()
    try:
        for b in batches:
            for start in range(0, max(1, b.num_rows), rows):
                yield b.slice(start, rows)
    finally:
        release()


def with_text(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """Columns ``keep`` and the text as a string, and where a batch has it. A text that is among ``keep``, or in a
    struct there (``struct.field``), is not sent to Python a second time."""
    head, _, child = text_col.partition(".")
    if head in keep:
        at, kind = keep.index(head), docs.select(head).schema[0].dataType
        if not child and isinstance(kind, StringType):
            return docs.select(*keep), lambda b: b.column(at)
        if isinstance(kind, StructType) and kind.names.count(child) == 1 and isinstance(kind[child].dataType, StringType):
            i = kind.names.index(child)
            return docs.select(*keep), lambda b: b.column(at).field(i)
    return docs.select(*keep, F.col(text_col).cast("string").alias("whole__text")), lambda b: b.column(len(keep))


def slices(text: str, cut: re.Pattern, size: int = 1_000_000) -> Iterator[str]:
    """A text in parts of about ``size``, each but the first starting where ``cut`` matches, so that lists of a part's
    words are bounded; one part where it matches nowhere."""
    start = 0
    while len(text) - start > size:
        m = cut.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


SPACE = re.compile(r"\s")


def int_seed(*parts: object) -> int:
    """A 32-bit seed from the text of ``parts``, equal in every process."""
    import zlib

    return zlib.crc32("\x1f".join(map(str, parts)).encode())
