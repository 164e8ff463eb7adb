"""Tables between the steps of a run, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def staging_folder(spark: SparkSession) -> str:
    """A folder of its own under ``spark.checkpoint.dir``; where that is unset, in one JVM, a temporary one that is
    removed at exit, and elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        if key not in _local:
            _local[key] = tempfile.mkdtemp(prefix="blockloom-stage-")
            atexit.register(shutil.rmtree, _local[key], ignore_errors=True)
        base = f"file://{_local[key]}"
    return f"{base.rstrip('/')}/blockloom-stages"


def staged(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table: made once, however many steps read it, and not again where an executor is lost."""
    path = f"{staging_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
