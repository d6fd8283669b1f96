"""Tables that a job writes for itself in the folder that the cluster shares, and removes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared place that the cluster names; it is removed when the driver process ends.

    A machine-local place is taken only where none is named and the session is a local one, as in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written[path] = spark
    return path


def _remove(path: str) -> None:
    spark = _written.pop(path)
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def _remove_all() -> None:
    for path in list(_written):
        _remove(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read back: its lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*dfs: DataFrame) -> None:
    """Removes tables of ``stored`` that nothing still to be computed reads."""
    for df in dfs:
        if (path := vars(df).get("stored_at")) in _written:
            _remove(path)
