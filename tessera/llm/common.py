"""Shared plumbing of the training-data operators: tables, cut points, hot-key joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; at most as many keys can be hot, which bounds the broadcast below.
HOT_KEYS = 1000

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where none is configured and the session is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


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


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; what it holds is removed when the driver process ends."""
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written[path] = spark
    return path


def materialise(df: DataFrame, label: str, **options: int) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation.

    options go to the writer.
    The table is removed by ``release``, or when the driver process ends.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*dfs: DataFrame) -> None:
    """Removes tables that ``materialise`` returned, once nothing that is still to be computed reads them.

    Then asks the JVM to collect its garbage, as Spark's cleaner drops the shuffle files of finished jobs only after that.
    """
    for df in dfs:
        if (path := vars(df).get("written_at")) in _written:
            _remove(path)
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.sparkContext._jvm.System.gc()


def lookup(rows: DataFrame, groups: DataFrame, key: str, count: str, spread: str, total: int) -> DataFrame:
    """Left join of rows with groups (one row for each key, count = rows of that key), safe for hot keys.

    Keys with at least total / HOT_KEYS rows, of which there are HOT_KEYS at most, are broadcast; their rows are dealt
    over the other join by the integer column ``spread``, so no task gets a whole hot group. No row is lost or doubled.
    """
    names = [c for c in groups.columns if c != key]
    floor = max(1, -(-total // HOT_KEYS))
    hot = groups.filter(F.col(count) >= floor).select(key, F.struct(*names).alias("_hot"))
    # Always 0, but not a literal: the optimiser would take a constant out of the join's keys, and with it the salt.
    zero = F.pmod(F.col(count), F.lit(1)).cast("int").alias("_salt")
    cold = groups.filter(F.col(count) < floor).select(key, zero, F.struct(*names).alias("_cold"))
    left = rows.join(F.broadcast(hot), key, "left")
    left = left.withColumn("_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int")))
    out = left.join(cold, [key, "_salt"], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in names])


def unit_hash(*cols: str | Column) -> Column:
    """A number in [0, 1) from the columns: the same on every run and machine."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / float(1 << 53)
