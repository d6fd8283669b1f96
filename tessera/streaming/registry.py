"""Change feed of package documents: split into valid and invalid, and flattened to version times."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.functions.semver import is_valid
from tessera.schemas import REGISTRY_DOC


def is_package() -> Column:
    """A document has an id that starts with neither _ nor ., and versions."""
    return F.col("id").isNotNull() & ~F.col("id").rlike(r"^[_.]") & F.col("versions").isNotNull()


def version_times(docs: DataFrame) -> DataFrame:
    """(name, version, time_raw): valid versions among the keys of versions and time; an absent time is 'unknown'."""
    keys = F.array_union(F.map_keys("versions"), F.coalesce(F.map_keys("time"), F.array().cast("array<string>")))
    flat = docs.filter(is_package()).select(F.col("id").alias("name"), "time", F.explode(keys).alias("version"))
    return flat.filter(is_valid(F.col("version"))).select("name", "version", F.coalesce(F.try_element_at("time", F.col("version")), F.lit("unknown")).alias("time_raw"))


def read_changes(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON documents, one a line, from files that arrive in a folder."""
    reader = spark.readStream.schema(REGISTRY_DOC)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def read_files(reader: DataStreamReader, spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet table at path: a folder of files, which may grow, or one file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())  # a source's root is a folder


def write_split(docs: DataFrame, valid_path: str, invalid_path: str, checkpoint: str) -> StreamingQuery:
    """Appends version times and rejected documents to two tables, all that is available now.

    A batch that is run again writes to the folder of its number and replaces it, so restarts leave no repeats.
    """

    def both(batch: DataFrame, number: int) -> None:
        version_times(batch).write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        batch.filter(~F.coalesce(is_package(), F.lit(False))).write.mode("overwrite").parquet(f"{invalid_path}/batch={number}")

    return docs.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FIRST_TIMES = "name string, version string, time_raw string, other string, n bigint"
#: State is kept for so many buckets of names: a call of Python for each costs far less than one for each version. Rows are given out so many at once.
BUCKETS, ROWS = 1024, 10_000


def first_times(versions: DataFrame) -> DataFrame:
    """A stream of (name, version, time_raw, other, n) from one of (name, version, time_raw, seq): the first time of each version wins.

    A version's first sighting gives a row without ``other``; each other time that a micro-batch brings gives one with how
    often it came there. The first times are kept as state, keyed by a bucket of names, so they hold over all batches and
    restarts; within a batch the least seq is first. A task holds the first and the new distinct times of one bucket at once.
    """

    def settle(key, frames, state):
        firsts = {(n, v): t for n, v, t in json.loads(state.get[0])} if state.exists else {}
        seen: dict[tuple, dict[str, list[int]]] = {}
        for frame in frames:
            for name, version, time, seq in zip(*(frame[c].tolist() for c in ("name", "version", "time_raw", "seq")), strict=True):
                had = seen.setdefault((name, version), {}).setdefault(time, [seq, 0])
                had[0], had[1] = min(had[0], seq), had[1] + 1
        rows, known = [], len(firsts)
        for own, times in seen.items():
            if own not in firsts:
                firsts[own] = min(times, key=lambda t: (times[t][0], t))
                rows.append((*own, firsts[own], None, None))
            rows += [(*own, firsts[own], time, n) for time, (_, n) in sorted(times.items()) if time != firsts[own]]
        if len(firsts) > known:
            state.update((json.dumps([(*own, time) for own, time in firsts.items()]),))
        for i in range(0, len(rows), ROWS):
            yield pd.DataFrame(rows[i : i + ROWS], columns=["name", "version", "time_raw", "other", "n"]).astype({"n": "Int64"})

    bucket = F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).alias("bucket")
    keyed = versions.select(bucket, "name", "version", F.coalesce("time_raw", F.lit("unknown")).alias("time_raw"), F.col("seq").cast("long").alias("seq"))
    return keyed.groupBy("bucket").applyInPandasWithState(settle, FIRST_TIMES, "firsts string", "append", GroupStateTimeout.NoTimeout)


def write_first_times(rows: DataFrame, first_path: str, conflict_path: str, checkpoint: str) -> StreamingQuery:
    """Appends first times and conflicts to two tables; a batch that is run again replaces its own folder."""

    def both(batch: DataFrame, number: int) -> None:
        batch.filter("other is null").select("name", "version", "time_raw").write.mode("overwrite").parquet(f"{first_path}/batch={number}")
        batch.filter("other is not null").write.mode("overwrite").parquet(f"{conflict_path}/batch={number}")

    return rows.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and key, with a watermark; works on streams and tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
