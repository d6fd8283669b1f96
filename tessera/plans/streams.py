"""Registered streaming queries: bounded runs of the streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch
from tessera.sources.tables import table
from tessera.streaming.registry import first_times, read_changes, read_files, windowed_counts, write_first_times, write_split


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type, by a stateful aggregation with a watermark over all that is there.

    The table may be a file or a folder of files. What is there when the run begins is one micro-batch, so that no row
    comes after the watermark. Each trigger writes the counts that it changed; of a window's counts the last one stands.
    """
    folder = scratch(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    events = read_files(spark.readStream.schema(schema), spark, f"{sf_dir}/events.parquet")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    # Times without a zone are taken as UTC, as a watermark needs instants.
    here, utc = F.current_timezone(), F.lit("UTC")
    counts = windowed_counts(events.withColumn("ts", F.convert_timezone(utc, here, F.col("ts").cast("timestamp_ntz")).cast("timestamp")), "ts", "event_type")
    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema("start timestamp, event_type string, n bigint, batch int").parquet(f"{folder}/out")
    last = parts.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.withColumn("start", F.convert_timezone(here, utc, F.col("start").cast("timestamp_ntz")))


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as registry documents: written as JSON, streamed, split, and flattened to version times."""
    folder = scratch(spark, "stream")
    part = table(spark, sf_dir, "part")
    version = F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.lit(0))
    ids = F.when(F.col("p_size") == 1, F.concat(F.lit("_"), F.col("p_brand"))).otherwise(F.col("p_brand"))
    docs = part.select(F.concat_ws("/", ids, F.col("p_partkey").cast("string")).alias("id"), F.create_map(version, F.lit("x")).alias("versions"), F.when(F.col("p_partkey") % 2 == 0, F.create_map(version, F.lit("2020-01-01"))).alias("time"))
    docs.write.json(f"{folder}/in")
    write_split(read_changes(spark, f"{folder}/in"), f"{folder}/valid", f"{folder}/invalid", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("name string, version string, time_raw string").parquet(f"{folder}/valid").select("name", "version", "time_raw")


def stream_first_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as creation times of (user, type) versions, in three micro-batches, the last of them after a restart."""
    folder = scratch(spark, "stream")
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("version"), F.floor("value").cast("string").alias("time_raw"), F.col("event_id").alias("seq"))
    cuts = events.agg(F.expr("percentile_approx(seq, array(0.3D, 0.7D))").alias("c")).first().c or [0, 0]
    part = F.when(F.col("seq") < cuts[0], 0).when(F.col("seq") < cuts[1], 1).otherwise(2)
    for k in range(3):
        events.filter(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")  # files are read in the order of their times
        if k:
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            write_first_times(first_times(stream), f"{folder}/first", f"{folder}/conflicts", f"{folder}/checkpoint").awaitTermination()
    first = spark.read.schema("name string, version string, time_raw string").parquet(f"{folder}/first")
    other = spark.read.schema("name string, version string, n bigint").parquet(f"{folder}/conflicts").groupBy("name", "version").agg(F.sum("n").alias("n_conflicts"))
    return first.select("name", "version", "time_raw").join(other, ["name", "version"], "left").fillna(0, ["n_conflicts"])


QUERIES = {"stream_event_counts": stream_event_counts, "stream_versions": stream_versions, "stream_first_times": stream_first_times}
ORACLE = {
    "stream_first_times": "with e as (select user_id::varchar as name, event_type as version, floor(value)::bigint::varchar t, event_id from events), f as (select name, version, arg_min(t, event_id) time_raw from e group by all) select name, version, time_raw, count(*) filter (t <> time_raw)::bigint n_conflicts from f join e using (name, version) group by all",
    "stream_event_counts": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) n from events group by all",
    "stream_versions": "select p_brand || '/' || p_partkey as name, p_size || '.' || (p_partkey % 10) || '.0' as version, case when p_partkey % 2 = 0 then '2020-01-01' else 'unknown' end as time_raw from part where p_size <> 1",
}
