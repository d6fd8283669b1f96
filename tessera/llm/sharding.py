"""Contiguous, byte-balanced shards from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

N_SHARDS = 24
#: Bytes that a document costs besides its text.
RECORD_OVERHEAD = 8


def text_size(text: str | Column) -> Column:
    """UTF-8 bytes of the text plus the record overhead; a null text has no bytes."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long") + RECORD_OVERHEAD


def shard_by_bytes(df: DataFrame, size: Column, order: list[str], n_shards: int = N_SHARDS) -> DataFrame:
    """All rows and columns of df plus ``size``, ``shard`` and ``slot``.

    Rows are put in one global order (``order``, nulls first; ties are broken by input position, so repeated rows are
    dealt like any others). Range partitions are written with their number; their totals, as many rows as partitions,
    give each partition the bytes and rows before it. A row belongs to the shard that holds its middle byte when the
    whole is cut at equal targets, so shards are contiguous and differ from the target by one row's size at most.
    ``slot`` counts from 0 without gaps within the shard. An empty df gives no rows; with more shards than rows, some
    shards are empty. A column of df named size, shard or slot is replaced; others keep their names whatever they are.

    Only what df carries is shuffled: select ids and sizes first, and join or write the texts by shard afterwards.
    """
    spark, kept = df.sparkSession, df.drop("size", "shard", "slot").columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), size.alias("size"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.monotonically_increasing_id().alias("rid"))
    by = [F.col(c).asc_nulls_first() for c in [*(f"o{k}" for k in range(len(order))), "rid"]]
    ranged = materialise(keyed.repartitionByRange(parts, *by).withColumn("pid", F.spark_partition_id()), "ranged")
    before, every = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("pid").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    prefix = totals.select("pid", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("b").over(every).alias("whole"))
    upto = Window.partitionBy("pid").orderBy(*by)
    placed = (
        ranged.withColumn("run", F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("pos", F.row_number().over(upto).cast("long"))
        .join(F.broadcast(prefix), "pid")  # one row for each range partition: bounded by the partition count
        .withColumn("idx", F.col("n0") + F.col("pos") - 1)
        .withColumn("mid", 2 * (F.col("b0") + F.col("run")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast((cast(mid as decimal(38,0)) * {n_shards}) div (2 * whole) as int)"))
        .withColumn("shard", F.least(F.col("shard"), F.lit(n_shards - 1)))
    )
    first = placed.groupBy("shard").agg(F.min("idx").alias("first"))
    out = placed.join(F.broadcast(first), "shard")  # n_shards rows at most
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "size", "shard", (F.col("idx") - F.col("first")).alias("slot"))


def assign(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32 (0 for a null text), shard and slot of each document, in the order of doc_id."""
    slim = docs.select("doc_id", F.octet_length("text").alias("_len"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    sized = F.coalesce(F.col("_len"), F.lit(0)).cast("long") + RECORD_OVERHEAD
    return shard_by_bytes(slim, sized, ["doc_id", "text_crc32"], n_shards).drop("_len")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
