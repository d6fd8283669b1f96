"""The benchmark tables as the engine's entities: files, functions, literals and libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *by: Column) -> DataFrame:
    """df over several partitions for each core: a small file is one partition, however much work its rows are."""
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, int(conf)), *by)


def lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, idx, line): the non-empty lines of a text; idx counts empty ones too."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("idx", "line")).filter("line != ''")


def words(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, word): the words of a text, repeats included."""
    return df.select(*keys, F.explode(F.split(F.translate(text, "\n", " "), " ")).alias("word")).filter("word != ''")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a line is a function, its words are the tokens, the first word is its name. Sources are libraries."""
    docs = lines(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    return docs.select("doc_id", "source", "lang", "idx", "line", F.split("line", " ").alias("tokens"), F.element_at(F.split("line", " "), 1).alias("name"))


def library_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of each source; lib_idx keeps the order of documents and lines without a window over a whole source."""
    return functions(spark, sf_dir).withColumn("idx", F.col("doc_id") * (1 << 32) + F.col("idx"))


def conversation_functions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A conversation's user turns as the unknown file and its assistant turns as the library: turns are functions."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    fn = turns.select("conv_id", F.col("conv_id").alias("lib_id"), "role", F.col("turn").cast("int").alias("idx"), F.element_at(F.split("text", " "), 1).alias("name"), F.split(F.translate("text", "\n", " "), " ").alias("tokens"))
    fn = fn.withColumn("types", F.transform("tokens", lambda t: F.substring(t, 1, 2)))
    user, other = fn.filter("role = 'user'"), fn.filter("role != 'user'")
    return user.select("conv_id", "idx", "name", "tokens", "types"), other.select("lib_id", "idx", "name", "tokens", "types")
