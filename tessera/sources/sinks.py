"""Writers: conservative tables, pretty JSON, CSV matrices, finished lists, quarantine, and report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import csv_line, fraction_tex


def save(df: DataFrame, path: str, conservative: bool = True) -> None:
    """Conservative: what exists stays as it is; else it is replaced."""
    df.write.mode("ignore" if conservative else "overwrite").parquet(path)


def save_json(df: DataFrame, path: str, conservative: bool = True) -> None:
    df.write.mode("ignore" if conservative else "overwrite").json(path)


def matrix_csv(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): cells joined by commas, without header or quotes; only the first comma in a cell is replaced."""
    return df.select(csv_line(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))


def finished(done: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """The finished list: what was done before and now, once each, in order."""
    return previous.select(*keys).unionByName(done.select(*keys)).distinct().orderBy(*keys)


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows that failed): failures are set aside, they don't end the job."""
    good = F.coalesce(ok, F.lit(False))
    return df.filter(good), df.filter(~good)


def tex_rows(df: DataFrame, label: str, num: str, den: str) -> DataFrame:
    """(line) of a table with fractions and percents, columns padded to the longest."""
    cell = fraction_tex(F.col(num), F.col(den))
    width = F.max(F.length(label)).over(Window.partitionBy())
    return df.select(F.concat_ws(" & ", F.rpad(label, width, " "), cell).alias("line"))


def mapping_lines(df: DataFrame) -> DataFrame:
    """(file, line): pairs of a mapping, best first, rounded to six places."""
    line = F.format_string("%s -> %s: %.6f (%d/%d)", F.lpad(F.col("unknown_idx").cast("string"), 6, " "), F.lpad(F.col("lib_idx").cast("string"), 6, " "), F.round("val", 6), "num", "den")
    return df.orderBy(F.desc("val"), "unknown_idx").select("file_key", line.alias("line"))


def copy_table(df: DataFrame, path: str, partition: list[str] | None = None, conservative: bool = True) -> None:
    """Analysed outputs copied to another place, in the same folders if they are named."""
    writer = df.write.mode("ignore" if conservative else "overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
