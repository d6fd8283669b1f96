"""A stored set that grows by deltas: only new rows are written, and a version counts once its pointer stands."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folders of rows that a version reads before all of them are written as one.
MOST_PARTS = 16


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointer(root: str, version: int) -> str:
    return f"{root}/pointers/{version:010}"


def version_of(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    """(number, folders) of the latest version; (0, []) before the first."""
    fs, at = _files(spark, f"{root}/pointers")
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    named = sorted((p.getName() for p in found if p.getName().isdigit()), reverse=True)
    if not named:
        return 0, []
    rows = spark.read.text(f"{root}/pointers/{named[0]}").collect()
    return int(named[0]), json.loads(rows[0].value)


def _commit(spark: SparkSession, root: str, version: int, parts: list[str]) -> bool:
    """Puts the pointer of a version; False if another writer has put one of that number."""
    fs, draft = _files(spark, f"{root}/drafts/{uuid.uuid4().hex}")
    _, at = _files(spark, _pointer(root, version))
    fs.mkdirs(at.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    if not fs.exists(at) and fs.rename(draft, at):  # a rename is whole or not at all
        return True
    fs.delete(draft, False)
    return False


def read_union(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The rows of the latest version; none before the first."""
    parts = version_of(spark, root)[1]
    return spark.read.schema(schema).parquet(*[f"{root}/rows/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def add_to_union(delta: DataFrame, root: str, most_parts: int = MOST_PARTS, tries: int = 5) -> int:
    """Adds the rows of delta that the stored set doesn't hold; the number of the version that has them.

    Equal rows count once, nulls equal one another. Only new rows are written, into a folder of their own; readers see
    them all or none, since they follow the pointer. A delta without news makes no version. A writer that another one was
    faster than reads the new version and merges again; what a failed writer left stands in no pointer. After most_parts
    folders the whole set is written as one.
    """
    spark, schema = delta.sparkSession, delta.schema
    for _ in range(tries):
        version, parts = version_of(spark, root)
        held, news = read_union(spark, root, schema), delta.distinct()
        match = [news[c].eqNullSafe(held[c]) for c in delta.columns]
        if parts:
            news = news.join(held, match, "left_anti")
        whole = len(parts) >= most_parts
        name = uuid.uuid4().hex
        (held.unionByName(news) if whole else news).write.parquet(f"{root}/rows/{name}")
        if not whole and spark.read.schema(schema).parquet(f"{root}/rows/{name}").isEmpty():
            return version
        if _commit(spark, root, version + 1, [name] if whole else [*parts, name]):
            return version + 1
    raise RuntimeError(f"{tries} other writers were faster")
