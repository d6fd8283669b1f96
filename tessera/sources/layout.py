"""Apps and libraries stored as trees of JSON files, read by Spark's readers; keys come from the paths.

apps:  <root>/<type>/<section>/<app>/an/<location or idType>/<id>/<part>.json   (locations head, body; ids n_1, s_name)
libs:  <root>/<name>/<version>/sigs/<file>.json  and  <root>/<name>/_litSig.json
A part of a path that starts with _ is hidden. Trees that Spark's partitioned writer made, whose folders are named
type=<type>/section=<section> and so on, with the part as the last folder, are read as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tarball_parts
from tessera.schemas import LITERAL

APP_TYPES = ("cordova", "react-native")
#: Literals come as plain JSON values; a string and a number stay apart.
STORED_FUNCTION = "array<struct<index:int,type:string,name:string,loc:struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>,fnStatementTypes:array<string>,fnStatementTokens:array<string>>>"
STORED = f"functionSignature {STORED_FUNCTION}, literalSignature string, comments array<string>"


def hidden(name: Column) -> Column:
    return name.startswith("_")


def path_parts(pattern: str, names: list[str], path: str = "_metadata.file_path") -> list[Column]:
    """Groups of a pattern on the path, percent-decoded."""
    return [F.url_decode(F.regexp_extract(F.col(path), pattern, i + 1)).alias(n) for i, n in enumerate(names)]


_APP = r"/(?:type=)?([^/]+)/(?:section=)?([^/]+)/(?:app=)?([^/]+)/(?:an=)?an/(?:location=)?([^/]+)/(?:id=)?([^/]+)/(?:part=([^/]+)/[^/]+|([^/]+))\.json$"
_LIB = r"/(?:name=)?([^/]+)/(?:version=)?([^/]+)/(?:kind=)?sigs/(?:file=([^/]+)/[^/]+|([^/]+))\.json$"


def _json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)


def literals(raw: Column) -> Column:
    """A JSON array of strings and numbers as tagged literals."""
    items = F.from_json(raw, "array<string>")
    quoted = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\.)*"|[^\[\],"\s]+'), 0)
    tag = lambda v, q: F.struct(F.when(q.startswith('"'), "s").otherwise("n").alias("kind"), F.when(q.startswith('"'), v).alias("s"), F.when(~q.startswith('"'), v.try_cast("double")).alias("n"))
    return F.zip_with(items, quoted, tag).cast(T.ArrayType(LITERAL))


def signatures(df: DataFrame) -> DataFrame:
    """Stored signatures in the engine's schema."""
    fn = F.transform("functionSignature", lambda f: F.struct(f["index"].alias("index"), f["type"].alias("type"), f["name"].alias("name"), f["loc"].alias("loc"), f["fnStatementTypes"].alias("types"), f["fnStatementTokens"].alias("tokens")))
    keep = [c for c in df.columns if c not in ("functionSignature", "literalSignature", "comments")]
    return df.select(*keep, fn.alias("functions"), literals(F.col("literalSignature")).alias("literals"), "comments")


def app_files(spark: SparkSession, root: str, kind: str | None = None, part: str = "signature") -> DataFrame:
    """(type, section, app, location, id_type, id, functions, literals, comments) of all files that aren't hidden.

    Files of React Native apps have id_type n or s and the whole rest of their folder's name as id, underscores too.
    """
    if kind is not None and kind not in APP_TYPES:
        raise ValueError(f"no such app type: {kind}")
    keyed = _json(spark, root, STORED).select("*", *path_parts(_APP, ["type", "section", "app", "location", "folder", "_part", "_file"]))
    keyed = keyed.filter(F.concat("_part", "_file") == part).drop("_part", "_file")
    shown = keyed.filter(" and ".join(f"not startswith({c}, '_')" for c in ("type", "section", "app", "location", "folder")))
    if kind:
        shown = shown.filter(F.col("type") == kind)
    native = F.col("type") == "react-native"
    shown = shown.withColumns({"id_type": F.when(native, F.regexp_extract("folder", "^([sn])_", 1)), "id": F.when(native, F.regexp_extract("folder", "^[sn]_(.+)$", 1)).otherwise(F.col("folder"))})
    return signatures(shown.drop("folder"))


def lib_signatures(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """(name, version, file, functions, literals, comments); hidden names and lock files are left out."""
    keyed = _json(spark, root, STORED).select("*", *path_parts(_LIB, ["name", "version", "_folder", "_file"])).filter("name != ''")
    keyed = keyed.withColumn("file", F.concat("_folder", "_file")).drop("_folder", "_file")
    keyed = keyed.filter(~hidden(F.col("name")) & ~F.col("name").endswith(".lock") & ~hidden(F.col("version")))
    return signatures(keyed.filter(F.col("name") == name) if name else keyed)


def lib_names(libs: DataFrame) -> DataFrame:
    return libs.select("name").distinct().orderBy("name")


def lib_versions(libs: DataFrame) -> DataFrame:
    """Versions in the order of their text: 1.10.0 comes before 1.2.0."""
    return libs.select("name", "version").distinct().orderBy("name", "version")


def lib_literals(libs: DataFrame) -> DataFrame:
    """(name, literal): the literals of all versions of a library, each once."""
    return libs.select("name", F.explode("literals").alias("literal")).distinct()


def tarballs(spark: SparkSession, root: str) -> DataFrame:
    """(file, name, version) of the archives in a folder; null where the name can't be read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.tgz").option("recursiveFileLookup", True).load(root)
    file = F.element_at(F.split("path", "/"), -1)
    return df.select(file.alias("file")).select("file", tarball_parts(F.col("file")).alias("p")).select("file", "p.name", "p.version")


def ranked_names(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """(rank, name) of a markdown list of packages, one a line: 1. [name](url) ..."""
    pattern = r"^\s*(\d+)\.\s+\[([^\]]+)\]"
    df = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return df.select(F.regexp_extract("value", pattern, 1).cast("int").alias("rank"), F.regexp_extract("value", pattern, 2).alias("name")).orderBy("rank").limit(most)
