"""Explicit schemas of the stored tables: reads never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

POSITION = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
LOCATION = T.StructType([T.StructField("start", POSITION), T.StructField("end", POSITION)])

#: One function of a source file: a bag of statement tokens and one of statement types.
FUNCTION = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("loc", LOCATION),
    T.StructField("types", T.ArrayType(T.StringType())),
    T.StructField("tokens", T.ArrayType(T.StringType())),
])

#: A literal is a string (kind s) or a number (kind n): 1 and '1' differ.
LITERAL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType())])

SIGNATURE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("id_type", T.StringType()),
    T.StructField("functions", T.ArrayType(FUNCTION)),
    T.StructField("literals", T.ArrayType(LITERAL)),
    T.StructField("comments", T.ArrayType(T.StringType())),
])

#: {1, -1, -1} stands for "certain, not computed".
SCORE = T.StructType([T.StructField("val", T.DoubleType()), T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])
MAPPING = T.ArrayType(T.StructType([T.StructField("unknown_idx", T.IntegerType()), T.StructField("lib_idx", T.IntegerType()), T.StructField("prob", SCORE)]))

APP = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "section", "app")])
APP_FILE = T.StructType([*APP.fields, T.StructField("location", T.StringType()), T.StructField("id_type", T.StringType()), T.StructField("id", T.StringType())])
LIB = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "version", "file")])
LIB_VERSION = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "version", "time_raw")])
VULN = T.StructType([T.StructField("name", T.StringType()), T.StructField("ranges", T.ArrayType(T.StringType())), T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("published", T.StringType())])
BLACKLIST = T.StructType([T.StructField("name", T.StringType()), T.StructField("versions", T.StringType()), T.StructField("version_list", T.ArrayType(T.StringType()))])

#: A registry document of the change feed.
REGISTRY_DOC = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("versions", T.MapType(T.StringType(), T.StringType())),
    T.StructField("time", T.MapType(T.StringType(), T.StringType())),
])
