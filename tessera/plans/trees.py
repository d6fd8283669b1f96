"""Registered queries of stored trees, lists and writers: what they read back is written from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import registry
from tessera.sources import archives, layout, sinks
from tessera.sources.scratch import scratch
from tessera.sources.tables import table
from tessera.sources.unions import add_to_union, read_union, version_of

QUERIES, ORACLE, query = registry()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as signatures: one function of the first three words, a text and a number as literals, a comment."""
    words = F.split(F.regexp_replace("text", r"[^A-Za-z0-9 ]", ""), " ")
    first = lambda i: F.get(words, F.lit(i))
    place = F.struct(F.lit(1).alias("line"), F.lit(0).alias("column"))
    fn = F.struct(F.lit(0).alias("index"), F.lit("fn").alias("type"), first(0).alias("name"), F.struct(place.alias("start"), place.alias("end")).alias("loc"), F.array(F.lit("t_x")).alias("fnStatementTypes"), F.slice(words, 1, 3).alias("fnStatementTokens"))
    k = F.col("item_id")
    literal = F.parse_json(F.concat(F.to_json(F.array(first(0))).substr(F.lit(1), F.length(F.to_json(F.array(first(0)))) - 1), F.lit(","), (k + 10).cast("string"), F.lit("]")))
    return table(spark, sf_dir, "benchmark").select(k.alias("k"), F.array(fn).alias("functionSignature"), literal.alias("literalSignature"), F.array(first(1)).alias("comments"))


def _app_tree(spark: SparkSession, sf_dir: str) -> str:
    k, root = F.col("k"), scratch(spark, "apps")
    native = k % 2 == 1
    number = k.cast("string")
    rows = _items(spark, sf_dir).select(
        "functionSignature", "literalSignature", "comments", F.when(native, "react-native").otherwise("cordova").alias("type"), F.concat(F.lit("s"), k % 3).alias("section"),
        F.concat(F.when(k % 7 == 0, "_app.").otherwise("app."), number).alias("app"), F.lit("an").alias("an"), F.when(native, "bundle").when(k % 4 == 0, "head").otherwise("body").alias("location"),
        F.when(native & (k % 3 == 0), F.concat(F.lit("s_a_b"), number)).when(native, F.concat(F.lit("n_"), number)).otherwise(F.lpad(number, 6, "0")).alias("id"), F.lit("signature").alias("part"),
    )
    rows.write.partitionBy("type", "section", "app", "an", "location", "id", "part").json(root)
    return root


_BASE = "b as (select item_id k, string_split(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' ') w from benchmark)"
_APPS = f"""
with {_BASE}
select case when k % 2 = 1 then 'react-native' else 'cordova' end as type, 's' || k % 3 section, 'app.' || k app,
       case when k % 2 = 1 then 'bundle' when k % 4 = 0 then 'head' else 'body' end as location,
       case when k % 2 = 1 and k % 3 = 0 then 's' when k % 2 = 1 then 'n' end id_type,
       case when k % 2 = 1 and k % 3 = 0 then 'a_b' || k when k % 2 = 1 then k::varchar else lpad(k::varchar, 6, '0') end id,
       w[1] as name, array_to_string(w[1:3], '|') tokens, 's:' || w[1] || '|n:' || (k + 10) || '.0' literals, w[2] as comment
from b where k % 7 <> 0
"""


def _shown(files: DataFrame, *keys: str) -> DataFrame:
    literals = F.transform("literals", lambda v: F.concat_ws(":", v["kind"], F.coalesce(v["s"], v["n"].cast("string"))))
    return files.select(*keys, F.col("functions")[0]["name"].alias("name"), F.array_join(F.col("functions")[0]["tokens"], "|").alias("tokens"), F.array_join(literals, "|").alias("literals"), F.col("comments")[0].alias("comment"))


_APP_KEYS = ("type", "section", "app", "location", "id_type", "id")


@query("stored_app_files", _APPS)
def stored_app_files(spark, sf_dir):
    return _shown(layout.app_files(spark, _app_tree(spark, sf_dir)), *_APP_KEYS)


@query("stored_cordova_files", f"select * from ({_APPS}) where type = 'cordova'")
def stored_cordova_files(spark, sf_dir):
    return _shown(layout.app_files(spark, _app_tree(spark, sf_dir), "cordova"), *_APP_KEYS)


@query("stored_native_files", f"select * from ({_APPS}) where type = 'react-native'")
def stored_native_files(spark, sf_dir):
    return _shown(layout.app_files(spark, _app_tree(spark, sf_dir), "react-native"), *_APP_KEYS)


@query("stored_apps", f"select distinct type, section, app from ({_APPS})")
def stored_apps(spark, sf_dir):
    return layout.app_files(spark, _app_tree(spark, sf_dir)).select("type", "section", "app").distinct()


def _libraries(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    k, root = F.col("k"), scratch(spark, "libs")
    named = F.when(k % 5 == 0, F.concat(F.lit("_lib"), k % 5)).when(k % 5 == 1, "lib1.lock").otherwise(F.concat(F.lit("lib"), k % 5))
    version = F.concat(F.when(k % 11 == 0, "_").otherwise(""), k.cast("string"), F.lit(".0.0"))
    rows = _items(spark, sf_dir).select("functionSignature", "literalSignature", "comments", named.alias("name"), version.alias("version"), F.lit("sigs").alias("kind"), F.lit("0000").alias("file"))
    rows.write.partitionBy("name", "version", "kind", "file").json(root)
    return layout.lib_signatures(spark, root, name)


_LIBS = f"""
with {_BASE}
select 'lib' || k % 5 lib, k || '.0.0' as version, '0000' file, w[1] as name, array_to_string(w[1:3], '|') tokens, 's:' || w[1] || '|n:' || (k + 10) || '.0' literals, w[2] as comment
from b where k % 5 > 1 and k % 11 <> 0
"""


@query("stored_lib_signatures", _LIBS)
def stored_lib_signatures(spark, sf_dir):
    return _shown(_libraries(spark, sf_dir).withColumnRenamed("name", "lib"), "lib", "version", "file")


@query("stored_lib_of_name", f"select * from ({_LIBS}) where lib = 'lib2'")
def stored_lib_of_name(spark, sf_dir):
    return _shown(_libraries(spark, sf_dir, "lib2").withColumnRenamed("name", "lib"), "lib", "version", "file")


@query("stored_lib_names", f"select distinct lib as name from ({_LIBS})")
def stored_lib_names(spark, sf_dir):
    return layout.lib_names(_libraries(spark, sf_dir))


@query("stored_lib_versions", f"select distinct lib as name, version from ({_LIBS})")
def stored_lib_versions(spark, sf_dir):
    return layout.lib_versions(_libraries(spark, sf_dir))


@query("stored_lib_literals", f"select distinct lib as name, unnest(string_split(literals, '|')) literal from ({_LIBS})")
def stored_lib_literals(spark, sf_dir):
    found = layout.lib_literals(_libraries(spark, sf_dir))
    value = F.concat_ws(":", "literal.kind", F.coalesce("literal.s", F.col("literal.n").cast("string")))
    return found.select("name", value.alias("literal")).distinct()


@query("ranked_packages", "select item_id::int as rank, 'pkg-' || item_id as name from benchmark where item_id > 0 order by item_id limit 12")
def ranked_packages(spark, sf_dir):
    folder, k = scratch(spark, "ranks"), F.col("item_id").cast("string")
    line = F.concat(k, F.lit(". [pkg-"), k, F.lit("](https://x/"), k, F.lit(") - used"))
    lines = table(spark, sf_dir, "benchmark").filter("item_id > 0").select(F.explode(F.array(line, F.lit("# a heading"))).alias("value"))
    lines.write.text(folder)
    return layout.ranked_names(spark, folder, 12)


@query("saved_conservatively", "select c_custkey, 1 as value from customer union all select s_suppkey, 2 from supplier")
def saved_conservatively(spark, sf_dir):
    """The first table stays where a conservative write comes second; the second one comes where it replaces."""
    kept, replaced = scratch(spark, "kept"), scratch(spark, "replaced")
    one = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("value"))
    two = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit(2).alias("value"))
    for df in (one, two):
        sinks.save(df, kept)
        sinks.save(df, replaced, conservative=False)
    return spark.read.parquet(kept).unionByName(spark.read.parquet(replaced))


@query("saved_json", "select n_nationkey, n_name, case when n_regionkey > 0 then n_regionkey end n_regionkey from nation")
def saved_json(spark, sf_dir):
    folder = scratch(spark, "json")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey"))
    for df in (nation, nation.limit(1)):
        sinks.save_json(df, folder)
    return spark.read.schema(nation.schema).json(folder)


@query("copied_table", "select s_suppkey, s_name, s_nationkey from supplier")
def copied_table(spark, sf_dir):
    folder = scratch(spark, "copy")
    sinks.copy_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), folder, ["s_nationkey"])
    return spark.read.schema("s_suppkey bigint, s_name string, s_nationkey int").parquet(folder)


@query("literal_union_grown", r"""
with w as (select source, doc_id % 3 step, unnest(regexp_extract_all(text, '[A-Za-z]+')) literal from documents),
f as (select source, literal, min(step) step from w group by all)
select source, step::int step, count(*)::bigint n_new from f group by all""")
def literal_union_grown(spark, sf_dir):
    """The literals of each source, merged from three deltas and one that brings nothing; n_new are those a step added."""
    root, docs = scratch(spark, "union"), table(spark, sf_dir, "documents")
    each = docs.select("source", (F.col("doc_id") % 3).alias("step"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("literal"))
    schema, added = "source string, literal string", []
    for step in (0, 1, 2, 1):
        before = version_of(spark, root)[1]
        add_to_union(each.filter(F.col("step") == step).select("source", "literal"), root)
        added += [(step, part) for part in version_of(spark, root)[1] if part not in before]
    parts = [spark.read.schema(schema).parquet(f"{root}/rows/{part}").groupBy("source").agg(F.count("*").alias("n_new")).withColumn("step", F.lit(step)) for step, part in added]
    out = read_union(spark, root, schema).limit(0).select("source", F.lit(0).alias("step"), F.lit(0).cast("long").alias("n_new"))
    for part in parts:
        out = out.unionByName(part.select("source", "step", "n_new"))
    return out


@query("archive_contents", """
select 'page' || page_id % 20 as name, '1.' || page_id % 3 || '.0' as version, 'pages/' || page_id || '.html' as path, octet_length(encode(coalesce(html, '')))::int n_bytes, md5(coalesce(html, '')) as digest from pages""")
def archive_contents(spark, sf_dir):
    """The pages packed into gzipped archives, one for each name and version, and read back file by file."""
    root, k = scratch(spark, "archives"), F.col("page_id")
    html = F.coalesce("html", F.lit(""))
    archive = F.concat(F.lit("page"), (k % 20).cast("string"), F.lit("-1."), (k % 3).cast("string"), F.lit(".0.tgz"))
    rows = table(spark, sf_dir, "pages").select(archive.alias("archive"), archives.tar_block(F.concat(F.lit("package/pages/"), k.cast("string"), F.lit(".html")), html).alias("value"))
    # A row is an archive, and the line end its empty last block; Spark's text writer gzips it.
    whole = rows.groupBy("archive").agg(F.array_join(F.array_sort(F.collect_list("value")), "").alias("value"))
    whole.write.partitionBy("archive").option("lineSep", "\0" * 512).option("compression", "gzip").text(root)
    found = archives.package_files(archives.archive_files(spark, root, "*.gz"), F.regexp_extract("archive", "archive=([^/]+)", 1))
    return found.select("name", "version", "path", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("digest"))
