"""Resume, lookup and outcome operators on catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.semver import bounds, comparators, holds, numbers, ordered, reach
from tessera.sources.tables import dealt

#: The labels of an extraction's outcome.
OUTCOMES = ("failParseName", "exclTime", "exclBL", "emptySig", "ok", "fail")


def unfinished(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of todo whose keys aren't done: resumable scheduling by anti join. Null keys are never done."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def analysed(files: DataFrame, signatures: DataFrame, candidates: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Each file with its signature, candidates and result; null where one is missing."""
    out = files
    for df in (signatures, candidates, results):
        out = out.join(df, keys, "left")
    return out


def known_and_missing(wanted: DataFrame, known: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows found, rows to warn of)."""
    return wanted.join(known, keys), wanted.join(known.select(*keys).distinct(), keys, "left_anti")


def with_version(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of wanted (name, version, ...) whose name and version are known together. Null versions are in no table."""
    return wanted.join(known.select("name", "version").distinct(), ["name", "version"], "left_semi")


def truth_classes(truth: DataFrame, known: DataFrame) -> DataFrame:
    """truth (name, version, is_guess, ...) with ``class``: guess, name-missing, version-missing or known.

    Guesses are set apart first; of the others, a name counts as known with any version, a version with its name. A null
    is_guess is none.
    """
    pairs = known.select("name", "version").distinct()
    marked = truth.join(pairs.select("name").distinct().withColumn("_name", F.lit(True)), "name", "left").join(pairs.withColumn("_pair", F.lit(True)), ["name", "version"], "left")
    kind = F.when(F.coalesce("is_guess", F.lit(False)), "guess").when(F.col("_name").isNull(), "name-missing").when(F.col("_pair").isNull(), "version-missing").otherwise("known")
    return marked.withColumn("class", kind).select(*truth.columns, "class")


def blacklisted(libs: DataFrame, blacklist: DataFrame) -> DataFrame:
    """libs (name, version) with ``blacklisted``: all versions, listed ones, or none (absent names too).

    The blacklist is a hand-made table of some hundred names; Spark broadcasts it by its size.
    """
    joined = libs.join(blacklist, "name", "left")
    hit = F.when(F.col("versions") == "all", True).when(F.col("versions") == "list", F.array_contains("version_list", F.col("version"))).otherwise(False)
    return joined.select(*libs.columns, F.coalesce(hit, F.lit(False)).alias("blacklisted"))


def after_cutoff(time_raw: Column, cutoff: Column) -> Column:
    """Strictly after the cutoff; unknown and unreadable times aren't."""
    return F.coalesce(F.try_to_timestamp(time_raw) > cutoff, F.lit(False))


def outcome(parsed: Column, excluded: Column, listed: Column, empty: Column, ok: Column) -> Column:
    """The first rule that applies labels the row."""
    return F.when(~parsed, "failParseName").when(excluded, "exclTime").when(listed, "exclBL").when(empty, "emptySig").when(ok, "ok").otherwise("fail")


def app_type(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """cordova (index.html and cordova.js) before react-native (a bundle) before removed."""
    has = lambda p: F.bool_or(F.col(path).rlike(p))
    flags = files.groupBy(*keys).agg(has(r"(^|/)www/index\.html$").alias("html"), has(r"(^|/)www/cordova\.js$").alias("cordova"), has(r"(^|/)index\.android\.bundle$").alias("bundle"))
    return flags.select(*keys, F.when(F.col("html") & F.col("cordova"), "cordova").when(F.col("bundle"), "react-native").otherwise("removed").alias("type"))


#: Where a module loader looks for a package's main path, and for a package without one.
NODE_ENDINGS, NODE_INDEX = ("", ".js", ".json", ".node", "/index.js", "/index.json", "/index.node"), ("index.js", "index.json", "index.node")


def _path(file: Column) -> Column:
    """A path without empty and single-dot steps."""
    return F.regexp_replace(F.regexp_replace(file, r"(^|/)(\./|/)+", "$1"), r"(?<=.)/\.?$", "")


def _minified(file: Column) -> Column:
    """The name of a file's minified neighbour: .min before the last extension, or at the end."""
    return F.regexp_replace(file, r"^(.*?[^/])(\.[^./]*)?$", "$1.min$2")


def main_files(package: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, version, file, pos) of a package's main files that exist, numbered from 0.

    package: (name, version, bower, component: arrays of paths, node: the main path of its package file). The first list
    with a script counts, and its scripts only; else the file that a module loader finds for the main path or as the
    package's index; else four guesses from name and version. Each file's minified neighbour follows it. A list that
    names a neighbour itself gives it twice. existing: (name, version, file). Steps upwards in paths aren't resolved.
    """
    scripts = lambda c: F.filter(F.transform(c, _path), lambda f: f.rlike(r"[^/]\.js$"))
    listed = F.when(F.size(scripts(F.col("bower"))) > 0, scripts(F.col("bower"))).when(F.size(scripts(F.col("component"))) > 0, scripts(F.col("component")))
    node = F.concat(
        F.coalesce(F.transform(F.array(*[F.concat("node", F.lit(e)) for e in NODE_ENDINGS]), _path), F.array().cast("array<string>")), F.array(*map(F.lit, NODE_INDEX))
    )
    full = F.concat_ws("-", "name", "version")
    guessed = F.array(*[F.concat(F.lit(d), n, F.lit(".js")) for d in ("dist/", "") for n in (F.col("name"), full)])
    tries = lambda files, stage: F.transform(files, lambda f, k: F.struct(F.lit(stage).alias("stage"), k.alias("k"), f.alias("file")))
    each = F.when(listed.isNotNull(), tries(listed, 0)).otherwise(F.concat(tries(node, 1), tries(guessed, 2)))
    tried = package.select("name", "version", F.explode(each).alias("t")).select("name", "version", "t.*")
    tried = tried.select("name", "version", "stage", "k", F.posexplode(F.array("file", _minified(F.col("file")))).alias("min", "file")).filter("file is not null")
    # Lists of files are many times what their sources' sizes let the planner expect: never sent to the driver and all tasks.
    known = existing.select("name", "version", _path(F.col("file")).alias("file")).distinct().hint("merge")
    found = tried.join(known, ["name", "version", "file"], "left_semi")
    by = Window.partitionBy("name", "version")
    loaded = F.min(F.when((F.col("stage") == 1) & (F.col("min") == 0), F.col("k"))).over(by)
    found = found.withColumn("loaded", loaded).filter((F.col("stage") == 0) | ((F.col("stage") == 1) & (F.col("k") == F.col("loaded"))) | ((F.col("stage") == 2) & F.col("loaded").isNull()))
    return found.select("name", "version", "file", (F.row_number().over(by.orderBy("stage", "k", "min")) - 1).alias("pos"))


def vulnerable(libs: DataFrame, vulns: DataFrame) -> DataFrame:
    """(name, version, id) of each library version within a vulnerable range; ranges of a row are alternatives.

    Each distinct range is parsed once and meets only versions of the major numbers that it reaches or, if it reaches one
    minor number, of that one; those are decided by comparisons in the JVM. Its ids follow by an equi-join. Libraries
    without an entry, and invalid ranges, give no rows.
    """
    flat = vulns.select("name", F.concat_ws(" || ", "ranges").alias("range"), "ids")
    ranges = flat.select("name", "range").distinct().withColumns({"bounds": bounds(F.col("range")), "reach": reach(F.col("range"))}).filter("bounds is not null")
    ranges = dealt(ranges.withColumn("bounds", comparators(F.col("bounds"))), F.col("name"), F.col("range"))
    own = libs.select("name", "version", numbers(F.col("version")).alias("v")).filter("v is not null")
    own = own.select("name", "version", ordered(F.col("v")).alias("v"))
    narrow = F.forall("reach", lambda r: r["minor"].isNotNull())
    one = ranges.filter(narrow).select("name", "range", "bounds", F.explode(F.array_distinct("reach")).alias("r"))
    one = own.join(one, (own["name"] == one["name"]) & (F.col("v.a") == F.col("r.low")) & (F.col("v.b") == F.col("r.minor"))).filter(holds(F.col("v"), F.col("bounds"))).select(own["name"], "version", "range")
    majors = own.select("name", F.col("v.a").alias("major")).distinct()
    wide = ranges.filter(~narrow).join(majors, "name").filter(F.exists("reach", lambda r: (r["low"] <= F.col("major")) & (F.col("major") <= r["high"])))
    more = own.withColumn("major", F.col("v.a")).join(wide, ["name", "major"]).filter(holds(F.col("v"), F.col("bounds"))).select("name", "version", "range")
    ids = flat.select("name", "range", F.explode("ids").alias("id"))
    return one.unionByName(more).join(ids, ["name", "range"]).select("name", "version", "id")


def detection(truth: DataFrame, rank: DataFrame, secondary: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """truth with where its library was found: top, secondary or missed."""
    first = lambda df, c: df.groupBy(*keys, name).agg(F.min("top").alias(c))
    joined = truth.join(first(rank, "top"), [*keys, name], "left").join(first(secondary, "second"), [*keys, name], "left")
    return joined.withColumn("found", F.when(F.col("top").isNotNull(), "top").when(F.col("second").isNotNull(), "secondary").otherwise("missed"))


def match_count(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with how many rows of right have its keys: none, one or more."""
    n = right.groupBy(*keys).agg(F.count("*").alias("_n"))
    return left.join(n, keys, "left").withColumn("matches", F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "one").otherwise("more")).drop("_n")


def job_matrix(methods: DataFrame, files: DataFrame, libs: DataFrame) -> DataFrame:
    """Every method on every file against every library, once each: the product is the plan that was asked for."""
    return methods.distinct().join(files.distinct()).join(libs.distinct())
