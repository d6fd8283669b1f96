"""Greedy peeling: libraries explain functions of a file one after another, exact matches first.

A file and its candidates of up to TASK_FUNCTIONS functions are peeled in one task. Larger ones advance together, candidate
by candidate, over a stored table of the functions that each file has left, with equal results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.assign import DEFAULT_METHOD, EXACT_METHODS, TASK_FUNCTIONS, Fn, functions_of, match_pairs, method
from tessera.operators.pairing import bag_key
from tessera.sources.scratch import dropped, stored

#: Fixed value: matches kept for each candidate.
MATCHES = 5
OUT = (("phase", "string"), ("lib", "string"), ("top", "int"), ("match", "int"), ("version", "string"), ("lib_file", "string"), ("num", "bigint"), ("den", "bigint"), ("val", "double"), ("mapped", "array<int>"))


def match_candidate(remaining: list[Fn], versions: list[tuple[str, str, list[Fn]]], run, stop_at_exact: bool) -> list[tuple]:
    """(val, num, den, version, file, mapping) of the best version files, best first; ties stay in the order given."""
    found = []
    for version, file, fns in versions:
        m = run(remaining, fns)
        if m.score[0] > 0:
            found.append((*m.score, version, file, {remaining[u].index: (fns[b].index, s) for u, (b, s) in m.pairs.items()}))
        if stop_at_exact and m.score[0] == 1:
            break
    return sorted(found, key=lambda x: -x[0])[:MATCHES]


def peel(fns: list[Fn], candidates: list[tuple[str, float]], libs: dict[str, list[tuple[str, str, list[Fn]]]], run) -> tuple[list, list, list[Fn]]:
    """(rank, secondary, remaining): candidates in order of their index; those that match exactly first, then the others.

    The functions that a library's best match maps are removed before the next candidate is tried.
    """
    rank, later, remaining = [], [], list(fns)
    for top, (name, _) in enumerate(sorted(candidates, key=lambda c: -c[1]), 1):
        matches = match_candidate(remaining, libs.get(name, []), run, True)
        if matches and matches[0][0] == 1:
            rank.append((name, top, matches))
            remaining = [f for f in remaining if f.index not in matches[0][5]]
        else:
            later.append((name, top))
    secondary = []
    for name, top in later:
        if matches := match_candidate(remaining, libs.get(name, []), run, False):
            secondary.append((name, top, matches))
            remaining = [f for f in remaining if f.index not in matches[0][5]]
    return rank, secondary, remaining


def peel_files(files: DataFrame, candidates: DataFrame, libs: DataFrame, file: str = "file_key", name: str | None = None, task_functions: int = TASK_FUNCTIONS) -> DataFrame:
    """(file, phase, name, top, match, version, lib_file, num, den, val, mapped) rows, and one of phase 'remaining' for
    each file with what nothing explains, in ``mapped``.

    files: (file, idx, name, tokens, types). candidates: (file, lib, val). libs: (lib, version, lib_file, pos, idx, name,
    tokens, types) with pos the order in which versions are tried, each in a place of its own. A file whose functions and
    whose candidates' are task_functions at most is peeled in one task, others by ``peel_large``; a file with no
    candidates keeps all its functions.
    """
    method(name)
    candidates = stored(candidates.select(file, F.col("lib").cast("string").alias("lib"), "val"), "candidates")  # they are read several times
    libs = libs.withColumns({"lib": F.col("lib").cast("string"), "pos": F.col("pos").cast("int")})
    own = files.groupBy(file).agg(F.count("*").alias("_n"))
    theirs = candidates.join(libs.groupBy("lib").agg(F.count("*").alias("_m")), "lib").groupBy(file).agg(F.sum("_m").alias("_m"))
    large = own.join(theirs, file, "left").filter(F.col("_n") + F.coalesce("_m", F.lit(0)) > task_functions).select(file)
    if large.isEmpty():
        return _in_tasks(files, candidates, libs, file, name)
    large = stored(large, "large")
    one = lambda df, how: df.join(large, file, how)
    return _in_tasks(one(files, "left_anti"), one(candidates, "left_anti"), libs, file, name).unionByName(peel_large(one(files, "left_semi"), one(candidates, "left_semi"), libs, file, name))


def _in_tasks(files: DataFrame, candidates: DataFrame, libs: DataFrame, file: str, name: str | None) -> DataFrame:
    run = method(name)
    fields = ["idx", "name", "tokens", "types"]
    kind = files.schema[file].dataType.simpleString()
    idle = None
    if (name or DEFAULT_METHOD) in EXACT_METHODS:
        # An exact method scores above 0 only where a bag is equal: other files keep all, and other pairs need no functions.
        # Bags that no library has go first: a file's candidates never meet all its functions.
        lib_bags = libs.select("lib", bag_key("tokens").alias("bag")).distinct()
        own_bags = files.select(file, bag_key("tokens").alias("bag")).join(lib_bags.select("bag").distinct(), "bag", "left_semi").distinct()
        live = stored(candidates.join(own_bags, file).join(lib_bags, ["lib", "bag"]).select(file, "lib").distinct(), "live")
        busy = live.select(file).distinct()
        alone = files.join(busy, file, "left_anti").groupBy(file).agg(F.array_sort(F.collect_list("idx")).cast("array<int>").alias("mapped"))
        idle = alone.select(file, F.lit("remaining").alias("phase"), *[F.lit(None).cast(t).alias(c) for c, t in OUT[1:-1]], "mapped")
        files, candidates = files.join(busy, file, "left_semi"), candidates.join(busy, file, "left_semi")
        pairs = candidates.join(live, [file, "lib"], "left_semi")
    else:
        pairs = candidates
    none = lambda *names: {c: F.lit(None).cast(t) for c, t in (("lib", "string"), ("val", "double"), ("version", "string"), ("lib_file", "string"), ("pos", "int"), ("idx", "int"), ("name", "string"), ("tokens", "array<string>"), ("types", "array<string>")) if c in names}
    own = files.select(file, *fields).withColumns(none("lib", "val", "version", "lib_file", "pos"))
    listed = candidates.withColumns(none("version", "lib_file", "pos", *fields)).select(own.columns)
    theirs = pairs.join(libs.select("lib", "version", "lib_file", "pos", *fields), "lib").select(own.columns)
    rows = own.unionByName(listed).unionByName(theirs)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine = functions_of(pdf[pdf.lib.isna()])
        order = dict(zip(pdf.lib[pdf.lib.notna()], pdf.val[pdf.lib.notna()], strict=True))
        libs_: dict[str, list] = {}
        for (lib, _, version, lib_file), part in pdf[pdf.lib.notna() & pdf.pos.notna()].groupby(["lib", "pos", "version", "lib_file"], sort=True):
            libs_.setdefault(lib, []).append((version, lib_file, functions_of(part)))
        rank, secondary, left = peel(mine, sorted(order.items()), libs_, run)
        out = [(key[0], phase, lib, top, k, version, lib_file, num, den, val, sorted(mapped)) for phase, entries in (("rank", rank), ("secondary", secondary)) for lib, top, matches in entries for k, (val, num, den, version, lib_file, mapped) in enumerate(matches, 1)]
        out.append((key[0], "remaining", None, None, None, None, None, None, None, None, [f.index for f in left]))
        frame = pd.DataFrame(out, columns=[file, "phase", "lib", "top", "match", "version", "lib_file", "num", "den", "val", "mapped"])
        return frame.astype({c: "Int64" for c in ("top", "match", "num", "den")})

    out = rows.groupBy(file).applyInPandas(one, ", ".join(f"{c} {t}" for c, t in ((file, kind), *OUT)))
    return out if idle is None else out.unionByName(idle)


def peel_large(files: DataFrame, candidates: DataFrame, libs: DataFrame, file: str = "file_key", name: str | None = None) -> DataFrame:
    """As ``peel_files``, with no file's functions in one task.

    Step k tries the k-th candidate of every file at once, all its versions by ``match_pairs``, and takes what the best
    match maps out of the functions that are left. First come the candidates that match exactly, whose versions count up
    to the first exact one, then the others. A step's tables take the place of those of the step before.
    """
    fields = ["idx", "name", "tokens", "types"]
    keyed = libs.withColumn("_key", F.concat_ws("\0", F.format_string("%010d", "pos"), "version", "lib_file", "lib"))
    versions = stored(keyed.select("lib", "version", "lib_file", "pos", "_key").distinct(), "versions")
    theirs = keyed.select("_key", *fields)
    top = F.row_number().over(Window.partitionBy(file).orderBy(F.desc("val"), "lib"))
    ranked = stored(candidates.dropDuplicates([file, "lib"]).withColumn("top", top), "ranked")
    steps = ranked.agg(F.coalesce(F.max("top"), F.lit(0))).first()[0]
    left, found = stored(files.select(file, *fields), "left"), []
    exact = ranked.select(file, "lib").limit(0)

    def step(tried: DataFrame, left: DataFrame, phase: str) -> tuple[DataFrame, DataFrame]:
        pairs = tried.join(versions, "lib")
        scores = match_pairs(pairs.select(file, "_key"), left, theirs, file, "_key", name).filter("val > 0")
        scored = pairs.join(scores, [file, "_key"])
        by = Window.partitionBy(file)
        if phase == "rank":
            stop = F.min(F.when(F.col("val") == 1, F.col("_key"))).over(by)
            scored = scored.withColumn("_stop", stop).filter(F.col("_stop").isNotNull() & (F.col("_key") <= F.col("_stop"))).drop("_stop")
        scored = scored.withColumn("match", F.row_number().over(by.orderBy(F.desc("val"), "_key"))).filter(F.col("match") <= MATCHES)
        now = stored(scored.select(file, F.lit(phase).alias("phase"), "lib", "top", "match", "version", "lib_file", "num", "den", "val", F.array_sort("unknown_idx").alias("mapped")), "matches")
        gone = now.filter("match = 1").select(file, F.explode("mapped").alias("idx"))
        rest = stored(left.join(gone, [file, "idx"], "left_anti").select(left.columns), "left")
        dropped(left)
        return now, rest

    for phase in ("rank", "secondary"):
        for k in range(1, steps + 1):
            tried = ranked.filter(F.col("top") == k).select(file, "lib", "top")
            tried = tried if phase == "rank" else tried.join(exact, [file, "lib"], "left_anti")
            now, left = step(tried, left, phase)
            found.append(now)
            if phase == "rank":
                exact = exact.unionByName(now.filter("match = 1").select(file, "lib"))
    rest = left.groupBy(file).agg(F.array_sort(F.collect_list("idx")).alias("mapped"))
    out = files.select(file).distinct().join(rest, file, "left").select(file, F.lit("remaining").alias("phase"), *[F.lit(None).cast(t).alias(c) for c, t in OUT[1:-1]], F.coalesce("mapped", F.array()).cast("array<int>").alias("mapped"))
    for now in found:
        out = out.unionByName(now)
    return out
