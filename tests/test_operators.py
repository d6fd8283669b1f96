import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import semver, text
from tessera.operators import assign, bags, candidates, joins, pairing, peel, reports, topk
from tessera.sources import layout, sinks
from tessera.streaming import registry


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_version_order(spark):
    df = frame(spark, [("a", i) for i in range(1, 7)] + [("b", i) for i in range(1, 13)], "n string, v int")
    out = topk.version_order(df, "n", ["v"]).orderBy("n", "pos").collect()
    assert [r.v for r in out if r.n == "a"] == [5, 4, 6, 3, 2, 1]
    assert [r.v for r in out if r.n == "b"] == [10, 9, 11, 8, 12, 7, 6, 5, 4, 3, 2, 1]


def test_top_k_keeps_the_first_of_equals(spark):
    df = frame(spark, [(1, x, i) for i, x in enumerate([3, 1, 3, 2, 3])], "k int, v int, pos int")
    assert [r.pos for r in topk.top_k(df, ["k"], [F.desc("v"), "pos"], 3).orderBy("top").collect()] == [0, 2, 4]
    assert [r.pos for r in topk.until_first(df, ["k"], "pos", F.col("v") == 1).orderBy("pos").collect()] == [0, 1]


def test_containment(spark):
    files = frame(spark, [(1, "p"), (1, "q"), (2, "p"), (2, "z"), (3, "none")], "f int, w string")
    libs = frame(spark, [("a", "p"), ("a", "q"), ("a", "r"), ("b", "p"), ("c", "p"), ("c", "q")], "l string, w string")
    out = {(r.f, r.l): (r.num, r.den, r.top) for r in candidates.candidate_libs(files, libs, "f", "l", "w", 2).collect()}
    assert out == {(1, "a"): (-1, -1, 1), (1, "c"): (-1, -1, 2), (2, "b"): (1, 2, 1), (2, "c"): (1, 3, 2)}
    files = files.union(frame(spark, [(1, "p"), (4, None), (5, "p"), (5, None)], "f int, w string"))
    assert sorted(map(tuple, candidates.contained(files, libs.union(libs), "f", "l", "w").collect())) == [(1, "a", 2), (1, "c", 2)]


def test_candidates_read_as_far_as_needed(monkeypatch):
    """Random sets: what can be among the best, or holds all, is there with its exact count; the rest needn't be."""
    import random

    import pyarrow as pa

    monkeypatch.setattr(candidates, "FEW", 0)
    rng, left_out = random.Random(5), 0
    weights = [1 / (k + 1) for k in range(60)]
    for _ in range(60):
        libs = [set(rng.choices(range(60), weights, k=rng.randrange(1, 25))) for _ in range(80)]
        rows = [(k, v) for k, own in enumerate(libs) for v in own]
        index = candidates.Postings(pa.table([pa.array([k for k, _ in rows]), pa.array([v for _, v in rows])], ["l", "w"]))
        file = set(rng.choices(range(64), k=rng.randrange(1, 12))) if rng.random() < 0.7 else set(list(libs[3])[:4])
        found = dict(zip(*(x.tolist() for x in index.best(sorted(file), len(file), 5)), strict=True))
        exact = {k: len(file & own) for k, own in enumerate(libs) if file & own}
        best = sorted(exact, key=lambda k: (-exact[k] / len(file | libs[k]), k))[:5]
        assert set(best) <= set(found) and all(exact[k] == n for k, n in found.items())
        assert {k for k, own in enumerate(libs) if file <= own} <= set(found)
        left_out += len(exact) - len(found)
    assert left_out > 100


def test_candidates_by_index_and_by_blocks_are_equal(spark, monkeypatch):
    import random

    rng = random.Random(4)
    files = frame(spark, [(f, rng.choice("abcdefgh")) for f in range(60) for _ in range(rng.randrange(6))] + [(99, None), (98, "a"), (98, None)], "f int, w string")
    libs = frame(spark, [(f"l{k:02}", rng.choice("abcdefghi")) for k in range(20) for _ in range(rng.randrange(1, 5))] + [("l99", None)], "l string, w string")
    monkeypatch.setattr(candidates, "GROUP_FILES", 9)
    libs = libs.union(frame(spark, [(f"m{k:04}", rng.choice("abcdefghijk")) for k in range(900) for _ in range(3)], "l string, w string"))  # two blocks
    for run in (lambda n: candidates.candidate_libs(files, libs, "f", "l", "w", 3, index_rows=n), lambda n: candidates.similar_files(files, libs, "f", "l", "w", 3, index_rows=n)):
        one, two = (run(n) for n in (10000, 0))
        columns = sorted(one.columns)
        assert sorted(two.columns) == columns
        assert sorted(map(tuple, one.select(columns).collect())) == sorted(map(tuple, two.select(columns).collect())) != []
    assert candidates.candidate_libs(files.filter("false"), libs, "f", "l", "w").count() == candidates.candidate_libs(files, libs.filter("false"), "f", "l", "w").count() == 0


def test_pairing_inverts(spark):
    u = frame(spark, [(1, i, t) for i, t in enumerate("abacca")], "f int, idx int, v string")
    b = frame(spark, [("L", i, t) for i, t in enumerate("aacb")], "l string, idx int, v string")
    m = pairing.pair_equal(u, b, "f", "l", "v")
    assert sorted((r.unknown_idx, r.lib_idx) for r in m.collect()) == [(0, 0), (1, 3), (2, 1), (3, 2)]
    assert sorted((r.unknown_idx, r.lib_idx) for r in pairing.invert(m, ["f", "l"]).collect()) == [(0, 0), (1, 2), (2, 3), (3, 1)]
    with pytest.raises(Exception, match="twice"):
        pairing.invert(m.withColumn("lib_idx", F.lit(1)), ["f", "l"]).collect()
    pairs = frame(spark, [(1, "L"), (2, "L"), (1, "M")], "f int, l string")
    scores = {(r.f, r.l): (r.num, r.den, r.val) for r in pairing.match_scores(m, u, b, "f", "l", "v6", pairs).collect()}
    assert scores == {(1, "L"): (4, 4, 1.0), (2, "L"): (0, 4, 0.0), (1, "M"): (0, 0, 0.0)}


def test_grouped_assignment_matches_the_function(spark):
    schema = "f int, idx int, name string, tokens array<string>, types array<string>"
    u = frame(spark, [(1, 0, "a", ["x", "y"], ["t"]), (1, 1, "b", ["z"], ["t"])], schema)
    b = frame(spark, [("L", 0, "a", ["z"], ["t"]), ("L", 1, "c", ["x"], ["t"])], schema.replace("f int", "l string"))
    pairs = frame(spark, [(1, "L"), (9, "L")], "f int, l string")
    out = {r.f: r for r in assign.match_pairs(pairs, u, b, "f", "l", "fn-st-toks-v2").collect()}
    assert (out[1].num, out[1].den, out[1].unknown_idx, out[1].lib_idx) == (2, 2, [0, 1], [1, 0])
    assert (out[9].num, out[9].den, out[9].unknown_idx) == (0, 2, [])


def test_peeling(spark):
    fn = lambda i, t: assign.Fn(i, "", t.split())
    mine = [fn(0, "a b"), fn(1, "c"), fn(2, "d"), fn(3, "e")]
    libs = {"exact": [("1.0.0", "0", [fn(0, "c"), fn(1, "b a")]), ("2.0.0", "0", [fn(0, "c")])], "partly": [("1.0.0", "0", [fn(0, "d"), fn(1, "q")])], "gone": [("1.0.0", "0", [fn(0, "c"), fn(1, "zz")])]}
    rank, secondary, left = peel.peel(mine, [("partly", 0.9), ("gone", 0.5), ("exact", 0.5)], libs, assign.v6)
    assert [(n, t, m[0][3]) for n, t, m in rank] == [("exact", 3, "1.0.0")] and len(rank[0][2]) == 1
    assert [(n, m[0][:3]) for n, _, m in secondary] == [("partly", (0.5, 1, 2))]
    assert [f.index for f in left] == [3]
    files = frame(spark, [(7, f.index, "", f.tokens, []) for f in mine] + [(8, 0, "", ["x"], [])], "file_key int, idx int, name string, tokens array<string>, types array<string>")
    table = frame(spark, [(n, v, f, k, x.index, "", x.tokens, []) for n, vs in libs.items() for k, (v, f, xs) in enumerate(vs) for x in xs], "lib string, version string, lib_file string, pos int, idx int, name string, tokens array<string>, types array<string>")
    chosen = frame(spark, [(7, "partly", 0.9), (7, "gone", 0.5), (7, "exact", 0.4)], "file_key int, lib string, val double")
    out = peel.peel_files(files, chosen, table).collect()
    assert {(r.file_key, r.phase, r.lib, r.version, tuple(r.mapped)) for r in out} == {(7, "rank", "exact", "1.0.0", (0, 1)), (7, "secondary", "partly", "1.0.0", (2,)), (7, "remaining", None, None, (3,)), (8, "remaining", None, None, (0,))}
    report = reports.by_phase(frame(spark, [(7, "rank", "exact", "1.0.0", 1), (7, "secondary", "partly", "1.0.0", 1)], "app int, phase string, lib string, version string, match int"), ["app"]).first()
    assert (report.exact, report.partial, report.ex_part) == (["exact@1.0.0"], ["partly@1.0.0"], ["exact@1.0.0", "partly@1.0.0"])


def test_peeling_computes_candidates_once(spark):
    """Candidates come from a search over all files, which isn't repeated for each place that reads them."""
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    kind = "idx int, name string, tokens array<string>, types array<string>"
    files = frame(spark, [(7, 0, "", ["a", "b"], []), (7, 1, "", ["c"], []), (8, 0, "", ["x"], [])], f"file_key int, {kind}")
    libs = frame(spark, [("p", "1", "0", 0, 0, "", ["b", "a"], []), ("q", "1", "0", 0, 0, "", ["y"], [])], f"lib string, version string, lib_file string, pos int, {kind}")
    chosen = frame(spark, [(7, "p", 0.9), (7, "q", 0.5), (8, "q", 0.4)], "file_key int, lib string, val double").mapInArrow(counted, "file_key int, lib string, val double")
    out = {(r.file_key, r.phase, r.lib, tuple(r.mapped)) for r in peel.peel_files(files, chosen, libs).collect()}
    assert out == {(7, "rank", "p", (0,)), (7, "remaining", None, (1,)), (8, "remaining", None, (0,))}
    assert rows.value == 3


def test_truth_and_status_and_precision(spark):
    truth = frame(spark, [("a", "1", False), ("a", "9", None), ("z", "1", False), ("a", "1", True), (None, None, False), ("a", None, False)], "name string, version string, is_guess boolean")
    known = frame(spark, [("a", "1"), ("a", "1"), ("b", "9")], "name string, version string")
    got = sorted(map(str, (tuple(r) for r in joins.truth_classes(truth, known).collect())))
    assert got == sorted(map(str, [("a", "1", False, "known"), ("a", "9", None, "version-missing"), ("z", "1", False, "name-missing"), ("a", "1", True, "guess"), (None, None, False, "name-missing"), ("a", None, False, "version-missing")]))
    assert sorted(map(tuple, joins.with_version(truth.select("name", "version"), known).collect())) == [("a", "1"), ("a", "1")]
    pool, pre, done = (frame(spark, [(k,) for k in x], "kind string") for x in (["c", "c"], ["c", "r"], ["n"]))
    assert {tuple(r) for r in reports.status(pool, pre, done, "kind").collect()} == {("c", 2, 1, 0), ("r", 0, 1, 0), ("n", 0, 0, 1)}
    rows = [("m", "non-guess")] * 3 + [("m", "incorrect-version"), ("m", "false-match"), ("m", "else"), ("none", "else")]
    found = {(r["method"], r["of"]): r for r in reports.method_precision_recall(frame(spark, rows, "method string, kind string"), "method", "kind").collect()}
    r = found["m", "names"]
    assert (r.precision_num, r.precision_den, r.recall_num, r.recall_den) == (4, 5, 4, 17) and r.precision == pytest.approx(0.8) and r.recall == pytest.approx(4 / 17)
    assert (found["m", "names-versions"].precision_num, found["m", "names-versions"].recall_den) == (3, 15) and found["none", "names"].precision == 0


def test_locale_order(spark):
    names = ["b", "a", "B", "A", "é", "e", "f", "Éa", "z", "a", "ab", "Ab"]
    found = sorted(reports.in_locale_order(frame(spark, [(n,) for n in names], "name string"), "name").collect(), key=lambda r: r.place)
    assert [r.name for r in found] == ["a", "A", "ab", "Ab", "b", "B", "e", "é", "Éa", "f", "z"] and [r.place for r in found] == list(range(1, 12))


@pytest.mark.parametrize(("version", "text_", "want"), [
    ("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.3", "^0.0.3", True), ("0.0.4", "^0.0.3", False),
    ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.9.0", "1.x", True), ("1.9.0", "*", True), ("1.9.0", "", True), ("1.0.0", ">=1.0.0 <2.0.0", True), ("2.0.0", ">=1.0.0 <2.0.0", False),
    ("3.1.0", "<2.0.0 || >3", False), ("4.0.0", "<2.0.0 || >3", True), ("1.5.0", "1.2 - 2", True), ("2.9.9", "1.2 - 2", True), ("3.0.0", "1.2 - 2", False), ("1.0.0-beta.2", ">=1.0.0-beta.1", True),
    ("1.0.1-beta", ">=1.0.0-beta.1", False), ("1.0.0-beta.1", ">=1.0.0-beta.2", False), ("1.0.0-alpha", "*", False), ("v1.2.3", "=1.2.3", True), ("1.2", "*", False), ("1.2.3", "nonsense", False), ("2.0.0-rc1", "<2.0.0", False), ("1.0.0-99999999999999999999", ">1.0.0-9999999999999999999", True), ("1.0.0-9999999999999999999", ">1.0.0-99999999999999999999", False), ("1.2.3", ">= 1.2.3", True), (None, "*", False),
])
def test_version_ranges(version, text_, want):
    assert semver.satisfies(version, text_) is want


def test_version_columns(spark):
    df = frame(spark, [("1.2.3-rc.1", "^1"), ("x", "a b"), ("1.02.3", "*")], "v string, r string")
    out = df.select(semver.is_valid(F.col("v")).alias("ok"), semver.numbers(F.col("v")).alias("n"), semver.valid_range("r").alias("range")).collect()
    assert [(r.ok, r.range) for r in out] == [(True, True), (False, False), (False, True)] and out[0].n.pre == "rc.1"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    found = one(text.mentions(F.lit("jQuery v1.9.1 and Foo @version 2.0.0 bar version v3.1.4-rc")))
    assert [tuple(m) for m in found] == [("jQuery", "v1.9.1"), ("Foo", "2.0.0"), ("bar", "v3.1.4")]
    assert tuple(one(text.first_mention(F.lit("a lib 1.2.3")))) == ("lib", "1.2.3") and one(text.first_mention(F.lit("none"))) is None
    assert one(text.name_count(F.lit(" a.b a.b axb "), F.lit("a.b"))) == 1
    assert tuple(one(text.tarball_parts(F.lit("a-1.2.3-4.5.6.tgz")))) == ("a-1.2.3", "4.5.6")
    assert one(text.apk_parts(F.lit("org.x-12-2019_01_02.apk"))).build == 12
    assert one(text.left_pad(F.lit("12345"))) == "12345" and one(text.left_pad(F.lit("7"))) == "0007"
    assert one(text.long_lines_ratio(F.lit("aaaa"))) == 4 and one(text.is_minified(F.lit("aaaa"))) and not one(text.is_minified(F.lit("")))
    assert one(text.join_names(F.lit("a"), F.lit("b"))) == "a:>>:b" and one(text.join_names(F.lit(""), F.lit("b"))) == "b"
    assert one(text.short_name_ratio(F.array(F.lit("abc"), F.lit("x:>>:[anonymous]"), F.lit("long")))) == pytest.approx(2 / 3)
    assert [one(text.source_kind(F.lit(s))) for s in ("js/a.js", "https://a/b.js", "data:x", "//cdn/x.js")] == ["file", "http", "unknown", "file"]
    rows = [["jquery", 3, "yes, twice, here", None], [",,", 0, "no", 1.5]]
    lines = sinks.matrix_csv(frame(spark, rows, "lib string, n int, note string, share double"), ["note", "lib", "n", "share"]).collect()
    assert [r.line for r in lines] == ["yes_ twice, here,jquery,3,", "no,_,,0,1.5"]
    assert one(text.csv_cell(F.lit("a,b,c"))) == "a_b,c"
    assert [one(text.script_name(F.lit(p))) for p in ("./src/bin/findLibs.ts", "src/bin/_all.worker.ts", "lib/x.ts", "src/bin/one-time/doIt.js")] == ["find-libs", None, None, "one-time/do-it"]


def test_main_files(spark):
    """A list counts if it has a script; then what a module loader finds; then the guesses."""
    packages = [
        ("sheets", "1.0.0", ["x.css"], ["m.js"], None), ("both", "1.0.0", ["b.js", "b.min.js"], ["m.js"], None), ("gone", "1.0.0", ["gone.js"], ["m.js"], "m.js"), ("named", "1.0.0", [], None, "./lib"), ("plain", "1.0.0", None, ["x.css"], "data.json"),
        ("index", "1.0.0", None, None, "nothing"), ("raw", "2.0.0", None, None, None), ("dots", "1.0.0", [".js", "./a//b.c.js"], None, None), ("none", "1.0.0", None, None, None),
    ]
    there = {
        "sheets": ["m.js", "x.css"], "both": ["b.js", "b.min.js", "m.js"], "gone": ["m.js", "index.js"], "named": ["lib/index.js", "lib/index.min.js", "named.js"], "plain": ["data.json", "data.min.json", "index.js"],
        "index": ["index.json", "index.js", "index.min.js"], "raw": ["raw-2.0.0.js", "dist/raw.min.js", "raw.js", "build/raw.js"], "dots": [".js", "a/b.c.js", "a/b.c.min.js"],
    }
    package = frame(spark, packages, "name string, version string, bower array<string>, component array<string>, node string")
    existing = frame(spark, [(n, v, f) for n, v, *_ in packages for f in there.get(n, [])], "name string, version string, file string")
    found = {}
    for r in sorted(joins.main_files(package, existing).collect(), key=lambda r: r.pos):
        found.setdefault(r.name, []).append(r.file)
    assert found == {
        "sheets": ["m.js"], "both": ["b.js", "b.min.js", "b.min.js"], "named": ["lib/index.js", "lib/index.min.js"], "plain": ["data.json", "data.min.json"], "index": ["index.js", "index.min.js"], "raw": ["dist/raw.min.js", "raw.js", "raw-2.0.0.js"], "dots": ["a/b.c.js", "a/b.c.min.js"],
    }


def test_streams_of_a_folder_and_of_one_file(spark, tmp_path):
    from tessera.streaming import registry

    df = spark.range(300).repartition(3)
    df.write.parquet(f"{tmp_path}/folder.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/other")
    (one,) = (tmp_path / "other").glob("part-*.parquet")
    one.rename(tmp_path / "file.parquet")
    for name in ("folder", "file"):
        stream = registry.read_files(spark.readStream.schema("id long"), spark, f"{tmp_path}/{name}.parquet")
        stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == 300


def test_joins(spark):
    files = frame(spark, [("a", "x/www/index.html"), ("a", "x/www/cordova.js"), ("a", "assets/index.android.bundle"), ("b", "assets/index.android.bundle"), ("c", "else")], "app string, path string")
    assert {r.app: r.type for r in joins.app_type(files, ["app"]).collect()} == {"a": "cordova", "b": "react-native", "c": "removed"}
    libs = frame(spark, [("a", "1.0.0"), ("b", "1.0.0"), ("c", "1.0.0"), ("d", "1.0.0")], "name string, version string")
    bl = frame(spark, [("a", "all", None), ("b", "list", ["2.0.0"]), ("c", "list", ["1.0.0"])], "name string, versions string, version_list array<string>")
    assert {r.name for r in joins.blacklisted(libs, bl).filter("blacklisted").collect()} == {"a", "c"}
    times = frame(spark, [("2020-01-02",), ("unknown",), (None,), ("2019-01-01",)], "t string")
    assert [r.x for r in times.select(joins.after_cutoff(F.col("t"), F.lit("2020-01-01").cast("timestamp")).alias("x")).collect()] == [True, False, False, False]
    found, missing = joins.known_and_missing(libs, frame(spark, [("a", "t")], "name string, time string"), ["name"])
    assert found.count() == 1 and missing.count() == 3
    good, bad = sinks.quarantine(libs, F.col("name") > "b")
    assert (good.count(), bad.count()) == (2, 2)
    assert [tuple(r) for r in sinks.finished(frame(spark, [("b",), ("a",)], "k string"), frame(spark, [("c",), ("a",)], "k string"), ["k"]).collect()] == [("a",), ("b",), ("c",)]
    assert {r.slice for r in reports.slices(spark.range(10), "id", 3).collect()} == {0, 1, 2}


def test_layout(spark, tmp_path):
    sig = {"functionSignature": [{"index": 0, "type": "fn", "name": "f", "loc": None, "fnStatementTypes": ["t"], "fnStatementTokens": ["k"]}], "literalSignature": ["1", 1, "a,\"b", 2.5], "comments": ["c"]}
    for path in ("cordova/s/app1/an/head/0000", "react-native/s/app2/an/modules/s_a_b", "react-native/s/app2/an/modules/n_3", "cordova/s/_hid/an/head/0000", "cordova/s/app1/an/head/_0001"):
        (d := tmp_path / "apps" / path).mkdir(parents=True)
        (d / "signature.json").write_text(json.dumps(sig))
    out = layout.app_files(spark, str(tmp_path / "apps")).collect()
    assert sorted((r.app, r.id_type, r.id) for r in out if r.app == "app2") == [("app2", "n", "3"), ("app2", "s", "a_b")]
    assert len(out) == 3 and [(x.kind, x.s, x.n) for x in out[0].literals] == [("s", "1", None), ("n", None, 1.0), ("s", 'a,"b', None), ("n", None, 2.5)]
    assert out[0].functions[0].tokens == ["k"] and layout.app_files(spark, str(tmp_path / "apps"), "cordova").count() == 1
    with pytest.raises(ValueError, match="app type"):
        layout.app_files(spark, str(tmp_path), "ios")
    for path in ("lib/1.10.0", "lib/1.2.0", "_x/1.0.0", "y.lock/1.0.0"):
        (d := tmp_path / "libs" / path / "sigs").mkdir(parents=True)
        (d / "0000.json").write_text(json.dumps(sig))
    libs = layout.lib_signatures(spark, str(tmp_path / "libs"))
    assert [(r.name, r.version) for r in layout.lib_versions(libs).collect()] == [("lib", "1.10.0"), ("lib", "1.2.0")]
    assert layout.lib_literals(libs).count() == 4 and layout.lib_names(libs).count() == 1
    (tmp_path / "p-1.0.0.tgz").write_bytes(b"x")
    assert [tuple(r) for r in layout.tarballs(spark, str(tmp_path)).collect()] == [("p-1.0.0.tgz", "p", "1.0.0")]
    (tmp_path / "list.md").write_text("# top\n1. [lodash](u) - x\n2. [async](u)\n")
    assert [tuple(r) for r in layout.ranked_names(spark, str(tmp_path / "list.md")).collect()] == [(1, "lodash"), (2, "async")]


def test_registry_stream(spark, tmp_path):
    docs = [{"id": "a", "versions": {"1.0.0": "x", "bad": "y"}, "time": {"1.0.0": "2020", "2.0.0": "2021", "modified": "z"}}, {"id": "_design", "versions": {"1.0.0": "x"}}, {"id": "b"}, {"id": "c", "versions": {"0.1.0": "x"}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, docs)))
    for _ in range(2):  # a second run finds nothing new
        registry.write_split(registry.read_changes(spark, str(tmp_path / "in"), 1), str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "ok")).collect()
    assert sorted((r.name, r.version, r.time_raw) for r in rows) == [("a", "1.0.0", "2020"), ("a", "2.0.0", "2021"), ("c", "0.1.0", "unknown")]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "no")).collect()) == ["_design", "b"]


def test_reports(spark, tmp_path):
    results = frame(spark, [("v6", "a", "1.0.0", 1.0), ("v6", "b", "1.0.0", 0.5), ("v5", "a", "1.0.0", 1.0)], "method string, lib string, version string, val double")
    assert {r.method: r.matches for r in reports.exact_matches(results, "method", ["lib", "version"]).collect()} == {"v6": ["a/1.0.0"], "v5": ["a/1.0.0"]}
    truth = frame(spark, [("x", 1, 5, True, None), ("x", 2, 6, True, None), ("x", 3, 7, False, "gone"), ("x", 4, 8, False, "mod")], "app string, fn_index int, lib_index int, target boolean, reason string")
    mapping = frame(spark, [("x", 1, 5), ("x", 4, 8)], "app string, unknown_idx int, lib_idx int")
    assert tuple(reports.function_evaluation(truth, mapping, ["app"]).first()) == (0.5, 0.5, 1.0)
    assert tuple(reports.function_evaluation(truth.filter("false"), mapping, ["app"]).first()) == (1.0, 1.0, 1.0)
    scores = frame(spark, [("a", 1.0, 3), ("b", 1.0, 0)], "lib string, val double, den long")
    assert tuple(reports.library_evaluation(scores, frame(spark, [("a",), ("b",), ("c",)], "lib string"), ["lib"]).first()) == (1, 1, 3)
    sinks.copy_table(results, str(tmp_path / "t"), ["method"])
    sinks.copy_table(results.filter("false"), str(tmp_path / "t"), ["method"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    mentions = frame(spark, [(1, "a", "1"), (2, "b", "1"), (3, "a", "2"), (4, "a", "1")], "seq int, name string, version string")
    assert [(r.name, r.n, r.versions) for r in reports.mention_counts(mentions).collect()] == [("a", 3, ["1", "2"]), ("b", 1, ["1"])]
    assert reports.merged([mentions, mentions]).count() == 4
    assert tuple(reports.detection_ratios(frame(spark, [], "found string")).first()) == (0.0, 0.0, 0.0, 0.0)


def test_ranges_in_the_jvm_are_those_in_python(spark):
    versions = ["0.0.1", "0.1.0", "1.0.0", "1.2.3", "1.2.3-rc.1", "1.2.3-rc.10", "1.2.3-alpha", "1.2.4", "1.3.0-0", "2.0.0", "10.0.0", "x", "1.2", None]
    ranges = ["*", "", "^1.2.3", "^0.1", "^0.0.1", "~1.2", "~1.2.3-rc.2", ">=1.2.3-rc.1 <2", "1.2.x || >=2.0.0", "1.0 - 1.2.3", ">1", "<=1.2", "=1.2.3-alpha", "<1.3.0-0", "no range", None]
    pairs = frame(spark, [(v, r) for v in versions for r in ranges], "v string, r string")
    out = pairs.withColumn("b", semver.bounds(F.col("r"))).select("v", "r", semver.within(F.col("v"), F.col("b")).alias("got")).collect()
    assert len(out) == len(versions) * len(ranges)
    assert [x for x in out if x.got is not semver.satisfies(x.v, x.r)] == []


def test_a_line_whose_square_no_int_holds(spark):
    src = F.concat(F.repeat(F.lit("a"), 50_000), F.lit("\nb"))
    got = spark.range(1).select(text.long_lines_ratio(src).alias("r"), text.is_minified(src).alias("m"), text.average_line_length(src).alias("a")).first()
    assert got.r == (50_000.0**2 / 50_002 + 1) / 50_002 / 2 and got.m and got.a == 25_000


def test_ranges_meet_only_versions_that_they_reach(spark):
    """Random ranges against each version by itself, and no range leaves a version in it out of its reach."""
    import random

    rng = random.Random(5)
    number = lambda: rng.choice([0, 0, 1, 2, 3])
    versions = [f"{number()}.{number()}.{number()}" + rng.choice(["", "", "-rc.1", "-0", "-a.2"]) for _ in range(120)] + ["x", "1.2.3", "1.2.3"]
    part = lambda: ".".join(str(rng.choice([number(), number(), "x"])) for _ in range(rng.choice([1, 2, 3])))
    whole = lambda: f"{number()}.{number()}.{number()}" + rng.choice(["", "-rc.1", "-0"])
    one = lambda: rng.choice([f"^{part()}", f"~{part()}", f">={whole()} <{whole()}", f"{part()} - {part()}", f"<={part()}", f">{whole()}", whole(), "*", f"<{whole()}", "=" + whole(), f">{part()}"])
    ranges = [" || ".join(one() for _ in range(rng.choice([1, 1, 2]))) for _ in range(150)] + ["nonsense |", "^1.2", "^1.2"]
    want = sorted((v, i) for v in versions for i, r in enumerate(ranges) if semver.satisfies(v, r))
    for r in ranges:
        reach = [x for x in map(semver.reached, semver.parse_range(r) or ()) if x]
        for v in versions:
            if semver.satisfies(v, r):
                a, b = semver.parse(v)[:2]
                assert any(low <= a <= high and minor in (None, b) for low, high, minor in reach)
    libs = frame(spark, [("l", v) for v in versions], "name string, version string")
    vulns = frame(spark, [("l", [r], [i]) for i, r in enumerate(ranges)], "name string, ranges array<string>, ids array<int>")
    assert sorted((r.version, r.id) for r in joins.vulnerable(libs, vulns).collect()) == want


def test_main_files_broadcasts_no_list_of_files(spark):
    package = frame(spark, [("a", "1.0.0", None, None, "main")], "name string, version string, bower array<string>, component array<string>, node string")
    found = joins.main_files(package, frame(spark, [("a", "1.0.0", "main.js")], "name string, version string, file string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.file for r in found.collect()] == ["main.js"]


def test_characters_are_dealt_over_the_cores(spark, tmp_path):
    from tessera.plans import elements

    frame(spark, [(1, "ab", "ba")], "p_partkey long, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert elements._characters(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    assert tuple(elements.mapping_inverse(spark, str(tmp_path)).first()) == (1, "0>1 1>0", "0>1 1>0")


def test_equal_values_are_paired_by_digest(spark):
    """Arrays that only look alike stay apart; what goes through the shuffle doesn't grow with the values."""
    bags_ = [["a", "bc"], ["ab", "c"], ["a,b", "c"], ["a", "b,c"], [None, "a"], ["a"], [], ['a"', "b"], ["a", '"b'], None, ["a", "bc"]]
    df = frame(spark, [("f", i, b) for i, b in enumerate(bags_)], "f string, idx int, v array<string>")
    got = sorted((r.unknown_idx, r.lib_idx) for r in pairing.pair_equal(df, df.withColumnRenamed("f", "l"), "f", "l", "v").collect())
    assert got == [(i, i) for i in (*range(9), 10)]
    for kind in ("string", "array<string>"):
        key = frame(spark, [], f"v {kind}").select(pairing.digest(frame(spark, [], f"v {kind}"), "v").alias("k"))
        assert key.schema["k"].dataType.simpleString() == "binary"


def test_a_name_in_most_files_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairing, "NAME_FILES", 16)
    u = frame(spark, [(f, i, n) for f in range(100) for i, n in enumerate(["hot", f"n{f % 7}", "hot"])] + [(7, 9, None)], "f int, idx int, name string")
    b = frame(spark, [(k, i, n) for k in range(5) for i, n in enumerate(["n1", "hot", f"n{k}"])] + [(0, 8, None)], "l int, idx int, name string")
    mapping, scores = pairing.match_names(u, b, "f", "l", "jaccard")
    assert "_part" in mapping._jdf.queryExecution().optimizedPlan().toString()
    libs = {k: {"n1": 0, "hot": 1} | ({f"n{k}": 2} if k != 1 else {}) for k in range(5)}
    want = sorted((f, k, i, libs[k][n]) for f in range(100) for k in range(5) for i, n in enumerate(["hot", f"n{f % 7}"]) if n in libs[k])
    assert sorted((r.f, r.l, r.unknown_idx, r.lib_idx) for r in mapping.collect()) == want
    assert scores.count() == 500
