"""Registered queries of the functions on arrays, names, positions and small reports, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bags as bag_fn
from tessera.functions import fractions, semver, text
from tessera.operators import bags, joins, mentions, pairing, reports
from tessera.plans.catalogue import _LINES, _MATCHED, _PAIRED, _fn_sides
from tessera.plans.registry import registry
from tessera.sources import sinks
from tessera.sources.tables import dealt, functions, table

QUERIES, ORACLE, query = registry()


def _by_order(spark, sf_dir, **lists):
    """Lists of values of an order's lines, in the order of their numbers."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", *[v.alias(k) for k, v in lists.items()]))).alias("x"))

    def column(name):
        return F.transform("x", lambda s: s[name]).alias(name)

    return items.select("l_orderkey", *map(column, lists))


_NUMBERS = """
x as (select l_orderkey, case when l_returnflag = 'R' then 'NaN'::double else (l_linenumber % 3)::double end a, (l_quantity::int % 3)::double b from lineitem),
ca as (select l_orderkey, a v, count(*) n from x where not isnan(a) group by all),
cb as (select l_orderkey, b v, count(*) n from x group by all),
m as (select l_orderkey, sum(least(ca.n, cb.n))::bigint num from ca join cb using (l_orderkey, v) group by all)
"""


@query("bag_numbers_jaccard", f"with {_NUMBERS} select l_orderkey, coalesce(num, 0)::bigint num, (2 * count(*) - coalesce(num, 0))::bigint den, coalesce(num, 0) / (2 * count(*) - coalesce(num, 0)) val from x left join m using (l_orderkey) group by l_orderkey, num")
def bag_numbers_jaccard(spark, sf_dir):
    a = F.when(F.col("l_returnflag") == "R", F.lit(float("nan"))).otherwise((F.col("l_linenumber") % 3).cast("double"))
    x = _by_order(spark, sf_dir, a=a, b=(F.col("l_quantity").cast("int") % 3).cast("double"))
    return x.select("l_orderkey", bag_fn.bag_jaccard(F.col("a"), F.col("b"), numbers=True).alias("s")).select("l_orderkey", "s.num", "s.den", "s.val")


_INDEXES = """
x as (select l_orderkey, case when l_returnflag = 'R' then -1 else l_linenumber % 4 end a, case when l_linestatus = 'O' then l_linenumber % 2 end b from lineitem),
ca as (select l_orderkey, a v, count(*) n from x where a <> -1 group by all),
cb as (select l_orderkey, b v, count(*) n from x where b is not null group by all),
m as (select l_orderkey, sum(least(ca.n, cb.n))::bigint num from ca join cb using (l_orderkey, v) group by all),
s as (select l_orderkey, count(b)::bigint den from x group by all)
"""


@query("portion_of_indexes", f"with {_INDEXES} select l_orderkey, coalesce(num, 0)::bigint num, den, case when den = 0 then 0.0 else coalesce(num, 0) / den end::double val from s left join m using (l_orderkey)")
def portion_of_indexes(spark, sf_dir):
    a = F.when(F.col("l_returnflag") == "R", -1).otherwise(F.col("l_linenumber") % 4)
    x = _by_order(spark, sf_dir, a=a, b=F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") % 2))
    return x.select("l_orderkey", bag_fn.lib_portion_indexes(F.col("a"), bag_fn.without_null(F.col("b"))).alias("s")).select("l_orderkey", "s.num", "s.den", "s.val")


@query("weighted_mapping_mean", "select l_orderkey, sum(case when d = 0 then 1.0 else n / d end)::double / count(*) mean from (select l_orderkey, l_linenumber::double n, [0, 1, 2, 4][1 + l_linenumber % 4]::double d from lineitem) group by l_orderkey")
def weighted_mapping_mean(spark, sf_dir):
    den = F.element_at(F.array(*map(F.lit, (0, 1, 2, 4))), 1 + F.col("l_linenumber") % 4)
    return bags.weighted_mean(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("num"), den.alias("den")), "l_orderkey")


#: The characters of two columns as two bags in order.
_CHARACTERS = """
a as (select p_partkey, unnest(string_split(p_brand, '')) v, unnest(range(length(p_brand))) i from part),
b as (select p_partkey, unnest(string_split(p_type, '')) v, unnest(range(length(p_type))) i from part),
ra as (select *, row_number() over (partition by p_partkey, v order by i) k from a),
rb as (select *, row_number() over (partition by p_partkey, v order by i) k from b)
"""


def _characters(spark, sf_dir):
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")).select("p_partkey", F.split("p_brand", "").alias("a"), F.split("p_type", "").alias("b"))


@query("mapping_inverse", f"with {_CHARACTERS}, m as (select p_partkey, ra.i i, rb.i j from ra join rb using (p_partkey, v, k)) select p_partkey, coalesce(string_agg(i || '>' || j, ' ' order by i), '') pairs, coalesce(string_agg(j || '>' || i, ' ' order by j), '') inverse from part left join m using (p_partkey) group by p_partkey")
def mapping_inverse(spark, sf_dir):
    shown = lambda pairs: F.array_join(F.transform(pairs, lambda p: F.concat_ws(">", p["i"].cast("string"), p["j"].cast("string"))), " ")
    found, pairs = _characters(spark, sf_dir).select("p_partkey", bag_fn.pairs_of(F.col("a"), F.col("b")).alias("m")), F.col("m")
    return found.select("p_partkey", shown(pairs).alias("pairs"), shown(bag_fn.invert_pairs(pairs)).alias("inverse"))


@query("repeated_operations", f"with {_CHARACTERS}, na as (select p_partkey, v, count(*) n from a group by all), nb as (select p_partkey, v, count(*) n from b group by all), x as (select ra.*, k <= coalesce(n, 0) inside from ra left join nb using (p_partkey, v)), y as (select rb.*, k <= coalesce(n, 0) inside from rb left join na using (p_partkey, v)), l as (select p_partkey, string_agg(v, '' order by i) filter (inside) i, string_agg(v, '' order by i) filter (not inside) d from x group by all), r as (select p_partkey, string_agg(v, '' order by i) filter (not inside) rd from y group by all) select p_partkey, coalesce(i, '') i, coalesce(d, '') d, coalesce(rd, '') rd from l join r using (p_partkey)")
def repeated_operations(spark, sf_dir):
    ops = _characters(spark, sf_dir).select("p_partkey", bag_fn.repeated_ops(F.col("a"), F.col("b")).alias("o"))
    return ops.select("p_partkey", *[F.array_join(F.col("o")[k], "").alias(k) for k in ("i", "d", "rd")])


@query("missing_added", "select p_partkey, array_to_string(list_concat(a, list_filter(b, lambda v: not list_contains(a, v))), '') joined from (select p_partkey, string_split(p_brand, '') a, string_split(p_type, '') b from part)")
def missing_added(spark, sf_dir):
    return _characters(spark, sf_dir).select("p_partkey", F.array_join(bag_fn.add_missing(F.col("a"), F.col("b")), "").alias("joined"))


@query("lifted_function", "select p_partkey, array_to_string(list_transform(list_zip(w, list_reverse(w), w), lambda x: x[1] || ':' || x[2] || ':' || length(x[3])), ' ') three, array_to_string(list_transform(list_zip(w, list_reverse(w)), lambda x: x[1] || x[2]), ' ') two from (select p_partkey, string_split(p_type, ' ') w from part)")
def lifted_function(spark, sf_dir):
    w, back = F.split("p_type", " "), F.reverse(F.split("p_type", " "))
    three = bag_fn.zip_apply(lambda a, b, c: F.concat_ws(":", a, b, F.length(c).cast("string")), w, back, w)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(three, " ").alias("three"), F.array_join(bag_fn.zip_apply(lambda a, b: F.concat(a, b), w, back), " ").alias("two"))


@query("values_present", "select l_orderkey, len(list_filter(a, lambda v: v is not null))::int shown, len(list_filter(a, lambda v: v is not null and v <> ''))::int truthy from (select l_orderkey, list(case l_returnflag when 'R' then null when 'A' then '' else l_linestatus end) a from lineitem group by l_orderkey)")
def values_present(spark, sf_dir):
    x = _by_order(spark, sf_dir, a=F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") != "R", F.col("l_linestatus")))
    return x.select("l_orderkey", F.size(bag_fn.without_null(F.col("a"))).alias("shown"), F.size(bag_fn.without_falsy(F.col("a"))).alias("truthy"))


@query("first_last_positions", "select l_orderkey, coalesce(list_position(a, 1), 0)::int - 1 first, case when list_contains(a, 1) then len(a) - list_position(list_reverse(a), 1) else -1 end::int last from (select l_orderkey, list(l_linenumber % 3 order by l_linenumber % 3) a from lineitem group by l_orderkey)")
def first_last_positions(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber") % 3)).alias("a"))
    return x.select("l_orderkey", bag_fn.first_position(F.col("a"), F.lit(1)).alias("first"), bag_fn.last_position(F.col("a"), F.lit(1)).alias("last"))


@query("order_slices", "select o_orderkey, ((row_number() over (order by o_orderkey) - 1) // ceil(count(*) over () / 7)::bigint)::bigint slice from orders")
def order_slices(spark, sf_dir):
    return reports.slices(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("chunked_words", "select p_partkey, array_to_string(list_transform(range(1, len(w) + 1, 2), lambda i: array_to_string(w[i:i + 1], '+')), ' ') chunks from (select p_partkey, string_split(p_type, ' ') w from part)")
def chunked_words(spark, sf_dir):
    pieces = F.transform(bag_fn.chunks(F.split("p_type", " "), 2), lambda c: F.array_join(c, "+"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(pieces, " ").alias("chunks"))


@query("mapping_inverted", f"with {_LINES}, {_PAIRED} select doc_id, lib, lib_idx unknown_idx, unknown_idx lib_idx from mapping")
def mapping_inverted(spark, sf_dir):
    u, b = _fn_sides(spark, sf_dir)
    m = pairing.pair_equal(u, b, "doc_id", "lib", "bag")
    return pairing.invert(m, ["doc_id", "lib"]).select("doc_id", "lib", F.col("unknown_idx").cast("long"), "lib_idx")


@query("merged_parts", "select distinct source, lang from documents where doc_id % 3 <> 2")
def merged_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return reports.merged([docs.filter(F.col("doc_id") % 3 == k).select("source", "lang") for k in (0, 1)])


_RANKED = "r as (select l_orderkey, 'S' || l_suppkey % 5 || '@' || l_quantity::int lv, case when l_returnflag = 'R' then 'rank' else 'secondary' end phase from lineitem where l_linenumber % 2 = 0)"


@query("libraries_by_phase", f"with {_RANKED}, d as (select distinct * from r), e as (select l_orderkey, string_agg(distinct lv, ',' order by lv) ex_part from r group by all) select l_orderkey, coalesce(string_agg(lv, ',' order by lv) filter (phase = 'rank'), '') exact, coalesce(string_agg(lv, ',' order by lv) filter (phase = 'secondary'), '') partial, ex_part from d join e using (l_orderkey) group by l_orderkey, ex_part")
def libraries_by_phase(spark, sf_dir):
    ranked = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("S"), F.col("l_suppkey") % 5).alias("lib"), F.col("l_quantity").cast("int").cast("string").alias("version"), F.when(F.col("l_returnflag") == "R", "rank").otherwise("secondary").alias("phase"), (F.col("l_linenumber") % 2 + 1).alias("match"))
    found = reports.by_phase(ranked, ["l_orderkey"])
    return found.select("l_orderkey", *[F.array_join(c, ",").alias(c) for c in ("exact", "partial", "ex_part")])


@query("function_evaluation", "with m as (select distinct l_orderkey, l_linenumber, l_suppkey % 3 j from lineitem), t as (select l_returnflag = 'N' target, l_returnflag = 'R' gone, j is not null hit from lineitem x left join m on m.l_orderkey = x.l_orderkey and m.l_linenumber = x.l_linenumber and m.j = x.l_partkey % 3) select count(*) filter (target and hit) / count(*) filter (target) matched, count(*) filter (not target and not hit) / count(*) filter (not target) apart, count(*) filter (not target and gone and not hit) / count(*) filter (not target and gone) gone from t")
def function_evaluation(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey"]
    truth = items.select(*keys, F.col("l_linenumber").alias("fn_index"), (F.col("l_partkey") % 3).alias("lib_index"), (F.col("l_returnflag") == "N").alias("target"), F.when(F.col("l_returnflag") == "R", "gone").otherwise("other").alias("reason"))
    mapping = items.select(*keys, F.col("l_linenumber").alias("unknown_idx"), (F.col("l_suppkey") % 3).alias("lib_idx"))
    return reports.function_evaluation(truth, mapping, keys)


_SCORES = f"{_MATCHED}, v6 as (select doc_id, lib, num, nl.n den, num / nl.n val from m join nl using (lib))"


@query("library_evaluation", f"with {_SCORES} select count(*) filter (val = 1 and den > 0) exact, count(*) filter (den = 0) empty, count(*) total from (select distinct doc_id, source lib from documents) left join v6 using (doc_id, lib)")
def library_evaluation(spark, sf_dir):
    u, b = _fn_sides(spark, sf_dir)
    scores = pairing.match_scores(pairing.pair_equal(u, b, "doc_id", "lib", "bag"), u, b, "doc_id", "lib", "v6")
    truth = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("lib"))
    return reports.library_evaluation(scores, truth, ["doc_id", "lib"])


@query("exact_match_listing", "select o_orderpriority method, string_agg(distinct place, ',' order by place) matches from (select o_orderpriority, o_orderstatus || '/' || o_custkey place from orders where o_orderkey % 5 = 1) group by all")
def exact_match_listing(spark, sf_dir):
    results = table(spark, sf_dir, "orders").withColumn("val", (F.col("o_orderkey") % 5).cast("double"))
    found = reports.exact_matches(results, "o_orderpriority", ["o_orderstatus", "o_custkey"])
    return found.select(F.col("o_orderpriority").alias("method"), F.array_join("matches", ",").alias("matches"))


@query("nested_names", "select p_partkey, case when p_partkey % 4 = 0 then '' else p_brand || ':>>:' end || case when p_partkey % 3 = 0 then '[anonymous]' else p_type end as name, case when p_partkey % 4 = 0 then 1 else 2 end::int depth, p_partkey % 3 = 0 anonymous from part")
def nested_names(spark, sf_dir):
    outer = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand"))
    name = text.join_names(outer, F.when(F.col("p_partkey") % 3 == 0, text.ANONYMOUS).otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.size(text.split_names(name)).alias("depth"), text.is_anonymous(name).alias("anonymous"))


@query("minified_signatures", f"with {_LINES}, x as (select doc_id, count(*) filter (length(name) < 4) k, count(*) n from fn group by all) select doc_id, k / n ratio, k / n > {text.MANY_SHORT} minified from x")
def minified_signatures(spark, sf_dir):
    names = functions(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    return names.select("doc_id", text.short_name_ratio(F.col("names")).alias("ratio"), text.is_signature_minified(F.col("names")).alias("minified"))


@query("archive_names", r"select p_partkey, file, case when p_partkey % 5 <> 0 then regexp_extract(file, '^(.*)-(\d+\.\d+\.\d+.*)\.tgz$', 1) end as name, case when p_partkey % 5 <> 0 then regexp_extract(file, '^(.*)-(\d+\.\d+\.\d+.*)\.tgz$', 2) end as version from (select p_partkey, lower(replace(p_type, ' ', '-')) || '-' || p_size || case when p_partkey % 5 = 0 then '' else '.0.' || p_partkey % 7 || case when p_partkey % 3 = 0 then '-rc.1' else '' end end || '.tgz' file from part)")
def archive_names(spark, sf_dir):
    tail = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit(".0."), F.col("p_partkey") % 7, F.when(F.col("p_partkey") % 3 == 0, "-rc.1").otherwise("")))
    file = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.lit("-"), F.col("p_size").cast("string"), tail, F.lit(".tgz"))
    return table(spark, sf_dir, "part").select("p_partkey", file.alias("file")).select("*", text.tarball_parts(F.col("file")).alias("p")).select("p_partkey", "file", "p.name", "p.version")


@query("package_names", "select o_orderkey, 'app.' || o_custkey app, o_orderkey build, o_orderdate::date as \"date\" from orders")
def package_names(spark, sf_dir):
    file = F.concat(F.lit("app."), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyy_MM_dd"), F.lit(".apk"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.apk_parts(file).alias("p")).select("o_orderkey", F.col("p.name").alias("app"), "p.build", "p.date")


@query("known_libraries", "select p_brand as name, p_brand in (select p_brand from part where p_size > 48) known from (select distinct p_brand from part)")
def known_libraries(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "name")
    found, missing = joins.known_and_missing(part.select("name").distinct(), part.filter("p_size > 48").select("name").distinct(), ["name"])
    return found.select("name", F.lit(True).alias("known")).unionByName(missing.select("name", F.lit(False).alias("known")))


@query("script_names", "select p_partkey, case p_partkey % 6 when 0 then 'run-' || p_size when 1 then 'one-time/make-all' when 2 then null when 3 then null when 4 then null else 'eval-lib' end as name from part")
def script_names(spark, sf_dir):
    p = F.col("p_partkey") % 6
    path = F.when(p == 0, F.concat(F.lit("./src/bin/run"), F.concat(F.lit("-"), F.col("p_size").cast("string")), F.lit(".ts"))).when(p == 1, "dist/bin/one-time/makeAll.js").when(p == 2, "src/bin/_hidden.ts").when(p == 3, "src/bin/a.test.ts").when(p == 4, "src/lib/a.ts").otherwise("bin/evalLib.js")
    return table(spark, sf_dir, "part").select("p_partkey", text.script_name(path).alias("name"))


@query("range_validity", "select p_partkey, p_partkey % 4 <> 3 valid from part")
def range_validity(spark, sf_dir):
    n = F.col("p_size").cast("string")
    text_ = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("^"), n, F.lit(".1"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(">=1.2.3 <"), n, F.lit(" || ~"), n, F.lit(".x"))).when(F.col("p_partkey") % 4 == 2, F.concat(n, F.lit(".0.0 - 99"))).otherwise(F.concat(F.lit("version "), n))
    return table(spark, sf_dir, "part").select("p_partkey", semver.valid_range(text_).alias("valid"))


@query("mapping_lines", "select l_orderkey::varchar file_key, lpad(l_linenumber::varchar, 6, ' ') || ' -> ' || lpad((l_partkey % 100)::varchar, 6, ' ') || ': ' || printf('%.6f', round(l_linenumber / 8.0, 6)) || ' (' || l_linenumber || '/8)' line from lineitem")
def mapping_lines(spark, sf_dir):
    n = F.col("l_linenumber")
    return sinks.mapping_lines(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_key"), n.alias("unknown_idx"), (F.col("l_partkey") % 100).alias("lib_idx"), (n / 8.0).alias("val"), n.cast("long").alias("num"), F.lit(8).cast("long").alias("den")))


@query("quarantined", "select o_orderkey, coalesce(o_totalprice > 150000, false) kept from orders")
def quarantined(spark, sf_dir):
    good, bad = sinks.quarantine(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 150000)
    return good.select("o_orderkey", F.lit(True).alias("kept")).unionByName(bad.select("o_orderkey", F.lit(False).alias("kept")))


@query("finished_list", "select distinct o_custkey, o_orderpriority from orders where o_orderstatus in ('O', 'F')")
def finished_list(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return sinks.finished(orders.filter("o_orderstatus = 'O'"), orders.filter("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"])


@query("semver_carets", "with l as (select distinct p_size a, p_partkey % 10 b, p_partkey % 7 c, p_partkey % 3 = 0 pre from part), v as (select s_suppkey, s_suppkey % 50 + 1 a, s_nationkey % 10 b, s_suppkey % 4 kind from supplier) select l.a || '.' || l.b || '.' || c || case when pre then '-rc.1' else '' end as version, s_suppkey id from l join v on l.a = v.a and case kind when 0 then l.b >= v.b and not pre when 1 then l.b = v.b and not pre when 2 then (l.b > v.b or l.b = v.b and c > 3) and not pre else l.b = v.b and c = 2 end")
def semver_carets(spark, sf_dir):
    """Carets, tildes, pairs of comparators and prereleases of all suppliers against all versions of parts."""
    pre = F.when(F.col("p_partkey") % 3 == 0, "-rc.1").otherwise("")
    libs = table(spark, sf_dir, "part").select(F.lit("lib").alias("name"), F.concat(F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.col("p_partkey") % 7), pre).alias("version")).distinct()
    a, b, kind = (F.col("s_suppkey") % 50 + 1).cast("string"), (F.col("s_nationkey") % 10).cast("string"), F.col("s_suppkey") % 4
    two = F.concat_ws(".", a, b)
    exact = F.concat(F.lit(">="), two, F.lit(".2-rc.1 <="), two, F.lit(".2"))
    range_ = F.when(kind == 0, F.concat(F.lit("^"), two)).when(kind == 1, F.concat(F.lit("~"), two)).when(kind == 2, F.concat(F.lit(">"), two, F.lit(".3 <"), (F.col("s_suppkey") % 50 + 2).cast("string"))).otherwise(exact)
    vulns = table(spark, sf_dir, "supplier").select(F.lit("lib").alias("name"), F.array(range_).alias("ranges"), F.array("s_suppkey").alias("ids"))
    return joins.vulnerable(libs, vulns).select("version", "id")


@query("app_types", "select o_custkey, case when bool_or(o_orderkey % 4 = 0) and bool_or(o_orderkey % 4 = 1) then 'cordova' when bool_or(o_orderkey % 4 = 2) then 'react-native' else 'removed' end as type from orders group by o_custkey")
def app_types(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ("a/www/index.html", "a/www/cordova.js", "assets/index.android.bundle", "www/index.htm"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return joins.app_type(table(spark, sf_dir, "orders").select("o_custkey", path.alias("path")), ["o_custkey"])


_JS = "list_filter({0}, lambda x: regexp_matches(x, '[^/]\\.js$'))"
_PACKAGES = f"""
p as (select lower(replace(p_brand, '#', '')) as name, p_partkey::varchar as version, p_partkey k,
             case p_partkey % 8 when 0 then ['lib/main.js', 'style.css', 'lib/main.min.js'] when 1 then ['style.css'] when 2 then [] end bower,
             case p_partkey % 8 when 1 then ['m.js', 'index.js'] when 2 then ['.js', 'a.css'] end component,
             case p_partkey % 8 when 2 then 'lib/main' when 3 then 'none.js' when 4 then 'data.json' end node from part),
f as (select name, version, k, unnest(['lib/main.js', 'lib/main.min.js', 'm.js', 'm.min.js', 'data.json', 'data.min.json', name || '.js', name || '-' || version || '.js', 'dist/' || name || '.min.js', 'style.css', 'index.js']) file from p),
x as (select name, version, file from f where not (k % 3 = 0 and file like '%.min.%') and not (k % 16 < 11 and file = 'index.js')),
l as (select *, {_JS.format('bower')} jb, {_JS.format('component')} jc from p),
c as (select name, version, case when len(jb) > 0 then jb when len(jc) > 0 then jc end listed,
             list_transform(case when node is null then [] else ['', '.js', '.json', '.node', '/index.js', '/index.json', '/index.node'] end, lambda e: node || e) || ['index.js', 'index.json', 'index.node'] loader,
             ['dist/' || name || '.js', 'dist/' || name || '-' || version || '.js', name || '.js', name || '-' || version || '.js'] guesses from l),
n as (select name, version, arg_min(file, i) file from (select name, version, unnest(loader) file, unnest(range(len(loader))) i from c where listed is null) join x using (name, version, file) group by name, version),
w as (select c.name, c.version, coalesce(listed, case when n.file is not null then [n.file] else guesses end) files from c left join n using (name, version)),
e as (select name, version, flatten(list_transform(files, lambda y: [y, regexp_replace(y, '\\.([a-z]+)$', '.min.\\1')])) files from w),
t as (select name, version, unnest(files) file, unnest(range(len(files))) i from e)
"""


@query("main_files", f"with {_PACKAGES} select name, version, file, (row_number() over (partition by name, version order by i) - 1)::int pos from t join x using (name, version, file)")
def main_files(spark, sf_dir):
    """Main files of packages with lists of scripts, lists without one, main paths with and without an ending, and none."""
    k, name = F.col("p_partkey"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    paths = lambda *files: F.array(*map(F.lit, files)).cast("array<string>")
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand")).select(name.alias("name"), k.cast("string").alias("version"), "p_partkey")
    bower = F.when(k % 8 == 0, paths("lib/main.js", "style.css", "lib/main.min.js")).when(k % 8 == 1, paths("style.css")).when(k % 8 == 2, paths())
    component = F.when(k % 8 == 1, paths("./m.js", "index.js")).when(k % 8 == 2, paths(".js", "a.css"))
    node = F.when(k % 8 == 2, "./lib//main").when(k % 8 == 3, "none.js").when(k % 8 == 4, "data.json")
    package = part.select("name", "version", bower.alias("bower"), component.alias("component"), node.alias("node"))
    full = F.concat_ws("-", "name", "version")
    every = F.concat(paths("lib/main.js", "lib/main.min.js", "m.js", "m.min.js", "data.json", "data.min.json", "style.css", "index.js"), F.array(F.concat("name", F.lit(".js")), F.concat(full, F.lit(".js")), F.concat(F.lit("dist/"), "name", F.lit(".min.js"))))
    existing = part.select("name", "version", F.explode(F.filter(every, lambda f: ~((k % 3 == 0) & f.contains(".min.")) & ~((k % 16 < 11) & (f == "index.js")))).alias("file"))
    return joins.main_files(package, existing).select("name", "version", "file", F.col("pos").cast("int").alias("pos"))


_NAMES = "n as (select distinct name from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as name from benchmark union all select regexp_extract(text, '^[^ ]+ [^ ]+') from benchmark) where name <> '')"


def _names(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    words = bench.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("name"))
    return words.unionByName(bench.select(F.regexp_extract("text", "^[^ ]+ [^ ]+", 0).alias("name")))


@query("name_counts", rf"with {_NAMES}, c as (select doc_id, name, len(regexp_extract_all(text, '[\W_]' || regexp_escape(name) || '[\W_]')) n from documents join n on contains(text, name)) select doc_id, name, n::bigint n from c where n > 0")
def name_counts(spark, sf_dir):
    """How often each word of the benchmark, and the first two words of each item, stand in each document."""
    return mentions.name_counts(table(spark, sf_dir, "documents"), _names(spark, sf_dir), "doc_id")


@query("names_used", r"with n as (select distinct regexp_replace(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+'), ' ', '.') as name from benchmark) select doc_id, name from documents join n on name <> '' and regexp_matches(text, '[\W_]' || name || '[\W_]')")
def names_used(spark, sf_dir):
    """The documents that hold the first two words of an item with any character between them."""
    pair = F.regexp_replace(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0), " ", ".")
    return mentions.names_used(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(pair.alias("name")), "doc_id")


@query("method_precision_recall", """
with x as (select source, case doc_id % 4 when 0 then 'non-guess' when 1 then 'incorrect-version' when 2 then 'false-match' else 'open' end kind from documents),
g as (select source, count(*) filter (kind = 'non-guess') g, count(*) filter (kind = 'incorrect-version') l, count(*) filter (kind = 'false-match') w from x group by source),
r as (select source, 'names' as of_, g + l num, g + l + w den, 17 truth from g union all select source, 'names-versions', g, g + l + w, 15 from g)
select source, of_ as "of", num precision_num, den precision_den, case when den = 0 then 0 else num / den end "precision", num recall_num, truth::bigint recall_den, num / truth recall from r""")
def method_precision_recall(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, (*reports.DETECTIONS, "open"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return reports.method_precision_recall(table(spark, sf_dir, "documents").select("source", kind.alias("kind")), "source", "kind")


_TRUTH = """
k as (select distinct p_brand as name, p_size::varchar as version from part where p_partkey % 3 <> 0),
t as (select l_orderkey, l_linenumber, 'Brand#' || (10 + l_partkey % 50) as name, case when l_linenumber <> 6 then l_quantity::int::varchar end as version, case when l_linenumber = 7 then true when l_linenumber < 6 then false end is_guess from lineitem)
"""


def _truth(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version"))
    n = F.col("l_linenumber")
    version = F.when(n != 6, F.col("l_quantity").cast("int").cast("string"))
    truth = table(spark, sf_dir, "lineitem").select("l_orderkey", n, F.concat(F.lit("Brand#"), (F.col("l_partkey") % 50 + 10).cast("string")).alias("name"), version.alias("version"), F.when(n == 7, True).when(n < 6, False).alias("is_guess"))
    return truth, known


@query("truth_classes", f"with {_TRUTH} select l_orderkey, l_linenumber, case when coalesce(is_guess, false) then 'guess' when name not in (select name from k) then 'name-missing' when not exists (from k where k.name = t.name and k.version = t.version) then 'version-missing' else 'known' end \"class\" from t")
def truth_classes(spark, sf_dir):
    return joins.truth_classes(*_truth(spark, sf_dir)).select("l_orderkey", "l_linenumber", "class")


@query("name_version_lookup", f"with {_TRUTH} select l_orderkey, l_linenumber, name, version from t join k using (name, version)")
def name_version_lookup(spark, sf_dir):
    return joins.with_version(*_truth(spark, sf_dir)).select("l_orderkey", "l_linenumber", "name", "version")


#: Letters only, so the order of a locale is that of lower case, ties lower case first.
@query("locale_order", """
with w as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) word from benchmark)
select word, row_number() over (order by lower(word), translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') collate "C")::int place from w""")
def locale_order(spark, sf_dir):
    """Places of the benchmark's words in the order of a locale."""
    found = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word")).distinct()
    return reports.in_locale_order(found, "word")


@query("mean_fractions", """
with x as (select l_suppkey, l_linenumber::bigint n, (l_quantity::bigint % 8) d from lineitem),
s as (select l_suppkey, sum(case when d = 0 then 840 else n * (840 // d) end)::hugeint a, count(*)::hugeint * 840 b from x group by all)
select l_suppkey, (a // gcd(a, b))::varchar num, (b // gcd(a, b))::varchar den, a::double / b::double val from s""")
def mean_fractions(spark, sf_dir):
    """Exact means of line numbers over quantities' remainders; a denominator of 0 counts as 1."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("num"), (F.col("l_quantity").cast("long") % 8).alias("den"))
    return fractions.mean_fractions(rows, ["l_suppkey"])
