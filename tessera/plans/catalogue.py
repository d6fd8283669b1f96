"""Registered queries of the engine's own operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bags as bag_fn
from tessera.functions import semver, text
from tessera.operators import assign, bags, candidates, joins, pairing, peel, reports, topk
from tessera.plans.registry import Query, registry
from tessera.sources import pages, sinks
from tessera.sources.tables import conversation_functions, functions, library_functions, lines, table, words

QUERIES, ORACLE, query = registry()

_LINES = """
lines as (
  select doc_id, source, lang, unnest(range(len(l)))::int idx, unnest(l) line
  from (select doc_id, source, lang, string_split(text, chr(10)) l from documents)
),
fn as (select *, string_split(line, ' ') tokens, list_sort(string_split(line, ' ')) bag, string_split(line, ' ')[1] name from lines where line <> '')
"""


def _words(name: str, key: str, source: str) -> str:
    return f"{name} as (select {key}, w word from (select {key}, unnest(string_split(replace(text, chr(10), ' '), ' ')) w from {source}) where w <> '')"


_SIDES = """
u as (select doc_id, line, count(*) n from fn group by all),
b as (select source lib, line, count(*) n from fn group by all),
us as (select doc_id, sum(n) s from u group by all),
bs as (select lib, sum(n) s from b group by all),
ov as (select doc_id, lib, sum(least(u.n, b.n))::bigint num from u join b using (line) group by all),
sized as (select ov.*, us.s::bigint n_left, bs.s::bigint n_right from ov join us using (doc_id) join bs using (lib))
"""


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = functions(spark, sf_dir)
    return bags.bag_overlap(bags.counts(fn, "doc_id", "line"), bags.counts(fn.withColumnRenamed("source", "lib"), "lib", "line"), "doc_id", "lib", "line")


def _portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.scored(_overlap(spark, sf_dir), "portion")


_PORTION = f"{_LINES}, {_SIDES}, portion as (select doc_id, lib, num, n_right den, num / n_right val from sized)"


@query("lib_portion_docs", f"with {_PORTION} select * from portion")
def lib_portion_docs(spark, sf_dir):
    return _portions(spark, sf_dir)


@query("bag_jaccard_docs", f"with {_LINES}, {_SIDES} select doc_id, lib, num, n_left + n_right - num den, num / (n_left + n_right - num) val from sized")
def bag_jaccard_docs(spark, sf_dir):
    return bags.scored(_overlap(spark, sf_dir), "jaccard")


@query("exact_containment_docs", f"with {_LINES}, u as (select distinct doc_id, line from fn), b as (select distinct source lib, line from fn), us as (select doc_id, count(*) s from u group by all) select doc_id, lib, count(*)::bigint num from u join b using (line) join us using (doc_id) group by doc_id, lib, s having count(*) = s")
def exact_containment_docs(spark, sf_dir):
    fn = functions(spark, sf_dir)
    return candidates.contained(fn, fn.withColumnRenamed("source", "lib"), "doc_id", "lib", "line")


_PAIRED = """
ur as (select doc_id, idx unknown_idx, bag, row_number() over (partition by doc_id, bag order by idx) k from fn),
lr as (select source lib, doc_id * 4294967296 + idx lib_idx, bag, row_number() over (partition by source, bag order by doc_id * 4294967296 + idx) k from fn),
mapping as (select ur.doc_id, lib, unknown_idx, lib_idx from ur join lr using (bag, k))
"""


def _fn_sides(spark, sf_dir):
    u = functions(spark, sf_dir).withColumn("bag", pairing.bag_key("tokens"))
    return u, library_functions(spark, sf_dir).withColumn("bag", pairing.bag_key("tokens")).withColumnRenamed("source", "lib")


@query("fn_match_v6_mapping", f"with {_LINES}, {_PAIRED} select * from mapping")
def fn_match_v6_mapping(spark, sf_dir):
    u, b = _fn_sides(spark, sf_dir)
    return pairing.pair_equal(u, b, "doc_id", "lib", "bag")


_MATCHED = f"{_LINES}, {_PAIRED}, m as (select doc_id, lib, count(*)::bigint num from mapping group by all), nu as (select doc_id, count(*)::bigint n from fn group by all), nl as (select source lib, count(*)::bigint n from fn group by all)"


@query("fn_match_v6", f"with {_MATCHED} select doc_id, lib, num, nl.n den, num / nl.n val from m join nl using (lib)")
def fn_match_v6(spark, sf_dir):
    u, b = _fn_sides(spark, sf_dir)
    return pairing.match_scores(pairing.pair_equal(u, b, "doc_id", "lib", "bag"), u, b, "doc_id", "lib", "v6")


@query("fn_match_v5", f"with {_MATCHED} select doc_id, lib, num, nu.n + nl.n - num den, num / (nu.n + nl.n - num) val from m join nl using (lib) join nu using (doc_id)")
def fn_match_v5(spark, sf_dir):
    u, b = _fn_sides(spark, sf_dir)
    return pairing.match_scores(pairing.pair_equal(u, b, "doc_id", "lib", "bag"), u, b, "doc_id", "lib", "v5")


_NAMES = f"{_LINES}, un as (select doc_id, name, min(idx) unknown_idx from fn group by all), ln as (select source lib, name, min(doc_id * 4294967296 + idx) lib_idx from fn group by all), m as (select doc_id, lib, count(*)::bigint num from un join ln using (name) group by all), nu as (select doc_id, count(*)::bigint n from un group by all), nl as (select lib, count(*)::bigint n from ln group by all)"


@query("names_our", f"with {_NAMES} select doc_id, lib, num, nl.n den, num / nl.n val from m join nl using (lib)")
def names_our(spark, sf_dir):
    u, b = _fn_sides(spark, sf_dir)
    return pairing.match_names(u, b, "doc_id", "lib", "our")[1]


@query("names_jaccard", f"with {_NAMES} select doc_id, lib, num, nu.n + nl.n - num den, num / (nu.n + nl.n - num) val from m join nl using (lib) join nu using (doc_id)")
def names_jaccard(spark, sf_dir):
    u, b = _fn_sides(spark, sf_dir)
    return pairing.match_names(u, b, "doc_id", "lib", "jaccard")[1]


@query("names_mapping", f"with {_NAMES} select doc_id, lib, unknown_idx, lib_idx, 1.0::double val, -1::bigint num, -1::bigint den from un join ln using (name)")
def names_mapping(spark, sf_dir):
    u, b = _fn_sides(spark, sf_dir)
    return pairing.match_names(u, b, "doc_id", "lib")[0].select("doc_id", "lib", "unknown_idx", "lib_idx", "prob.val", "prob.num", "prob.den")


_CONV_ITEM = f"with {_words('uw', 'conv_id', 'conversations')}, {_words('lw', 'item_id', 'benchmark')}, u as (select conv_id, word, count(*) n from uw group by all), b as (select item_id, word, count(*) n from lw group by all), us as (select conv_id, sum(n)::bigint s from u group by all), bs as (select item_id, sum(n)::bigint s from b group by all)"


@query("lit_vals_match", f"{_CONV_ITEM}, m as (select conv_id, item_id, sum(least(u.n, b.n))::bigint num from u join b using (word) group by all) select conv_id, item_id, num, us.s + bs.s - num den, num / (us.s + bs.s - num) val from m join us using (conv_id) join bs using (item_id)")
def lit_vals_match(spark, sf_dir):
    u, b = words(table(spark, sf_dir, "conversations"), ["conv_id"]), words(table(spark, sf_dir, "benchmark"), ["item_id"])
    return bags.scored(bags.bag_overlap(bags.counts(u, "conv_id", "word"), bags.counts(b, "item_id", "word"), "conv_id", "item_id", "word"), "jaccard")


_DOC_ITEM = f"with {_words('uw0', 'doc_id', 'documents')}, {_words('lw0', 'item_id', 'benchmark')}, uw as (select distinct * from uw0), lw as (select distinct * from lw0), us as (select doc_id, count(*)::bigint s from uw group by all), bs as (select item_id, count(*)::bigint s from lw group by all), pairs as (select doc_id, item_id, count(*)::bigint num, any_value(us.s) nl, any_value(bs.s) nr from uw join lw using (word) join us using (doc_id) join bs using (item_id) group by all)"


@query("candidate_libs", f"{_DOC_ITEM}, within as (select doc_id, item_id, 1.0::double val, -1::bigint num, -1::bigint den from pairs where num = nl), near as (select doc_id, item_id, num / (nl + nr - num) val, num, nl + nr - num den from pairs where doc_id not in (select doc_id from within)), best as (select *, row_number() over (partition by doc_id order by val desc, item_id)::int top from near qualify top <= 10) select *, row_number() over (partition by doc_id order by item_id)::int top from within union all select * from best")
def candidate_libs(spark, sf_dir):
    files, libs = words(table(spark, sf_dir, "documents"), ["doc_id"]), words(table(spark, sf_dir, "benchmark"), ["item_id"])
    return candidates.candidate_libs(files, libs, "doc_id", "item_id", "word", candidates.PER_FILE)


@query("set_jaccard_topk", f"{_DOC_ITEM} select doc_id, item_id, num, nl + nr - num den, num / (nl + nr - num) val, row_number() over (partition by item_id order by num / (nl + nr - num) desc, doc_id)::int top from pairs qualify top <= 5")
def set_jaccard_topk(spark, sf_dir):
    files, libs = words(table(spark, sf_dir, "documents"), ["doc_id"]), words(table(spark, sf_dir, "benchmark"), ["item_id"])
    return candidates.similar_files(files, libs, "doc_id", "item_id", "word", 5)


def _bag_sql(op: str, flip: bool = False) -> str:
    a, b = ("lw", "uw") if flip else ("uw", "lw")
    return f"with {_words('uw', '1 one', 'conversations')}, {_words('lw', '1 one', 'benchmark')} select word from {a} {op} all select word from {b}"


def _two_bags(spark, sf_dir):
    return (words(table(spark, sf_dir, t), []) for t in ("conversations", "benchmark"))


@query("bag_intersect_all", _bag_sql("intersect"))
def bag_intersect_all(spark, sf_dir):
    return bags.intersect_all(*_two_bags(spark, sf_dir))


@query("bag_except_all", _bag_sql("except"))
def bag_except_all(spark, sf_dir):
    return bags.except_all(*_two_bags(spark, sf_dir))


@query("bag_reverse_except", _bag_sql("except", True))
def bag_reverse_except(spark, sf_dir):
    a, b = _two_bags(spark, sf_dir)
    return bags.except_all(b, a)


_TURN_BAGS = """
with t as (select conv_id, string_split(replace(string_agg(case when role = 'user' then text end, ' ' order by turn), chr(10), ' '), ' ') ua,
           string_split(replace(string_agg(case when role <> 'user' then text end, ' ' order by turn), chr(10), ' '), ' ') la from conversations group by all),
tt as (select conv_id, coalesce(ua, []) ua, coalesce(la, []) la from t),
"""


def _turn_bags(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c & F.col("text").isNotNull(), F.struct("turn", "text")))), lambda s: s["text"])
    split = lambda a: F.when(F.size(a) > 0, F.split(F.translate(F.concat_ws(" ", a), "\n", " "), " ")).otherwise(F.array().cast("array<string>"))
    return turns.groupBy("conv_id").agg(side(F.col("role") == "user").alias("u"), side(F.col("role") != "user").alias("b")).select("conv_id", split(F.col("u")).alias("u"), split(F.col("b")).alias("b"))


@query("set_operations", f"{_TURN_BAGS} s as (select conv_id, list_distinct(ua) u, list_distinct(la) b, len(ua) nu from tt), x as (select *, len(list_intersect(u, b))::bigint i from s) select conv_id, i n_common, (len(u) + len(b) - i)::bigint n_union, (len(u) - i)::bigint n_difference, i = len(u) is_subset, i / (len(u) + len(b) - i) jaccard, case when len(b) = 0 then (case when nu = 0 then 1.0 else 0.0 end) else i / len(b) end lib_share from x")
def set_operations(spark, sf_dir):
    u, b = F.col("u"), F.col("b")
    size = lambda c: F.size(c).cast("long")
    return _turn_bags(spark, sf_dir).select("conv_id", size(bag_fn.intersection(u, b)).alias("n_common"), size(bag_fn.union(u, b)).alias("n_union"), size(bag_fn.difference(u, b)).alias("n_difference"), bag_fn.is_subset(u, b).alias("is_subset"), bag_fn.set_jaccard(u, b)["val"].alias("jaccard"), bag_fn.set_portion(b, u)["val"].alias("lib_share"))


@query("bag_operations", f"{_TURN_BAGS} u as (select conv_id, w, count(*) n from (select conv_id, unnest(ua) w from tt) group by all), b as (select conv_id, w, count(*) n from (select conv_id, unnest(la) w from tt) group by all), m as (select conv_id, sum(least(u.n, b.n))::bigint num from u join b using (conv_id, w) group by all) select conv_id, coalesce(num, 0)::bigint num, (len(ua) + len(la) - coalesce(num, 0))::bigint den, coalesce(num, 0) / (len(ua) + len(la) - coalesce(num, 0)) jaccard, case when len(la) = 0 then (case when len(ua) = 0 then 1.0 else 0.0 end) else coalesce(num, 0) / len(la) end portion, (len(ua) - coalesce(num, 0))::bigint n_rest, (len(la) - coalesce(num, 0))::bigint n_reverse from tt left join m using (conv_id)")
def bag_operations(spark, sf_dir):
    u, b = F.col("u"), F.col("b")
    s = _turn_bags(spark, sf_dir).withColumns({"s": bag_fn.bag_jaccard(u, b), "p": bag_fn.lib_portion(u, b)})
    n = F.col("s.num")
    return s.select("conv_id", n.alias("num"), F.col("s.den").alias("den"), F.col("s.val").alias("jaccard"), F.col("p.val").alias("portion"), (F.size(u) - n).alias("n_rest"), (F.size(b) - n).alias("n_reverse"))


@query("version_shuffle_order", "with a as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 i, floor((count(*) over (partition by p_brand) - 1) * 9 / 10) s from part) select p_brand, p_partkey, row_number() over (partition by p_brand order by abs(i - s), i > s)::int pos from a")
def version_shuffle_order(spark, sf_dir):
    return topk.version_order(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", ["p_partkey"])


@query("top5_matches_per_lib", f"with {_PORTION} select *, row_number() over (partition by lib order by val desc, doc_id)::int top from portion qualify top <= 5")
def top5_matches_per_lib(spark, sf_dir):
    return topk.top_k(_portions(spark, sf_dir), ["lib"], [F.desc("val"), "doc_id"], 5)


@query("top25_then_top100", f"with {_PORTION}, each as (select * from portion qualify row_number() over (partition by lib order by val desc, doc_id) <= 25) select * from each order by val desc, lib, doc_id limit 100")
def top25_then_top100(spark, sf_dir):
    return topk.top_of_top(_portions(spark, sf_dir), "lib", [F.desc("val"), "lib", "doc_id"])


@query("first_exact_prefix", f"with {_LINES}, {_SIDES}, r as (select doc_id, lib, num = n_left exact from sized), q as (select *, coalesce(sum(exact::int) over (partition by doc_id order by lib rows between unbounded preceding and 1 preceding), 0) seen from r) select doc_id, lib, exact from q where seen = 0")
def first_exact_prefix(spark, sf_dir):
    rows = _overlap(spark, sf_dir).select("doc_id", "lib", (F.col("num") == F.col("n_left")).alias("exact"))
    return topk.until_first(rows, ["doc_id"], "lib", F.col("exact"))


_MENTION = r"([\w-]+)\s+(?:@?version\s+)?(v?\d+\.\d+\.\d+)"


@query("name_version_mentions", f"select doc_id, unnest(regexp_extract_all(text, '{_MENTION}', 1)) as name, unnest(regexp_extract_all(text, '{_MENTION}', 2)) as version from documents")
def name_version_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(text.mentions(F.col("text"))).alias("m")).select("doc_id", "m.name", "m.version")


@query("mention_first", rf"with {_LINES} select doc_id, idx, regexp_extract(line, '(\w+)\s(\d+\.\d+\.\d+)', 1) as name, regexp_extract(line, '(\w+)\s(\d+\.\d+\.\d+)', 2) as version from fn where regexp_matches(line, '(\w+)\s(\d+\.\d+\.\d+)')")
def mention_first(spark, sf_dir):
    rows = lines(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("m", text.first_mention(F.col("line")))
    return rows.filter("m is not null").select("doc_id", "idx", "m.name", "m.version")


@query("mention_counts", f"with m as (select doc_id, unnest(regexp_extract_all(text, '{_MENTION}', 1)) as name, unnest(regexp_extract_all(text, '{_MENTION}', 2)) as version from documents), e as (select name, version, count(*) n, min(doc_id) f from m group by all) select name, sum(n)::bigint n, string_agg(version, ' ' order by f, version) versions from e group by name")
def mention_counts(spark, sf_dir):
    seen = name_version_mentions(spark, sf_dir).withColumnRenamed("doc_id", "seq")
    return reports.mention_counts(seen).select("name", "n", F.array_join("versions", " ").alias("versions"))


@query("name_count", r"select doc_id, len(regexp_extract_all(text, '[\W_]the[\W_]'))::int n from documents where regexp_matches(text, '[\W_]the[\W_]')")
def name_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.name_count(F.col("text"), F.lit("the")).alias("n")).filter("n > 0")


@query("most_used_libs", f"with {_words('lw', 'item_id', 'benchmark')}, names as (select distinct word from lw), {_words('dw', 'doc_id', 'documents')} select distinct word as name from names where word in (select word from dw)")
def most_used_libs(spark, sf_dir):
    names = words(table(spark, sf_dir, "benchmark"), []).distinct().withColumnRenamed("word", "name")
    return names.join(words(table(spark, sf_dir, "documents"), []).withColumnRenamed("word", "name"), "name", "left_semi")


@query("minified_lines", "with l as (select doc_id, string_split(text, chr(10)) l, length(text) n from documents), a as (select doc_id, n, len(l) k, floor(list_sum(list_transform(l, lambda x: length(x))) / len(l))::bigint average, case when n > 0 then list_reduce(list_prepend(0.0::double, list_transform(l, lambda x: length(x)::double)), lambda acc, x: (acc + x * x) / n) / len(l) end r from l) select doc_id, average, round(r, 9) ratio, average > 130 or coalesce(r > 0.9, false) minified from a")
def minified_lines(spark, sf_dir):
    src = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.average_line_length(src).alias("average"), F.round(text.long_lines_ratio(src), 9).alias("ratio"), text.is_minified(src).alias("minified"))


@query("page_comments", "select page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) as comment from pages")
def page_comments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<!--(.*?)-->"), 1)).alias("comment"))


@query("script_tags", "select page_id, unnest(range(len(s)))::int idx, unnest(s) content from (select page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) s from pages)")
def script_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1)).alias("idx", "content"))


@query("url_kinds", "select page_id, regexp_extract(url, '^([a-z]+):', 1) scheme, case when url like 'http:%' or url like 'https:%' then 'http' else 'unknown' end kind, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host from pages")
def url_kinds(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url(url, F.lit("PROTOCOL")).alias("scheme"), text.source_kind(url).alias("kind"), F.parse_url(url, F.lit("HOST")).alias("host"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("app_lib_matrix", f"select n_name, {', '.join(f'''max((c_mktsegment = '{s}')::int)::int "{s}"''' for s in SEGMENTS)} from customer join nation on c_nationkey = n_nationkey group by n_name")
def app_lib_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.presence_matrix(rows, "n_name", "c_mktsegment", SEGMENTS)


@query("lib_vuln_matrix", "with p as (select distinct p_brand, p_size from part) select a.p_brand, s.p_size, (p.p_brand is not null)::int present from (select distinct p_brand from part) a cross join (select distinct p_size from part) s left join p on p.p_brand = a.p_brand and p.p_size = s.p_size")
def lib_vuln_matrix(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return reports.presence_pairs(part, part, part, "p_brand", "p_size")


@query("report_csv", "select regexp_replace(p_name, '^([^,]*),', '\\1_') || ',' || p_brand || ',' || p_size as line from part")
def report_csv(spark, sf_dir):
    return table(spark, sf_dir, "part").select(text.csv_line(F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")).alias("line"))


@query("resume_anti_join", "select o_orderkey, o_orderstatus from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def resume_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unfinished(table(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("resume_partial_key", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def resume_partial_key(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unfinished(table(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey", "c_name")


@query("analysed_files", "select d.doc_id, coalesce(l.quality, -1)::int quality, coalesce(l.toxic, -1)::int toxic, coalesce(b.item_id, -1)::bigint item_id from documents d left join labels l using (doc_id) left join benchmark b on b.item_id = d.doc_id")
def analysed_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels")
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "item_id")
    return joins.analysed(docs, labels.select("doc_id", "quality"), labels.select("doc_id", "toxic"), item, ["doc_id"]).fillna(-1).select("doc_id", "quality", "toxic", "item_id")


@query("status_counts", "with pre as (select distinct o_custkey k from orders), ana as (select distinct o_custkey k from orders join lineitem on l_orderkey = o_orderkey) select c_mktsegment, count(*)::bigint as \"all\", count(pre.k)::bigint preprocessed, count(ana.k)::bigint analysed from customer left join pre on pre.k = c_custkey left join ana on ana.k = c_custkey group by all")
def status_counts(spark, sf_dir):
    pool, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    pre = pool.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    items = orders.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return reports.status(pool, pre, pool.join(items, F.col("o_custkey") == F.col("c_custkey"), "left_semi"), "c_mktsegment")


_OUTCOME = """
with e as (select l_orderkey, bool_or(l_quantity < 2) empty from lineitem group by all),
o as (select o_orderkey, o_orderdate, c_mktsegment, o_orderstatus, coalesce(empty, true) empty, o_orderpriority from orders join customer on c_custkey = o_custkey left join e on l_orderkey = o_orderkey),
x as (select o_orderkey, case when not regexp_matches(o_orderpriority, '^[1-4]-') then 'failParseName' when o_orderdate > timestamp '1998-01-01' then 'exclTime' when c_mktsegment = 'BUILDING' or (c_mktsegment = 'MACHINERY' and o_orderstatus = 'O') then 'exclBL' when empty then 'emptySig' when o_orderstatus <> 'P' then 'ok' else 'fail' end as outcome from o)
"""


def _outcomes(spark, sf_dir):
    empty = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_quantity") < 2).alias("empty"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(empty, "o_orderkey", "left")
    bl = spark.createDataFrame([("BUILDING", "all", None), ("MACHINERY", "list", ["O"]), ("FURNITURE", "none", None)], "name string, versions string, version_list array<string>")
    listed = joins.blacklisted(orders.withColumnRenamed("c_mktsegment", "name").withColumnRenamed("o_orderstatus", "version"), bl)
    late = joins.after_cutoff(F.col("o_orderdate").cast("string"), F.lit("1998-01-01").cast("timestamp"))
    label = joins.outcome(F.col("o_orderpriority").rlike("^[1-4]-"), late, F.col("blacklisted"), F.coalesce("empty", F.lit(True)), F.col("version") != "P")
    return listed.select("o_orderkey", label.alias("outcome"))


@query("blacklist_cutoff_outcome", f"{_OUTCOME} select * from x")
def blacklist_cutoff_outcome(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query("outcome_histogram", f"{_OUTCOME} select {', '.join(f'''count(*) filter (outcome = '{v}') as \"{v}\"''' for v in joins.OUTCOMES)}, count(*) total from x")
def outcome_histogram(spark, sf_dir):
    return reports.histogram(_outcomes(spark, sf_dir), "outcome", joins.OUTCOMES)


_CASCADE = f"with {_PORTION}, r as (select doc_id, lib, row_number() over (partition by doc_id order by num desc, lib) top from portion), t as (select doc_id, source lib from documents), d as (select t.doc_id, t.lib, case when r.top = 1 then 'top' when r.top is not null then 'secondary' else 'missed' end as found from t left join r using (doc_id, lib))"


def _detected(spark, sf_dir):
    ranked = topk.top_k(_overlap(spark, sf_dir).select("doc_id", F.col("lib").alias("name"), "num"), ["doc_id"], [F.desc("num"), "name"], 1 << 30)
    truth = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"))
    return joins.detection(truth, ranked.filter("top = 1"), ranked.filter("top > 1"), ["doc_id"])


@query("detection_cascade", f"{_CASCADE} select doc_id, lib, found from d")
def detection_cascade(spark, sf_dir):
    return _detected(spark, sf_dir).select("doc_id", F.col("name").alias("lib"), "found")


@query("detection_ratios", f"{_CASCADE} select count(*) filter (found = 'top') / count(*) as top, count(*) filter (found = 'secondary') / count(*) secondary, count(*) filter (found <> 'missed') / count(*) detected, count(*) filter (found = 'missed') / count(*) missed from d")
def detection_ratios(spark, sf_dir):
    return reports.detection_ratios(_detected(spark, sf_dir))


@query("precision_recall", "with x as (select toxic, regexp_matches(text, 'idiot|moron') claimed from labels join documents using (doc_id)) select count(*) filter (claimed and toxic = 1) correct, count(*) filter (claimed) claimed, count(*) filter (claimed and toxic = 1) / count(*) filter (claimed) \"precision\", count(*) filter (claimed and toxic = 1) / 17 recall from x")
def precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("toxic", F.col("text").rlike("idiot|moron").alias("claimed"))
    return reports.precision_recall(rows, F.col("claimed") & (F.col("toxic") == 1), F.col("claimed"), 17)


@query("version_time_dedup", "select user_id, event_type, arg_min(value, event_id) as value, count(distinct value) > 1 as conflict from events group by all")
def version_time_dedup(spark, sf_dir):
    return reports.first_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")


_RANGES = [("Brand#11", ["^10.2.0", "45.x"]), ("Brand#12", ["<5.0.0 || >=40.1.2"]), ("Brand#13", ["~7.3.1"]), ("Brand#21", ["*"]), ("Brand#22", ["3.0.0 - 4.5"])]


@query("semver_range_join", "with v as (select distinct p_brand as name, p_size a, p_partkey % 10 b, p_partkey % 7 c from part) select name, a || '.' || b || '.' || c as version, 'V-' || right(name, 2) id from v where (name = 'Brand#11' and ((a = 10 and b >= 2) or a = 45)) or (name = 'Brand#12' and (a < 5 or (a, b, c) >= (40, 1, 2))) or (name = 'Brand#13' and a = 7 and b = 3 and c >= 1) or name = 'Brand#21' or (name = 'Brand#22' and (a, b, c) >= (3, 0, 0) and (a, b) < (4, 6))")
def semver_range_join(spark, sf_dir):
    libs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.col("p_partkey") % 7).alias("version")).distinct()
    vulns = spark.createDataFrame([(n, r, ["V-" + n[-2:]]) for n, r in _RANGES], "name string, ranges array<string>, ids array<string>")
    return joins.vulnerable(libs, vulns)


@query("semver_valid", r"select p_partkey, p_size || '.' || (p_partkey % 10) || case when p_partkey % 3 = 0 then '' else '.' || (p_partkey % 7) end as version, p_partkey % 3 <> 0 valid from part")
def semver_valid(spark, sf_dir):
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey") % 10, F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), F.col("p_partkey") % 7)))
    return table(spark, sf_dir, "part").select("p_partkey", version.alias("version"), semver.is_valid(version).alias("valid"))


@query("range_union", "with r as (select distinct p_brand as name, p_size || '.x' r from part) select name, string_agg(r, ' || ' order by r) as \"range\" from r group by name")
def range_union(spark, sf_dir):
    vulns = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.array(F.concat(F.col("p_size").cast("string"), F.lit(".x"))).alias("ranges"))
    return reports.range_union(vulns)


@query("location_report", "with x as (select source, lang, count(*) n, count(*) filter (n_chars < 400) z from documents group by all) select source, sum(n)::bigint total_files, sum(z)::bigint no_candidates, string_agg(lang || ':' || n || ':' || z, ' ' order by lang) per_location from x group by source")
def location_report(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("location"), F.col("doc_id").alias("id"), "n_chars")
    out = reports.location_report(files, ["source"], F.col("n_chars") >= 400)
    entry = lambda k: F.concat_ws(":", k, F.col("total_per_location")[k].cast("string"), F.size(F.col("no_candidates_per_location")[k]).cast("string"))
    return out.select("source", "total_files", "no_candidates", F.array_join(F.transform(F.array_sort(F.map_keys("total_per_location")), entry), " ").alias("per_location"))


@query("literal_union", f"with {_words('w', 'source', 'documents')} select source, count(distinct word) n_literals from w group by source")
def literal_union(spark, sf_dir):
    return words(table(spark, sf_dir, "documents"), ["source"]).distinct().groupBy("source").agg(F.count("*").alias("n_literals"))


@query("job_matrix", "select m.method, d.source, l.lang from (values ('fn-st-toks-v6'), ('lit-vals')) m(method) cross join (select distinct source from documents) d cross join (select distinct lang from documents) l")
def job_matrix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return joins.job_matrix(spark.createDataFrame([("fn-st-toks-v6",), ("lit-vals",)], "method string"), docs.select("source"), docs.select("lang"))


@query("match_classes", "select p_partkey, case count(l_partkey) when 0 then 'none' when 1 then 'one' else 'more' end as matches from part left join lineitem on l_partkey = p_partkey group by p_partkey")
def match_classes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return joins.match_count(table(spark, sf_dir, "part").select("p_partkey"), items, ["p_partkey"])


@query("apps_without_private", "select distinct source, lang from documents where not starts_with(source, '_') and source is not null")
def apps_without_private(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "lang").filter(~F.col("source").startswith("_")).distinct()


@query("left_padded_ids", "select doc_id, lpad(doc_id::varchar, greatest(4, length(doc_id::varchar))::int, '0') id from documents")
def left_padded_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.left_pad(F.col("doc_id").cast("string")).alias("id"))


@query("fraction_table", "with x as (select source, count(*) n, count(*) filter (lang = 'en') k from documents group by all) select source, (k / gcd(k, n))::bigint num, (n / gcd(k, n))::bigint den from x")
def fraction_table(spark, sf_dir):
    x = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("k"))
    return x.select("source", bag_fn.reduced(F.col("k"), F.col("n")).alias("f")).select("source", "f.num", "f.den")


def _assigned(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        unknown, lib = conversation_functions(spark, sf_dir)
        pairs = table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").alias("lib_id")).distinct()
        found = assign.match_pairs(pairs, unknown, lib, "conv_id", "lib_id", name)
        joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
        return found.select("conv_id", "lib_id", "num", "den", "val", joined("unknown_idx"), joined("lib_idx"))

    return run


#: Turns of a conversation: user turns are the unknown side, others the library; r numbers each side from 0.
_SIDED = """
t as (select conv_id, role = 'user' side, turn::int idx, string_split(replace(text, chr(10), ' '), ' ') tokens, string_split(text, ' ')[1] name from conversations where text is not null),
f as (select *, (row_number() over (partition by conv_id, side order by idx) - 1)::int r from t),
c as (select conv_id, count(*) filter (side)::bigint nu, count(*) filter (not side)::bigint nl from f group by conv_id),
every as (select c.* from (select distinct conv_id from conversations) e join c using (conv_id) union all select conv_id, 0, 0 from (select distinct conv_id from conversations) where conv_id not in (select conv_id from c))
"""


def _similar(token: str) -> str:
    """Pairs (u, l, v) of turns with the bag Jaccard of their tokens, above 0."""
    return f"""
w as (select conv_id, side, r, {token} tok, count(*) n from (select conv_id, side, r, unnest(tokens) x from f) group by all),
s as (select conv_id, side, r, len(tokens) s from f),
o as (select a.conv_id, a.r u, b.r l, sum(least(a.n, b.n)) m from w a join w b on a.conv_id = b.conv_id and a.tok = b.tok and a.side and not b.side group by all),
p as (select o.conv_id, u, l, m, x.s + y.s - m d, m / (x.s + y.s - m) v from o join s x on x.conv_id = o.conv_id and x.side and x.r = u join s y on y.conv_id = o.conv_id and not y.side and y.r = l)
"""


def _in_turn(me: str, other: str) -> str:
    """One side chooses in order: a recursion that carries who is taken."""
    return f"""
st as (
  select conv_id, 0 step, []::int[] taken, null::int got from every
  union all
  select q.conv_id, q.step + 1, case when o is null then taken else list_append(taken, o) end, o
  from (select st.conv_id, st.step, any_value(st.taken) taken, -(max({{'v': p.v, 'o': -p.{other}}})).o o
        from st join (select conv_id, max({me}) last from p group by all) k on k.conv_id = st.conv_id and st.step <= k.last
        left join p on p.conv_id = st.conv_id and p.{me} = st.step and not list_contains(st.taken, p.{other}) group by all) q
),
mapping as (select conv_id, {"step - 1 u, got l" if me == "u" else "got u, step - 1 l"} from st where got is not null)
"""


_BEST_FIRST = """
st as (
  select conv_id, 0 step, []::int[] tu, []::int[] tl, {'v': 0.0::double, 'u': 0, 'l': 0} b from every
  union all
  select conv_id, step + 1, list_append(tu, -b.u), list_append(tl, -b.l), b
  from (select st.conv_id, st.step, any_value(st.tu) tu, any_value(st.tl) tl, max({'v': p.v, 'u': -p.u, 'l': -p.l}) b
        from st join p on p.conv_id = st.conv_id and not list_contains(st.tu, p.u) and not list_contains(st.tl, p.l) group by all) q
),
mapping as (select conv_id, -b.u u, -b.l l from st where step > 0)
"""
_EXACT = "k as (select *, row_number() over (partition by conv_id, side, {key} order by r) q from (select *, list_sort(tokens) bag from f)), mapping as (select a.conv_id, a.r u, b.r l from k a join k b on a.conv_id = b.conv_id and a.{key} = b.{key} and a.q = b.q and a.side and not b.side)"
_FIRST = "k as (select conv_id, side, name, min(r) r from f group by all), mapping as (select a.conv_id, a.r u, b.r l from k a join k b on a.conv_id = b.conv_id and a.name = b.name and a.side and not b.side)"


def _assigned_sql(mapping: str, den: str = "nu + nl - m", empty: str = "1.0", counts: str = "every") -> str:
    return f"""
with recursive {_SIDED}, {mapping},
g as (select mapping.conv_id, count(*)::bigint m, string_agg(x.idx::varchar, ',' order by x.idx) ui, string_agg(y.idx::varchar, ',' order by x.idx) li from mapping join f x on x.conv_id = mapping.conv_id and x.side and x.r = u join f y on y.conv_id = mapping.conv_id and not y.side and y.r = l group by mapping.conv_id),
z as (select conv_id, nu, nl, coalesce(m, 0) m, coalesce(ui, '') ui, coalesce(li, '') li from {counts} left join g using (conv_id))
select conv_id, conv_id lib_id, m num, ({den})::bigint den, case when ({den}) = 0 then {empty} else m / ({den}) end val, ui unknown_idx, li lib_idx from z
"""


#: v2's score times the mean of its pairs' scores, over the product of their denominators, in lowest terms.
_V4_EXACT = f"""
with recursive {_SIDED}, {_similar('x')}, {_in_turn('l', 'u')},
g as (select mapping.conv_id, count(*)::bigint m, string_agg(x.idx::varchar, ',' order by x.idx) ui, string_agg(y.idx::varchar, ',' order by x.idx) li, list(p.m::hugeint) ms, list(p.d::hugeint) ds from mapping join f x on x.conv_id = mapping.conv_id and x.side and x.r = u join f y on y.conv_id = mapping.conv_id and not y.side and y.r = l join p on p.conv_id = mapping.conv_id and p.u = mapping.u and p.l = mapping.l group by mapping.conv_id),
wd as (select *, list_reduce(list_prepend(1::hugeint, ds), lambda a, b: a * b) whole from g),
h as (select conv_id, m, ui, li, whole * m below, list_reduce(list_prepend(0::hugeint, list_transform(range(1, len(ds) + 1), lambda i: ms[i] * (whole // ds[i]))), lambda a, b: a + b) total from wd),
z as (select conv_id, nu + nl - coalesce(m, 0) size_, coalesce(ui, '') ui, coalesce(li, '') li, coalesce(m * total, 0) a, coalesce((nu + nl - m) * below, 1) b from every left join h using (conv_id)),
r as (select *, greatest(gcd(a, b), 1) q from z)
select conv_id, conv_id lib_id, case when size_ = 0 then 0 else a // q end::bigint num, case when size_ = 0 then 0 else b // q end::bigint den, case when size_ = 0 then 1.0 else a::double / b::double end val, ui unknown_idx, li lib_idx from r
"""

_ONE_SIDED = "case when nu = 0 then 1.0 else 0.0 end"
_NAMES_COUNTED = "(select conv_id, count(k.name) filter (side) nu, count(k.name) filter (not side) nl from every left join k using (conv_id) group by conv_id)"
for _name, _sql in {
    "fn-st-toks-v1": _assigned_sql(f"{_similar('x')}, {_in_turn('u', 'l')}"),
    "fn-st-toks-v2": _assigned_sql(f"{_similar('x')}, {_in_turn('l', 'u')}"),
    "fn-st-toks-v3": _assigned_sql(f"{_similar('x')}, {_BEST_FIRST}"),
    "fn-st-types": _assigned_sql(f"{_similar('left(x, 2)')}, {_in_turn('u', 'l')}"),
    "fn-st-toks-v5": _assigned_sql(_EXACT.format(key="bag")),
    "fn-st-toks-v6": _assigned_sql(_EXACT.format(key="bag"), "nl", _ONE_SIDED),
    "fn-names-st-toks": _assigned_sql(_EXACT.format(key="name")),
    "fn-names-jaccard": _assigned_sql(_FIRST, counts=_NAMES_COUNTED),
    "fn-names-our": _assigned_sql(_FIRST, "nl", _ONE_SIDED, _NAMES_COUNTED),
    "fn-st-toks-v4": _V4_EXACT,
}.items():
    query("assign_" + _name.replace("-", "_"), _sql)(_assigned(_name))


#: As above with pairs for conversations: each one's user turns meet the other turns of it and of the next one.
_SEVERAL = _SIDED.replace("t as (select conv_id, role = 'user' side, turn::int idx, string_split(replace(text, chr(10), ' '), ' ') tokens, string_split(text, ' ')[1] name from conversations where text is not null)", """
pr as (select distinct c.conv_id c, l.conv_id l, c.conv_id * 2 + l.conv_id - c.conv_id conv_id from conversations c join conversations l on l.conv_id in (c.conv_id, c.conv_id + 1)),
t as (select pr.conv_id, role = 'user' side, turn::int idx, string_split(replace(text, chr(10), ' '), ' ') tokens, string_split(text, ' ')[1] name from conversations v join pr on v.conv_id = case when role = 'user' then c else l end where text is not null)
""").replace("from conversations) e join c", "from pr) e join c").replace("from conversations) where conv_id not in", "from pr) where conv_id not in")


def _in_rounds(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        unknown, lib = conversation_functions(spark, sf_dir)
        convs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
        pairs = convs.withColumn("lib_id", F.explode(F.array("conv_id", F.col("conv_id") + 1))).join(convs.select(F.col("conv_id").alias("lib_id")), "lib_id", "left_semi").select("conv_id", "lib_id")
        found = assign.match_large(pairs, unknown, lib, "conv_id", "lib_id", name)
        joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
        return found.select((F.col("conv_id") * 2 + F.col("lib_id") - F.col("conv_id")).alias("conv_id"), "num", "den", "val", joined("unknown_idx"), joined("lib_idx"))

    return run


for _name, _sql in {"fn-st-toks-v2": _assigned_sql(f"{_similar('x')}, {_in_turn('l', 'u')}"), "fn-st-toks-v3": _assigned_sql(f"{_similar('x')}, {_BEST_FIRST}")}.items():
    query("several_" + _name.replace("-", "_"), _sql.replace(_SIDED, _SEVERAL).replace("select conv_id, conv_id lib_id,", "select conv_id,"))(_in_rounds(_name))


_V4 = f"{_similar('x')}, {_in_turn('l', 'u')}, a as (select mapping.conv_id, avg(v) mean from mapping join p on p.conv_id = mapping.conv_id and p.u = mapping.u and p.l = mapping.l group by mapping.conv_id)"


@query("assign_v4_values", f"""
with recursive {_SIDED}, {_V4}, g as (select conv_id, count(*)::bigint m from mapping group by conv_id)
select conv_id, conv_id lib_id, round(case when nu + nl = 0 then 1.0 else coalesce(m, 0) / (nu + nl - coalesce(m, 0)) * coalesce(mean, 1) end, 9)::double val
from every left join g using (conv_id) left join a using (conv_id)
""")
def assign_v4_values(spark, sf_dir):
    """The scores of fn-st-toks-v4 without their exact fractions, which SQL has no numbers for."""
    return _assigned("fn-st-toks-v4")(spark, sf_dir).select("conv_id", "lib_id", F.round("val", 9).alias("val"))


#: A state for each file: what is left of its functions (position, bag), which candidates matched exactly, and the last match.
#: Candidates without an equal bag never match, so they take no step; steps go over the others twice, exact matches first.
_PEELED = f"""
with recursive {_DOC_ITEM.strip().removeprefix("with ")}, {_LINES},
near as (select doc_id, item_id, case when num = nl then 1.0 else num / (nl + nr - num) end v, num = nl inside, max(num = nl) over (partition by doc_id) held from pairs),
listed as (select doc_id, item_id::varchar lib, v from near where inside or not held qualify held or row_number() over (partition by doc_id order by v desc, item_id) <= 10),
ordered as (select doc_id, lib, row_number() over (partition by doc_id order by v desc, lib)::int top from listed),
it as (select item_id::varchar lib, list_sort(string_split(line, ' ')) bag from (select item_id, unnest(string_split(text, chr(10))) line from benchmark) where line <> ''),
ids as (select bag, row_number() over () b from (select distinct bag from it)),
lb as (select lib, b, count(*) n from it join ids using (bag) group by all),
ll as (select lib, list({{'b': b, 'n': n}}) own, sum(n)::bigint total from lb group by lib),
un as (select doc_id, list({{'i': idx, 'b': coalesce(b, 0)}} order by idx) left_ from fn left join ids using (bag) group by doc_id),
hits as (select distinct doc_id, lib, top from ordered join lb using (lib) join (select distinct doc_id, b from fn join ids using (bag)) using (doc_id, b)),
seq as (select *, row_number() over (partition by doc_id order by top) step, count(*) over (partition by doc_id) k from hits),
st as (
  select doc_id, 0 turn, left_, []::bigint[] exact, ''::varchar phase, ''::varchar lib, 0 top, 0::bigint num, 0::bigint den, []::int[] mapped from un
  union all
  select doc_id, turn + 1, case when took then list_filter(left_, lambda x: not list_contains(got, x.i)) else left_ end, case when took and turn < k then list_append(exact, step) else exact end,
         case when not took then '' when turn < k then 'rank' else 'secondary' end, lib, top, len(got)::bigint, total, got
  from (select *, len(got) > 0 and (case when turn < k then len(got) = total else not list_contains(exact, step) end) took
        from (select st.doc_id, st.turn, st.left_, st.exact, seq.step, seq.k, seq.lib, seq.top, ll.total,
                     list_transform(list_filter(range(1, len(st.left_) + 1), lambda j: len(list_filter(st.left_[1:j], lambda x: x.b = st.left_[j].b)) <= coalesce(list_filter(ll.own, lambda y: y.b = st.left_[j].b)[1].n, 0)), lambda j: st.left_[j].i)::int[] got
              from st join seq on seq.doc_id = st.doc_id and st.turn < 2 * seq.k and seq.step = st.turn % seq.k + 1 join ll on ll.lib = seq.lib))
),
final as (select doc_id, arg_max(left_, turn) left_ from st group by doc_id)
select doc_id file_key, phase, lib, top, 1 as match, '1.0.0' as version, '0000' lib_file, num, den, num / den val, array_to_string(mapped, ',') mapped from st where phase <> ''
union all
select doc_id, 'remaining', null, null, null, null, null, null, null, null, array_to_string(list_transform(left_, lambda x: x.i), ',') from final
"""


@query("bundle_peel", _PEELED)
def bundle_peel(spark, sf_dir):
    files = functions(spark, sf_dir).withColumnRenamed("doc_id", "file_key").withColumn("types", F.array().cast("array<string>")).select("file_key", "idx", "name", "tokens", "types")
    items = lines(table(spark, sf_dir, "benchmark"), ["item_id"])
    libs = items.select(F.col("item_id").cast("string").alias("lib"), F.lit("1.0.0").alias("version"), F.lit("0000").alias("lib_file"), F.lit(1).alias("pos"), "idx", F.element_at(F.split("line", " "), 1).alias("name"), F.split("line", " ").alias("tokens"), F.array().cast("array<string>").alias("types"))
    chosen = candidate_libs(spark, sf_dir).select(F.col("doc_id").alias("file_key"), F.col("item_id").cast("string").alias("lib"), "val")
    return peel.peel_files(files, chosen, libs).withColumn("mapped", F.array_join(F.transform("mapped", lambda i: i.cast("string")), ","))


@query("html_script_tags", "select page_id, unnest(range(len(s)))::int idx, unnest(s) content from (select page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) s from pages)")
def html_script_tags(spark, sf_dir):
    return pages.script_tags(table(spark, sf_dir, "pages")).select("page_id", "idx", "content")


#: The pages' scripts hold one string and one number each, and no function.
@query("extract_js_signature", r"""
with s as (select page_id, unnest(range(len(s)))::int idx, unnest(s) content from (select page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) s from pages)),
l as (select page_id, idx, regexp_extract(content, '\((\d+)\)', 1)::bigint n, regexp_extract(content, '"([^"]*)"', 1) q from s)
select page_id, idx, 0::int n_functions, case when n > 5 then n || '.0|' || q else q end literals, null::varchar as error from l
""")
def extract_js_signature(spark, sf_dir):
    found = pages.extract(pages.script_tags(table(spark, sf_dir, "pages")).filter("content is not null"), ["page_id", "idx"])
    each = F.transform("literals", lambda v: F.coalesce(v["s"], v["n"].cast("string")))
    return found.select("page_id", "idx", F.size("functions").alias("n_functions"), F.array_join(each, "|").alias("literals"), "error")


@query("sampled_files", "select doc_id, source from documents order by md5('7|' || doc_id), doc_id limit 500")
def sampled_files(spark, sf_dir):
    return reports.drawn(table(spark, sf_dir, "documents").select("doc_id", "source"), 500, 7, "doc_id")


@query("formatted_table", "with x as (select source, count(*) n, count(*) filter (lang = 'en') k from documents group by all) select rpad(source, (select max(length(source)) from x)::int, ' ') || ' & ' || '\\dfrac{' || k || '}{' || n || '} (' || printf('%.1f', 100.0 * k / n) || '\\%)' as line from x")
def formatted_table(spark, sf_dir):
    x = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("k"))
    return sinks.tex_rows(x, "source", "k", "n")
