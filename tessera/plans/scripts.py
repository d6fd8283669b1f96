"""Registered queries of the JavaScript extractor: scripts are written from the tables, and SQL says what they hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.registry import registry
from tessera.sources import pages
from tessera.sources.tables import table

QUERIES, ORACLE, query = registry()

#: Statements of a function (a, b), each for every n-th part, and the tokens that the grammar gives them.
STATEMENTS = [
    (1, "var size = 77, text = 'TYPE', none;", ["de:Variable[pr:Identifier[size] = lt:Numeric]", "de:Variable[pr:Identifier[text] = lt:String]", "de:Variable[pr:Identifier[none]]"]),
    (2, "if (a > b) { size += 10; } else if (b) { text = a.name; } else { go(a, [1, b]); }", ["st:If[ex:Binary[ex:Identifier[a] > ex:Identifier[b]]]", "ex:Assignment[pr:Identifier[size] += lt:Numeric]", "st:Else-If[ex:Identifier[b]]", "ex:Assignment[pr:Identifier[text] = ex:Member[ex:Identifier[a] >>> ex:Identifier[name]]]", "st:Else", "ex:Call[ex:Identifier[go](ex:Identifier[a], ex:Array[lt:Numeric, ex:Identifier[b]])]"]),
    (3, "for (var i = 0; i < 9; i++) { a[i] = new Thing({k: i}); }", ["st:For", "de:Variable[pr:Identifier[i] = lt:Numeric]", "ex:Binary[ex:Identifier[i] < lt:Numeric]", "ex:Update[ex:Identifier[i]++]", "ex:Assignment[pr:Member[ex:Identifier[a] >c> ex:Identifier[i]] = ex:New[ex:Identifier[Thing](ex:Object[ex:Identifier[k] : ex:Identifier[i]])]]"]),
    (5, "while (b) { b -= 2; }", ["st:While[ex:Identifier[b]]", "ex:Assignment[pr:Identifier[b] -= lt:Numeric]"]),
    (4, "try { stop(); } catch (e) { throw e; } finally { b = null; }", ["st:Try-Catch-Finally[pr:Identifier[e]]", "ex:Call[ex:Identifier[stop]()]", "st:Throw[ex:Identifier[e]]", "ex:Assignment[pr:Identifier[b] = lt:Null]"]),
    (6, "switch (a) { case 1: break; default: b = !a; }", ["st:Switch[s ex:Identifier[a]; c lt:Numeric, c default]", "st:Break", "ex:Assignment[pr:Identifier[b] = ex:Unary[! ex:Identifier[a]]]"]),
    (1, "return this.size ? true : false;", ["st:Return[ex:Conditional[ex:Member[ex:This >>> ex:Identifier[size]] ? lt:Boolean : lt:Boolean]]"]),
]
#: Statement kinds of the same statements.
KINDS = ["VariableDeclaration", "IfStatement", "ForStatement", "WhileStatement", "TryStatement", "SwitchStatement", "ReturnStatement"]
PARAMETERS = ["pr:Identifier[a]", "pr:Identifier[b]"]


def _source(broken: bool = False) -> Column:
    """A script for each part: an empty function, one that only returns a function, and one with statements."""
    key = F.col("p_partkey")
    body = [F.when(key % n == 0, F.replace(F.lit(code), F.lit("TYPE"), F.col("p_type"))).otherwise("") for n, code, _ in STATEMENTS]
    own = F.concat_ws(" ", F.lit("function main(a, b) {"), *body, F.lit("}"))
    rest = F.lit("// made v1.2.3\nfunction empty() {}\nvar wrap = function () { return function () { return 1; }; };\n")
    return F.concat(rest, own, F.when(key % 10 == 0, F.lit(" }")).otherwise("") if broken else F.lit(""))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::varchar[]"


def _tokens_sql(parameters: bool, unset: bool) -> str:
    parts = [_list(PARAMETERS)] if parameters else []
    for n, _, tokens in STATEMENTS:
        parts.append(f"case when p_partkey % {n} = 0 then {_list([t for t in tokens if unset or t != 'de:Variable[pr:Identifier[none]]'])} else [] end")
    return f"array_to_string(list_sort(flatten([{', '.join(parts)}])), '|')"


_KINDS_SQL = "array_to_string(list_sort(flatten([['t_pr:Identifier', 't_pr:Identifier'], " + ", ".join(f"case when p_partkey % {n} = 0 then ['t_st:{k}'] else [] end" for (n, _, _), k in zip(STATEMENTS, KINDS, strict=True)) + "])), '|')"
_RETURNS = "'st:Return[ex:Function[anonymous]]'"


def _functions(spark, sf_dir, version: int):
    found = pages.extract(table(spark, sf_dir, "part").select("p_partkey", _source().alias("content")), ["p_partkey"], version=version)
    each = found.select("p_partkey", F.explode("functions").alias("f"))
    return each.select("p_partkey", F.col("f.index").cast("int").alias("idx"), "f.name", F.array_join("f.types", "|").alias("types"), F.array_join("f.tokens", "|").alias("tokens"))


def _functions_sql(version: int) -> str:
    rows = [
        (0, "empty", "''", "''"),
        (1, "main", _KINDS_SQL, _tokens_sql(version == 1, version != 2)),
        (2, "wrap", "'t_st:ReturnStatement'", _RETURNS),
        (3, "wrap:>>:[anonymous]", "'t_st:ReturnStatement'", "'st:Return[lt:Numeric]'"),
    ]
    # The third version leaves out functions without tokens and those that only return a function; their numbers stay free.
    kept = [r for r in rows if version < 3 or r[0] in (1, 3)]
    return " union all ".join(f"select p_partkey, {i}::int idx, '{name}' as name, {types} types, {tokens} tokens from part" for i, name, types, tokens in kept)


for _version in (1, 2, 3):
    query(f"js_functions_v{_version}", _functions_sql(_version))(lambda spark, sf_dir, v=_version: _functions(spark, sf_dir, v))


_NUMBERS = "case when p_partkey % 2 = 0 then ['10.0'] else [] end, case when p_partkey % 3 = 0 then ['9.0'] else [] end"


@query("js_literals", f"select p_partkey, array_to_string(list_sort(flatten([['77.0', 's:' || p_type], {_NUMBERS}])), '|') literals, ' made v1.2.3' comments from part")
def js_literals(spark, sf_dir):
    found = pages.extract(table(spark, sf_dir, "part").select("p_partkey", _source().alias("content")), ["p_partkey"])
    each = F.transform("literals", lambda v: F.when(v["kind"] == "s", F.concat(F.lit("s:"), v["s"])).otherwise(v["n"].cast("string")))
    return found.select("p_partkey", F.array_join(F.array_sort(each), "|").alias("literals"), F.array_join("comments", "|").alias("comments"))


@query("js_failures", "select p_partkey, p_partkey % 10 = 0 failed, case when p_partkey % 10 <> 0 then 2 end::int n_functions from part")
def js_failures(spark, sf_dir):
    found = pages.extract(table(spark, sf_dir, "part").select("p_partkey", _source(broken=True).alias("content")), ["p_partkey"])
    return found.select("p_partkey", F.col("error").isNotNull().alias("failed"), F.when(F.col("error").isNull(), F.size("functions")).alias("n_functions"))


@query("js_locations", "select p_partkey, 4 first_line, 0 first_column from part")
def js_locations(spark, sf_dir):
    found = pages.extract(table(spark, sf_dir, "part").select("p_partkey", _source().alias("content")), ["p_partkey"])
    main = F.filter("functions", lambda f: f["name"] == "main")[0]
    return found.select("p_partkey", main["loc"]["start"]["line"].alias("first_line"), main["loc"]["start"]["column"].alias("first_column"))


@query("rn_modules", "select p_partkey, p_size::varchar id, 'n' id_type, 'run' as name, 'st:Return[ex:Binary[ex:Identifier[x] + lt:Numeric]]' tokens, '42.0' literals from part union all select p_partkey, 'm' || p_size, 's', 'run', 'ex:Call[ex:Identifier[x](lt:String)]', p_brand from part union all select p_partkey, (100 + p_partkey)::varchar, 'n', null, '', '17.0' from part")
def rn_modules(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), (100 + F.col("p_partkey")).cast("string")
    bundle = F.concat(
        F.lit("__d("), size, F.lit(", [3], function (a) { function run(x) { return x + 42; } });\n__d('m"), size, F.lit("', function (q) { var run = function (x) { x('"), F.col("p_brand"),
        F.lit("'); }; });\n__d(function (z) { z(17); }, "), key, F.lit(", []);\nfoo(1);\n__d(a, b);"),
    )
    found = pages.extract(table(spark, sf_dir, "part").select("p_partkey", bundle.alias("content")), ["p_partkey"], bundles=True)
    each = F.transform("literals", lambda v: F.coalesce(v["s"], v["n"].cast("string")))
    f = F.col("functions")
    return found.select("p_partkey", "id", "id_type", F.get(f, F.lit(0))["name"].alias("name"), F.array_join(F.flatten(F.transform(f, lambda x: x["tokens"])), "|").alias("tokens"), F.array_join(each, "|").alias("literals"))
