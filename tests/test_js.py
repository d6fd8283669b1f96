import pytest
from pyspark.sql import functions as F

from tessera.functions.js_parser import JsSyntaxError, parse
from tessera.functions.js_signature import function_tokens, locale_key, modules, signature
from tessera.sources import pages


def tokens(body, version=1):
    return function_tokens(parse("function own() {" + body + "}")[0]["body"][0], version)


@pytest.mark.parametrize(("body", "want"), [
    ("n; 's'; true; null; /x/i; `t`", ["ex:Identifier[n]", "lt:Boolean", "lt:Null", "lt:RegExp", "lt:String", "lt:Template"]),
    ("k++; --k", ["ex:Update[--ex:Identifier[k]]", "ex:Update[ex:Identifier[k]++]"]),
    ("p.q; p[q]", ["ex:Member[ex:Identifier[p] >>> ex:Identifier[q]]", "ex:Member[ex:Identifier[p] >c> ex:Identifier[q]]"]),
    ("p.q = 1", ["ex:Assignment[pr:Member[ex:Identifier[p] >>> ex:Identifier[q]] = lt:Numeric]"]),
    ("[, p, ...q]", ["ex:Array[, ex:Identifier[p], ...ex:Identifier[q]]"]),
    ("[]", ["ex:Array"]),
    ("({ p, [q]: 1, r() {}, set s(v) {} })", ["ex:Object[ex:Identifier[p], ex:Identifier[q] : lt:Numeric, zz:Method[ex:Identifier[r]], zz:Method[> ex:Identifier[s]]]"]),
    ("a && b || !c", ["ex:Logical[ex:Logical[ex:Identifier[a] && ex:Identifier[b]] || ex:Unary[! ex:Identifier[c]]]"]),
    ("a ** b ** c", ["ex:Binary[ex:Identifier[a] ** ex:Binary[ex:Identifier[b] ** ex:Identifier[c]]]"]),
    ("(function () {})(); (() => {})()", ["ex:Call[ex:ArrowFunction()]", "ex:Call[ex:Function[anonymous]()]"]),
    ("if (p) q; else if (r) {} else s", ["ex:Identifier[q]", "ex:Identifier[s]", "st:Else", "st:Else-If[ex:Identifier[r]]", "st:If[ex:Identifier[p]]"]),
    ("for (;;) break", ["st:Break", "st:For"]),
    ("for (var k in o) {}", ["de:Variable[pr:Identifier[k]]", "ex:Identifier[o]", "st:For-In"]),
    ("for (k of o) {}", ["ex:Identifier[o]", "pr:Identifier[k]", "st:For-Of"]),
    ("l: while (p) continue l", ["st:Continue[pr:Identifier[l]]", "st:Label[pr:Identifier[l]]", "st:While[ex:Identifier[p]]"]),
    ("switch (p) { case 1: q; default: }", ["ex:Identifier[q]", "st:Switch[s ex:Identifier[p]; c lt:Numeric, c default]"]),
    ("try { p } catch (e) { q }", ["ex:Identifier[p]", "ex:Identifier[q]", "st:Try-Catch[pr:Identifier[e]]"]),
    ("try { p } finally {}", ["ex:Identifier[p]", "st:Try-Finally"]),
    ("'use strict'; debugger", ["dr:use strict", "st:Debugger"]),
    ("var p, q = 1", ["de:Variable[pr:Identifier[p]]", "de:Variable[pr:Identifier[q] = lt:Numeric]"]),
    ("function p() { q }; {}", ["de:Function[ex:Identifier[p]]"]),
    ("throw new E", ["st:Throw[ex:New[ex:Identifier[E]()]]"]),
    ("return", ["st:Return"]),
    ("with (p) q", ["ex:Identifier[q]", "st:With[ex:Identifier[p]]"]),
    ("p\n/q/g", ["ex:Binary[ex:Binary[ex:Identifier[p] / ex:Identifier[q]] / ex:Identifier[g]]"]),
    ("class P {} p`x`", ["t_ex:TaggedTemplateExpression", "t_st:ClassDeclaration"]),
])
def test_tokens(body, want):
    assert tokens(body) == sorted(want)


def test_versions():
    assert tokens("var p; let q = 1", 2) == ["de:Variable[pr:Identifier[q] = lt:Numeric]"]
    assert tokens("var p; let q = 1", 3) == tokens("var p; let q = 1", 1) == ["de:Variable[pr:Identifier[p]]", "de:Variable[pr:Identifier[q] = lt:Numeric]"]
    assert signature("#!/usr/bin/env node\nx()")["comments"] == ["/usr/bin/env node"]
    fn = parse("function own(p, {q}) {}")[0]["body"][0]
    assert function_tokens(fn, 1) == ["pr:Identifier[p]", "t_pr:ObjectPattern"] and function_tokens(fn, 2) == []
    src = "var a = function b(x) { return function () { return 1 } }; var c = () => {}; function d() { e() }"
    found = {v: [(f["index"], f["name"]) for f in signature(src, v)["functions"]] for v in (1, 2, 3)}
    assert found[1] == found[2] == [(0, "b"), (1, "b:>>:[anonymous]"), (2, "c"), (3, "d")]
    assert found[3] == [(1, "b:>>:[anonymous]"), (3, "d")]
    with pytest.raises(ValueError, match="version"):
        signature("", 9)


def test_names():
    src = "a.b = function () {}; var o = { 'k': () => 1, m() { function inner() {} } }; x[y + 1] = function () {}; f(() => 1); function g(p = () => 2) {} z[q.r] = function () {}; h = class { n() {} }"
    assert [f["name"] for f in signature(src, 1)["functions"]] == ["[anonymous]", "b", "g", "g:>>:p", "inner", "k", "y + 1"]
    names = ["b", "B", "_x", "[anonymous]", "aa", "a", "a:>>:b", "1", "$"]
    assert sorted(names, key=locale_key) == ["_x", "[anonymous]", "$", "1", "a", "a:>>:b", "aa", "b", "B"]


def test_literals_comments_and_places():
    s = signature("// one\nf('', 'x', 7, 3, -1, 0x10, /r/g, `a${1 + 9}b`, '1', true, '\\u0041\\n')/* two */\n  function g() {\n    h()\n  }", 1)
    assert s["literals"] == ["/r/g", "1", 16.0, 7.0, "A\n", "a...b", "x"] and s["comments"] == [" one", " two "]
    assert s["functions"][0]["loc"] == {"start": {"line": 3, "column": 2}, "end": {"line": 5, "column": 3}}
    assert s["functions"][0]["types"] == ["t_st:ExpressionStatement"]


def test_modules():
    src = "__d('a', [], function () { function p() { q() } }); __d(5, function () { return 77 }); __d(function () { return 88 }, 6, []); __d(other); __d('x')"
    assert [(m["id"], m["id_type"], [f["name"] for f in m["functions"]], m["literals"]) for m in modules(src)] == [("a", "s", ["p"], []), ("5", "n", [], [77.0]), ("6", "n", [], [88.0])]


@pytest.mark.parametrize("src", ["function () {}", "try {}", "var 1 = 2", "({ [a] })", "a b", "'open", "/* open", "`open", "return 1", "if (", "a => {", "1 = 2", "{", "try { } catch { }", "(" * 5000 + "1" + ")" * 5000])
def test_errors(src):
    with pytest.raises(JsSyntaxError):
        signature(src)


def test_scripts_of_pages(spark):
    html = "<html><head><title>t</title><script>a()</script></head><body><p><script src='x.js'></script><script>function f() { g('lit') }</script><script>{</script></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    tags = pages.script_tags(df)
    assert [(r.page_id, r.idx, r.location, r.src, r.content) for r in tags.orderBy("idx").collect()] == [(1, 0, "head", None, "a()"), (1, 1, "body", "x.js", None), (1, 2, "body", None, "function f() { g('lit') }"), (1, 3, "body", None, "{")]
    out = {r.idx: r for r in pages.extract(tags.filter("content is not null"), ["page_id", "idx"]).collect()}
    assert out[2].functions[0].name == "f" and out[2].literals[0].s == "lit" and out[3].error and out[3].functions is None
    bundle = spark.createDataFrame([(1, "__d(1, function () { f(9) })")], "id0 int, content string")
    assert pages.extract(bundle, ["id0"], bundles=True).select(F.col("id"), F.col("literals")[0]["n"]).first() == ("1", 9.0)


def test_scripts_are_dealt_over_the_cores(spark):
    """One partition of scripts, many of them equal: each row gets what its own script holds, from more than one task."""
    codes = ["var a = 'one';", "function f(x) { return x * 7; }", "broken(", None, "__d(5, function (a) { a('m'); });__d('k', [], function () { return 9; });"]
    rows = [(k, codes[k % 5]) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, content string").coalesce(1)
    for bundles in (False, True):
        found = pages.extract(df, ["k"], bundles=bundles)
        assert found.rdd.getNumPartitions() > 1
        got = sorted((r.k, str(r.id), str(r.error), str([x.name for x in r.functions or []]), str([x.s or x.n for x in r.literals or []])) for r in found.collect())
        want = []
        for k, code in rows:
            try:
                each = modules(code or "") if bundles else [signature(code or "")]
                want += [(k, str(m.get("id")), "None", str([x["name"] for x in m["functions"]]), str(m["literals"])) for m in each]
            except JsSyntaxError as e:
                want.append((k, "None", str(e), "[]", "[]"))
        assert got == sorted(want)
