"""Signatures of JavaScript sources: functions with bags of statement tokens and types, literals and comments."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from tessera.functions.js_parser import JsSyntaxError, Node, parse
from tessera.functions.text import ANONYMOUS, NAME_SEPARATOR

#: The tags of tokens, the numbers that don't count as literals, and the extractor's versions. Version 1
#: keeps everything, 2 leaves out parameters and declarations without a value, 3 leaves out parameters, functions without
#: tokens and those that only return an anonymous function.
PARAM, DIRECTIVE, LITERAL, STATEMENT, DECLARATION, EXPRESSION, UNKNOWN = "pr", "dr", "lt", "st", "de", "ex", "zz"
PLAIN_NUMBERS = {-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0}
VERSIONS, DEFAULT_VERSION = (1, 2, 3), 3
ONLY_RETURNS = "st:Return[ex:Function[anonymous]]"

#: Punctuation in the order in which locale comparison sorts it; digits and letters follow.
_ORDER = {c: i for i, c in enumerate("_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$")}


def locale_key(name: str) -> tuple:
    """Sort key like a locale comparison: punctuation, digits, letters; case only breaks ties, lower case first."""
    first = [(0, _ORDER[c], "") if c in _ORDER else (1, 0, c) if c.isdigit() else (2, 0, c.lower()) for c in name]
    return first, [c.isupper() for c in name], name


def _children(node: Node) -> Iterator[Node]:
    for key, value in node.items():
        if key == "parenthesised":
            continue
        if isinstance(value, dict):
            yield value
        elif isinstance(value, list):
            for x in value:
                if isinstance(x, dict):
                    yield x


# Tokens

_LITERALS = {"StringLiteral": "String", "NumericLiteral": "Numeric", "BooleanLiteral": "Boolean", "NullLiteral": "Null", "RegExpLiteral": "RegExp", "TemplateLiteral": "Template"}


def token(tag: str, title: str, inner: str = "") -> str:
    return f"{tag}:{title}[{inner}]" if inner else f"{tag}:{title}"


def other(tag: str, node: Node) -> str:
    """The token of a kind of node that has no rule of its own."""
    return f"t_{tag}:{node['type']}"


def target_token(node: Node) -> str:
    if node["type"] == "Identifier":
        return token(PARAM, "Identifier", node["name"])
    if node["type"] == "MemberExpression":
        return token(PARAM, "Member", _member(node))
    return other(PARAM, node)


def _member(node: Node) -> str:
    return f"{expression_token(node['object'])} {'>c>' if node['computed'] else '>>>'} {expression_token(node['property'])}"


def _each(nodes: list[Node | None]) -> str:
    return ", ".join("" if n is None else "..." + expression_token(n["argument"]) if n["type"] == "SpreadElement" else expression_token(n) for n in nodes)


def _name_of_function(node: Node) -> str:
    return token(EXPRESSION, "Identifier", node["id"]["name"]) if node["id"] else "anonymous"


def _property(p: Node) -> str:
    if p["type"] == "SpreadElement":
        return "..." + expression_token(p["argument"])
    if p["type"] == "ObjectMethod":
        return token(UNKNOWN, "Method", {"get": "< ", "set": "> "}.get(p["kind"], "") + expression_token(p["key"]))
    if p["shorthand"]:
        return expression_token(p["key"])
    return f"{expression_token(p['key'])} : {expression_token(p['value'])}"


_INFIX = {"AssignmentExpression": "Assignment", "BinaryExpression": "Binary", "LogicalExpression": "Logical"}


def expression_token(node: Node) -> str:
    kind = node["type"]
    if kind in _LITERALS:
        return token(LITERAL, _LITERALS[kind])
    if kind in _INFIX:
        left = target_token(node["left"]) if kind == "AssignmentExpression" else expression_token(node["left"])
        return token(EXPRESSION, _INFIX[kind], f"{left} {node['operator']} {expression_token(node['right'])}")
    match kind:
        case "Identifier":
            return token(EXPRESSION, "Identifier", node["name"])
        case "MemberExpression":
            return token(EXPRESSION, "Member", _member(node))
        case "CallExpression":
            return token(EXPRESSION, "Call", "super" if node["callee"]["type"] == "Super" else f"{expression_token(node['callee'])}({_each(node['arguments'])})")
        case "NewExpression":
            return token(EXPRESSION, "New", f"{expression_token(node['callee'])}({_each(node['arguments'])})")
        case "ArrayExpression":
            found = _each(node["elements"])
            return token(EXPRESSION, "Array", found)
        case "ObjectExpression":
            return token(EXPRESSION, "Object", ", ".join(map(_property, node["properties"])))
        case "FunctionExpression":
            return token(EXPRESSION, "Function", _name_of_function(node))
        case "ArrowFunctionExpression":
            return token(EXPRESSION, "ArrowFunction")
        case "ConditionalExpression":
            return token(EXPRESSION, "Conditional", f"{expression_token(node['test'])} ? {expression_token(node['consequent'])} : {expression_token(node['alternate'])}")
        case "SequenceExpression":
            return token(EXPRESSION, "Sequence", _each(node["expressions"]))
        case "ThisExpression":
            return token(EXPRESSION, "This")
        case "UnaryExpression":
            return token(EXPRESSION, "Unary", f"{node['operator']} {expression_token(node['argument'])}")
        case "UpdateExpression":
            value = expression_token(node["argument"])
            return token(EXPRESSION, "Update", node["operator"] + value if node["prefix"] else value + node["operator"])
    return other(EXPRESSION, node)


class Statements:
    """Tokens of statements, in the order of the source."""

    def __init__(self, version: int):
        self.version = version

    def all(self, nodes: list[Node]) -> list[str]:
        return [t for n in nodes for t in self.of(n)]

    def variables(self, node: Node) -> list[str]:
        out = []
        for d in node["declarations"]:
            if d["init"] is not None:
                out.append(token(DECLARATION, "Variable", f"{target_token(d['id'])} = {expression_token(d['init'])}"))
            elif self.version != 2:
                out.append(token(DECLARATION, "Variable", target_token(d["id"])))
        return out

    def part(self, node: Node | None) -> list[str]:
        """A part of a loop's head: a declaration or an expression, or nothing."""
        if node is None:
            return []
        return self.variables(node) if node["type"] == "VariableDeclaration" else [expression_token(node)]

    def of(self, node: Node) -> list[str]:
        rule = getattr(self, node["type"], None)
        return rule(node) if rule else [other(STATEMENT, node)]

    def BlockStatement(self, n):
        return [token(DIRECTIVE, d["value"]) for d in n["directives"]] + self.all(n["body"])

    def EmptyStatement(self, n):
        return []

    def ExpressionStatement(self, n):
        return [expression_token(n["expression"])]

    def VariableDeclaration(self, n):
        return self.variables(n)

    def FunctionDeclaration(self, n):
        return [token(DECLARATION, "Function", _name_of_function(n))]

    def _jump(self, title, n):
        return [token(STATEMENT, title, target_token(n["label"]) if n["label"] else "")]

    def BreakStatement(self, n):
        return self._jump("Break", n)

    def ContinueStatement(self, n):
        return self._jump("Continue", n)

    def LabeledStatement(self, n):
        return self._jump("Label", n) + self.of(n["body"])

    def DebuggerStatement(self, n):
        return [token(STATEMENT, "Debugger")]

    def _headed(self, title, head, n):
        return [token(STATEMENT, title, expression_token(head)), *self.of(n["body"])]

    def WhileStatement(self, n):
        return self._headed("While", n["test"], n)

    def DoWhileStatement(self, n):
        return self._headed("Do-While", n["test"], n)

    def WithStatement(self, n):
        return self._headed("With", n["object"], n)

    def ForStatement(self, n):
        return [token(STATEMENT, "For"), *self.part(n["init"]), *self.part(n["test"]), *self.part(n["update"]), *self.of(n["body"])]

    def _each_of(self, title, n):
        left = self.variables(n["left"]) if n["left"]["type"] == "VariableDeclaration" else [target_token(n["left"])]
        return [token(STATEMENT, title), *left, expression_token(n["right"]), *self.of(n["body"])]

    def ForInStatement(self, n):
        return self._each_of("For-In", n)

    def ForOfStatement(self, n):
        return self._each_of("For-Of", n)

    def IfStatement(self, n, title="If"):
        out = [token(STATEMENT, title, expression_token(n["test"])), *self.of(n["consequent"])]
        if n["alternate"] is None:
            return out
        if n["alternate"]["type"] == "IfStatement":
            return out + self.IfStatement(n["alternate"], "Else-If")
        return [*out, token(STATEMENT, "Else"), *self.of(n["alternate"])]

    def ReturnStatement(self, n):
        return [token(STATEMENT, "Return", expression_token(n["argument"]) if n["argument"] else "")]

    def ThrowStatement(self, n):
        return [token(STATEMENT, "Throw", expression_token(n["argument"]))]

    def SwitchStatement(self, n):
        cases = ", ".join("c " + ("default" if c["test"] is None else expression_token(c["test"])) for c in n["cases"])
        head = f"s {expression_token(n['discriminant'])}; {cases}"
        return [token(STATEMENT, "Switch", head), *(t for c in n["cases"] for t in self.all(c["consequent"]))]

    def TryStatement(self, n):
        title = "Try" + "-Catch" * bool(n["handler"]) + "-Finally" * bool(n["finalizer"])
        out = [token(STATEMENT, title, target_token(n["handler"]["param"]) if n["handler"] else ""), *self.of(n["block"])]
        if n["handler"]:
            out += self.of(n["handler"]["body"])
        return out + self.of(n["finalizer"]) if n["finalizer"] else out


def function_tokens(fn: Node, version: int) -> list[str]:
    out = [target_token(p) for p in fn["params"]] if version == 1 else []
    body = fn["body"]
    out += Statements(version).of(body) if body["type"] == "BlockStatement" else [expression_token(body)]
    return sorted(out)


def function_types(fn: Node) -> list[str]:
    body, out = fn["body"], [other(PARAM, p) for p in fn["params"]]
    if body["type"] != "BlockStatement":
        return sorted([*out, other(EXPRESSION, body)])
    out += [f"t_{DIRECTIVE}:{d['value']}" for d in body["directives"]]
    return sorted(out + [other(STATEMENT, s) for s in body["body"]])


# Functions and their names

_FUNCTIONS = ("FunctionExpression", "ArrowFunctionExpression")


def target_name(node: Node | None) -> str | None:
    """A name for what is assigned to a target or stands under a key; null where there is none."""
    if node is None:
        return None
    match node["type"]:
        case "Identifier":
            return node["name"]
        case "StringLiteral":
            return node["value"]
        case "NumericLiteral":
            return number_text(node["value"])
        case "MemberExpression":
            return target_name(node["property"]) if node["property"]["type"] not in ("MemberExpression", "CallExpression") else None
        case "BinaryExpression":
            left, right = target_name(node["left"]), target_name(node["right"])
            return None if left is None or right is None else f"{left} {node['operator']} {right}"
    return None


def number_text(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)


@dataclass
class Found:
    name: str
    node: Node
    inner: list[Found]


def _bound(node: Node) -> Iterator[tuple[str | None, Node]]:
    """(name, value) of the places where a function takes a name from what surrounds it."""
    match node["type"]:
        case "VariableDeclarator":
            yield target_name(node["id"]), node["init"]
        case "AssignmentExpression" | "AssignmentPattern":
            yield target_name(node["left"]), node["right"]
        case "ObjectProperty":
            yield target_name(node["key"]), node["value"]
        case "ReturnStatement":
            yield None, node["argument"]


def find_functions(node: Node) -> list[Found]:
    """The outermost functions below a node, with those inside them. Arrow functions only count where a name could be
    taken from (or in a return); methods never do, but functions within them are found."""
    out: list[Found] = []
    stack: list[Node] = [node]
    named: dict[int, str | None] = {}
    while stack:
        n = stack.pop()
        for name, value in _bound(n):
            if value is not None and value["type"] in _FUNCTIONS:
                named[id(value)] = name
        kind = n["type"]
        if n is not node and (kind in ("FunctionDeclaration", "FunctionExpression") or kind == "ArrowFunctionExpression" and id(n) in named):
            own = n["id"]["name"] if n.get("id") else None
            inner = [f for part in (*n["params"], n["body"]) for f in _below(part)]
            out.append(Found(own or named.get(id(n)) or ANONYMOUS, n, inner))
            continue
        stack.extend(reversed(list(_children(n))))
    return out


def _below(node: Node) -> list[Found]:
    return find_functions({"type": "_Root", "body": [node]})


def flatten(found: list[Found], outer: str = "") -> Iterator[tuple[str, Node]]:
    for f in found:
        name = f"{outer}{NAME_SEPARATOR}{f.name}" if outer else f.name
        yield name, f.node
        yield from flatten(f.inner, name)


def _location(starts: list[int]) -> Callable[[int], dict[str, int]]:
    def at(pos: int) -> dict[str, int]:
        line = bisect_right(starts, pos)
        return {"line": line, "column": pos - starts[line - 1]}

    return at


def functions_of(root: Node, src: str, version: int = DEFAULT_VERSION) -> list[dict]:
    """Functions by name, numbered before version 3 leaves any out, so its numbers can have gaps."""
    at = _location([0, *(i + 1 for i, c in enumerate(src) if c == "\n")])
    out = []
    for index, (name, fn) in enumerate(sorted(flatten(find_functions(root)), key=lambda f: locale_key(f[0]))):
        tokens = function_tokens(fn, version)
        if version == 3 and (not tokens or tokens == [ONLY_RETURNS]):
            continue
        out.append({"index": index, "type": "fn", "name": name, "loc": {"start": at(fn["start"]), "end": at(fn["end"])}, "types": function_types(fn), "tokens": tokens})
    return out


def literals_of(root: Node) -> list[str | float]:
    """Strings, numbers, patterns and templates (their values as ...), sorted by their text."""
    out: list[str | float] = []
    stack = [root]
    while stack:
        n = stack.pop()
        kind = n["type"]
        if kind == "StringLiteral" and n["value"]:
            out.append(n["value"])
        elif kind == "NumericLiteral" and n["value"] not in PLAIN_NUMBERS:
            out.append(n["value"])
        elif kind == "RegExpLiteral":
            out.append(f"/{n['pattern']}/{n['flags']}")
        elif kind == "TemplateLiteral":
            if text := "...".join(n["quasis"]):
                out.append(text)
            continue
        stack.extend(_children(n))
    return sorted(out, key=lambda v: (v if isinstance(v, str) else number_text(v)).encode("utf-16-be", "surrogatepass"))


def tagged(values: list[str | float]) -> list[dict]:
    """Literals as stored: strings and numbers stay apart."""
    return [{"kind": "s", "s": v, "n": None} if isinstance(v, str) else {"kind": "n", "s": None, "n": v} for v in values]


def signature(src: str, version: int = DEFAULT_VERSION) -> dict:
    """{functions, literals, comments} of a script; JsSyntaxError where it can't be read."""
    if version not in VERSIONS:
        raise ValueError(f"no such extractor version: {version}")
    tree, comments = _read(src)
    return {"functions": functions_of(tree, src, version), "literals": literals_of(tree), "comments": comments}


def _read(src: str) -> tuple[Node, list[str]]:
    try:
        return parse(src)
    except RecursionError as e:
        raise JsSyntaxError("nested too deeply") from e


def modules(src: str, version: int = DEFAULT_VERSION) -> list[dict]:
    """Signatures of the modules of a bundle, by id; calls of another shape are left out.

    The three shapes: __d(id, [...], factory), __d(id, factory) and __d(factory, id, ...). An id is a string or a number.
    """
    tree, _ = _read(src)
    out, stack = [], [tree]
    while stack:
        n = stack.pop()
        if n["type"] == "CallExpression" and n["callee"].get("name") == "__d":
            args = n["arguments"]
            plain = [a["type"] in ("StringLiteral", "NumericLiteral") for a in args]
            fn = [a["type"] in _FUNCTIONS for a in args]
            if len(args) >= 2 and plain[0]:
                key, factory = args[0], next((a for a, f in zip(args[1:3], fn[1:3], strict=False) if f), None)
            elif len(args) >= 2 and fn[0] and plain[1]:
                key, factory = args[1], args[0]
            else:
                continue
            if factory is not None:
                value = key["value"]
                body = factory["body"]
                out.append({"id": value if isinstance(value, str) else number_text(value), "id_type": "s" if isinstance(value, str) else "n", "functions": functions_of({"type": "_Root", "body": [*factory["params"], body]}, src, version), "literals": literals_of(body), "comments": []})
                continue
        stack.extend(reversed(list(_children(n))))
    return out
