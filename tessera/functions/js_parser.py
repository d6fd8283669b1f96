"""A recursive-descent parser of JavaScript (scripts, up to ES2017 with object rest and spread) into plain dict nodes.

Nodes have ``type``, ``start`` and ``end`` offsets and fields by name. Anything out of place raises JsSyntaxError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

Node = dict


class JsSyntaxError(ValueError):
    """The source isn't a script that the parser knows."""


_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n\r\u2028\u2029]*|<!--[^\n\r]*)")
_NAME = re.compile(r"(?:[^\W\d]|[$]|\\u[0-9A-Fa-f]{4})(?:\w|[$\u200c\u200d]|\\u[0-9A-Fa-f]{4})*")
_NUMBER = re.compile(r"0[xX][0-9A-Fa-f]+|0[bB][01]+|0[oO][0-7]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_PUNCTUATION = re.compile(r">>>=|\.\.\.|===|!==|>>>|<<=|>>=|\*\*=|=>|==|!=|<=|>=|&&|\|\||\+\+|--|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_REGEX = re.compile(r"/((?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+)/([A-Za-z]*)")
_QUOTED = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"")
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|([0-7]{1,3})|(\r\n|[\n\r\u2028\u2029])|([\s\S]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}

BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "**="}
RESERVED = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        brace, four, two, octal, line, other = m.groups()
        if code := brace or four or two:
            return chr(int(code, 16))
        return chr(int(octal, 8)) if octal else "" if line else _SIMPLE.get(other, other)

    out = _ESCAPE.sub(one, text) if "\\" in text else text
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in out) else out


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, punctuation, end
    value: str
    start: int
    end: int
    newline: bool  # a line break stands before it


class Parser:
    def __init__(self, src: str):
        self.src, self.comments = src, []
        self.in_allowed, self.in_function, self.generator, self.is_async = True, False, False, False
        self.last = 0
        self.tok = self.scan(0)

    # Tokens

    def scan(self, at: int) -> Token:
        src, newline = self.src, False
        if at == 0 and src.startswith("#!"):  # a first line for the shell is a comment
            at = min((i for c in "\n\r\u2028\u2029" if (i := src.find(c)) >= 0), default=len(src))
            self.note(0, src[2:at])
        while True:
            if m := _SPACE.match(src, at):
                if m[0].startswith(("//", "<!--")):
                    self.note(at, m[0][2:] if m[0][0] == "/" else m[0][4:])
                newline = newline or any(c in m[0] for c in "\n\r\u2028\u2029")
                at = m.end()
            elif src.startswith("/*", at):
                end = src.find("*/", at + 2)
                if end < 0:
                    raise JsSyntaxError(f"comment at {at} isn't closed")
                self.note(at, src[at + 2 : end])
                newline = newline or "\n" in src[at:end]
                at = end + 2
            else:
                break
        if at >= len(src):
            return Token("end", "", at, at, newline)
        c = src[at]
        if c in "'\"":
            if not (m := _QUOTED.match(src, at)):
                raise JsSyntaxError(f"string at {at} isn't closed")
            return Token("string", m[0], at, m.end(), newline)
        if c == "`":
            return Token("punctuation", "`", at, at + 1, newline)
        if (c.isdigit() or c == "." and at + 1 < len(src) and src[at + 1].isdigit()) and (m := _NUMBER.match(src, at)):
            return Token("number", m[0], at, m.end(), newline)
        if m := _NAME.match(src, at):
            return Token("name", unescaped(m[0]), at, m.end(), newline)
        if m := _PUNCTUATION.match(src, at):
            return Token("punctuation", m[0], at, m.end(), newline)
        raise JsSyntaxError(f"unexpected {c!r} at {at}")

    def note(self, at: int, text: str) -> None:
        if not self.comments or self.comments[-1][0] < at:
            self.comments.append((at, text))

    def next(self) -> Token:
        t, self.last = self.tok, self.tok.end
        self.tok = self.scan(t.end)
        return t

    def at(self, value: str) -> bool:
        return self.tok.value == value and self.tok.kind in ("punctuation", "name")

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.next()
            return True
        return False

    def expect(self, value: str) -> Token:
        if not self.at(value):
            raise JsSyntaxError(f"expected {value!r}, got {self.tok.value!r} at {self.tok.start}")
        return self.next()

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.at("}") or self.tok.kind == "end" or self.tok.newline):
            raise JsSyntaxError(f"unexpected {self.tok.value!r} at {self.tok.start}")

    def node(self, kind: str, start: int, /, **fields) -> Node:
        return {"type": kind, "start": start, "end": self.last, **fields}

    def peek(self) -> Token:
        return self.scan(self.tok.end)

    # Statements

    def program(self) -> Node:
        body, directives = self.body_until(None)
        return self.node("Program", 0, directives=directives, body=body)

    def body_until(self, end: str | None) -> tuple[list[Node], list[Node]]:
        body, directives, first = [], [], True
        while self.tok.kind != "end" if end is None else not self.at(end):
            if first and self.tok.kind == "string":
                raw = self.tok
                s = self.statement()
                if s["type"] == "ExpressionStatement" and s["expression"]["type"] == "StringLiteral" and s["expression"]["end"] == raw.end:
                    directives.append({"type": "Directive", "start": s["start"], "end": s["end"], "value": raw.value[1:-1]})
                    continue
                body.append(s)
            else:
                body.append(self.statement())
            first = False
        return body, directives

    def block(self, function: bool = False) -> Node:
        start = self.expect("{").start
        body, directives = self.body_until("}") if function else (self.plain_body(), [])
        self.expect("}")
        return self.node("BlockStatement", start, directives=directives, body=body)

    def plain_body(self) -> list[Node]:
        out = []
        while not self.at("}"):
            if self.tok.kind == "end":
                raise JsSyntaxError("a block isn't closed")
            out.append(self.statement())
        return out

    def paren(self) -> Node:
        self.expect("(")
        e = self.expression()
        self.expect(")")
        return e

    def statement(self) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind == "end":
            raise JsSyntaxError("a statement is missing")
        if t.kind == "punctuation":
            if t.value == "{":
                return self.block()
            if t.value == ";":
                self.next()
                return self.node("EmptyStatement", start)
        elif t.kind == "name":
            handler = getattr(self, f"st_{t.value}", None) if t.value in RESERVED else None
            if handler:
                return handler(start)
            after = self.peek()
            if t.value == "let" and (after.kind == "name" and after.value not in ("in", "instanceof") or after.value in ("[", "{")):
                return self.st_var(start)
            if t.value == "async" and after.value == "function" and not after.newline:
                self.next()
                return self.function(start, True, is_async=True)
            if t.value not in RESERVED and after.value == ":" and after.kind == "punctuation":
                label = self.identifier()
                self.expect(":")
                body = self.statement()
                return self.node("LabeledStatement", start, label=label, body=body)
        e = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, expression=e)

    def st_var(self, start: int) -> Node:
        n = self.variables(start)
        self.semicolon()
        return {**n, "end": self.last}

    st_const = st_var

    def variables(self, start: int, loop: bool = False) -> Node:
        kind, found = self.next().value, []
        while True:
            at = self.tok.start
            target = self.pattern()
            init = self.assignment() if self.eat("=") else None
            found.append(self.node("VariableDeclarator", at, id=target, init=init))
            if not self.eat(","):
                return self.node("VariableDeclaration", start, kind=kind, declarations=found)

    def st_function(self, start: int) -> Node:
        return self.function(start, True)

    def st_class(self, start: int) -> Node:
        return self.class_(start, "ClassDeclaration")

    def st_if(self, start: int) -> Node:
        self.next()
        test = self.paren()
        then = self.statement()
        other = self.statement() if self.eat("else") else None
        return self.node("IfStatement", start, test=test, consequent=then, alternate=other)

    def st_for(self, start: int) -> Node:
        self.next()
        if self.at("await"):
            self.next()
        self.expect("(")
        init = None
        at = self.tok.start
        allowed, self.in_allowed = self.in_allowed, False
        if self.at("var") or self.at("const") or self.at("let") and self.peek().kind == "name" or self.at("let") and self.peek().value in "[{":
            init = self.variables(at, True)
        elif not self.at(";"):
            init = self.expression()
        self.in_allowed = True
        if init and (self.at("in") or self.at("of")):
            kind = "ForInStatement" if self.next().value == "in" else "ForOfStatement"
            right = self.expression() if kind == "ForInStatement" else self.assignment()
            self.expect(")")
            self.in_allowed = allowed
            left = init if init["type"] == "VariableDeclaration" else self.as_pattern(init)
            body = self.statement()
            return self.node(kind, start, left=left, right=right, body=body)
        self.expect(";")
        test = None if self.at(";") else self.expression()
        self.expect(";")
        update = None if self.at(")") else self.expression()
        self.expect(")")
        self.in_allowed = allowed
        body = self.statement()
        return self.node("ForStatement", start, init=init, test=test, update=update, body=body)

    def st_while(self, start: int) -> Node:
        self.next()
        test = self.paren()
        body = self.statement()
        return self.node("WhileStatement", start, test=test, body=body)

    def st_do(self, start: int) -> Node:
        self.next()
        body = self.statement()
        self.expect("while")
        test = self.paren()
        self.eat(";")
        return self.node("DoWhileStatement", start, body=body, test=test)

    def st_with(self, start: int) -> Node:
        self.next()
        obj = self.paren()
        body = self.statement()
        return self.node("WithStatement", start, object=obj, body=body)

    def jump(self, start: int, kind: str) -> Node:
        self.next()
        label = self.identifier() if self.tok.kind == "name" and not self.tok.newline and self.tok.value not in RESERVED else None
        self.semicolon()
        return self.node(kind, start, label=label)

    def st_break(self, start: int) -> Node:
        return self.jump(start, "BreakStatement")

    def st_continue(self, start: int) -> Node:
        return self.jump(start, "ContinueStatement")

    def st_return(self, start: int) -> Node:
        if not self.in_function:
            raise JsSyntaxError(f"return outside a function at {start}")
        self.next()
        value = None if self.tok.newline or self.at(";") or self.at("}") or self.tok.kind == "end" else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", start, argument=value)

    def st_throw(self, start: int) -> Node:
        self.next()
        if self.tok.newline:
            raise JsSyntaxError(f"line break after throw at {start}")
        value = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", start, argument=value)

    def st_debugger(self, start: int) -> Node:
        self.next()
        self.semicolon()
        return self.node("DebuggerStatement", start)

    def st_try(self, start: int) -> Node:
        self.next()
        block, handler, final = self.block(), None, None
        if self.at("catch"):
            at = self.next().start
            self.expect("(")
            param = self.pattern()
            self.expect(")")
            body = self.block()
            handler = self.node("CatchClause", at, param=param, body=body)
        if self.eat("finally"):
            final = self.block()
        if not handler and not final:
            raise JsSyntaxError(f"try without catch or finally at {start}")
        return self.node("TryStatement", start, block=block, handler=handler, finalizer=final)

    def st_switch(self, start: int) -> Node:
        self.next()
        on, cases = self.paren(), []
        self.expect("{")
        while not self.eat("}"):
            at = self.tok.start
            if self.eat("default"):
                test = None
            else:
                self.expect("case")
                test = self.expression()
            self.expect(":")
            body = []
            while not (self.at("case") or self.at("default") or self.at("}")):
                body.append(self.statement())
            cases.append(self.node("SwitchCase", at, test=test, consequent=body))
        return self.node("SwitchStatement", start, discriminant=on, cases=cases)

    # Functions and classes

    def function(self, start: int, declared: bool, is_async: bool = False) -> Node:
        self.expect("function")
        star = self.eat("*")
        name = self.identifier() if self.tok.kind == "name" and not self.at("(") else None
        if declared and not name:
            raise JsSyntaxError(f"a function declaration needs a name at {start}")
        params, body = self.signature(star, is_async)
        return self.node("FunctionDeclaration" if declared else "FunctionExpression", start, id=name, generator=star, params=params, body=body, **{"async": is_async})

    def signature(self, star: bool = False, is_async: bool = False) -> tuple[list[Node], Node]:
        saved = self.in_function, self.generator, self.is_async, self.in_allowed
        self.in_function, self.generator, self.is_async, self.in_allowed = True, star, is_async, True
        self.expect("(")
        params = []
        while not self.eat(")"):
            params.append(self.rest() if self.at("...") else self.pattern_default())
            if not self.at(")"):
                self.expect(",")
        body = self.block(True)
        self.in_function, self.generator, self.is_async, self.in_allowed = saved
        return params, body

    def class_(self, start: int, kind: str) -> Node:
        self.expect("class")
        name = self.identifier() if self.tok.kind == "name" and not self.at("extends") and not self.at("{") else None
        parent = self.subscripts(self.primary(), True) if self.eat("extends") else None
        at, body = self.expect("{").start, []
        while not self.eat("}"):
            if self.eat(";"):
                continue
            begun = self.tok.start
            static = self.at("static") and self.peek().value != "(" and bool(self.next())
            body.append(self.method(begun, "ClassMethod") | {"static": static})
        return self.node(kind, start, id=name, superClass=parent, body=self.node("ClassBody", at, body=body))

    def method(self, start: int, kind: str) -> Node:
        """A method, getter or setter of a class or object."""
        how, is_async, star = "method", False, False
        after = self.peek()
        if self.tok.kind == "name" and self.tok.value in ("get", "set", "async") and after.value not in ("(", ",", ":", "}", "=") or self.at("*"):
            word = self.next().value if not self.at("*") else ""
            how = word if word in ("get", "set") else how
            is_async = word == "async"
            star = self.eat("*")
        key, computed = self.key()
        params, body = self.signature(star, is_async)
        return self.node(kind, start, key=key, computed=computed, kind=how, params=params, body=body, generator=star, **{"async": is_async})

    def key(self) -> tuple[Node, bool]:
        if self.eat("["):
            e = self.assignment()
            self.expect("]")
            return e, True
        t = self.tok
        if t.kind in ("string", "number"):
            return self.literal(), False
        if t.kind != "name":
            raise JsSyntaxError(f"unexpected {t.value!r} at {t.start}")
        self.next()
        return self.node("Identifier", t.start, name=t.value), False

    # Patterns

    def identifier(self) -> Node:
        t = self.tok
        if t.kind != "name" or t.value in RESERVED:
            raise JsSyntaxError(f"expected a name, got {t.value!r} at {t.start}")
        self.next()
        return self.node("Identifier", t.start, name=t.value)

    def rest(self) -> Node:
        start = self.expect("...").start
        target = self.pattern()
        return self.node("RestElement", start, argument=target)

    def pattern_default(self) -> Node:
        start, target = self.tok.start, self.pattern()
        if self.eat("="):
            value = self.assignment()
            return self.node("AssignmentPattern", start, left=target, right=value)
        return target

    def pattern(self) -> Node:
        if self.at("[") or self.at("{"):
            allowed, self.in_allowed = self.in_allowed, True
            found = self.as_pattern(self.primary())
            self.in_allowed = allowed
            return found
        return self.identifier()

    def as_pattern(self, e: Node) -> Node:
        """An expression that turns out to be a target."""
        kind = e["type"]
        if kind in ("Identifier", "MemberExpression", "ObjectPattern", "ArrayPattern", "AssignmentPattern", "RestElement"):
            return e
        if kind == "AssignmentExpression" and e["operator"] == "=":
            return {"type": "AssignmentPattern", "start": e["start"], "end": e["end"], "left": self.as_pattern(e["left"]), "right": e["right"]}
        if kind == "ArrayExpression":
            return e | {"type": "ArrayPattern", "elements": [x and self.as_pattern(x) for x in e["elements"]]}
        if kind == "SpreadElement":
            return e | {"type": "RestElement", "argument": self.as_pattern(e["argument"])}
        if kind == "ObjectExpression":
            return e | {"type": "ObjectPattern", "properties": [self.as_pattern(p) if p["type"] == "SpreadElement" else p | {"value": self.as_pattern(p["value"])} for p in e["properties"] if p["type"] != "ObjectMethod"]}
        raise JsSyntaxError(f"not a target at {e['start']}")

    # Expressions

    def expression(self) -> Node:
        start, e = self.tok.start, self.assignment()
        if not self.at(","):
            return e
        found = [e]
        while self.eat(","):
            found.append(self.assignment())
        return self.node("SequenceExpression", start, expressions=found)

    def arrow(self, start: int, params: list[Node], is_async: bool = False) -> Node:
        self.expect("=>")
        saved = self.in_function, self.generator, self.is_async
        self.in_function, self.generator, self.is_async = True, False, is_async
        body = self.block(True) if self.at("{") else self.assignment()
        self.in_function, self.generator, self.is_async = saved
        return self.node("ArrowFunctionExpression", start, id=None, params=[self.as_pattern(p) for p in params], body=body, expression=body["type"] != "BlockStatement", **{"async": is_async})

    def assignment(self) -> Node:
        t, start = self.tok, self.tok.start
        if self.generator and t.kind == "name" and t.value == "yield":
            self.next()
            star = self.eat("*")
            none = self.tok.newline or self.tok.kind == "end" or self.tok.value in (")", "]", "}", ",", ";", ":") and self.tok.kind == "punctuation"
            value = None if none and not star else self.assignment()
            return self.node("YieldExpression", start, argument=value, delegate=star)
        if t.kind == "name" and t.value not in RESERVED:
            after = self.peek()
            if after.value == "=>" and not after.newline:
                return self.arrow(start, [self.identifier()])
            if t.value == "async" and after.kind == "name" and not after.newline and after.value not in RESERVED:
                self.next()
                return self.arrow(start, [self.identifier()], True)
        left = self.conditional()
        if left["type"] == "_Params":
            return self.arrow(start, left["params"], left.get("async", False))
        if self.tok.kind == "punctuation" and self.tok.value in ASSIGN:
            op = self.next().value
            target = self.as_pattern(left) if op == "=" else left
            if target["type"] not in ("Identifier", "MemberExpression", "ObjectPattern", "ArrayPattern"):
                raise JsSyntaxError(f"not a target at {start}")
            right = self.assignment()
            return self.node("AssignmentExpression", start, operator=op, left=target, right=right)
        return left

    def conditional(self) -> Node:
        start, test = self.tok.start, self.binary(0)
        if not self.at("?"):
            return test
        self.next()
        allowed, self.in_allowed = self.in_allowed, True
        then = self.assignment()
        self.in_allowed = allowed
        self.expect(":")
        other = self.assignment()
        return self.node("ConditionalExpression", start, test=test, consequent=then, alternate=other)

    def binary(self, least: int) -> Node:
        start, left = self.tok.start, self.unary()
        while left["type"] != "_Params":
            op = self.tok.value if self.tok.kind == "punctuation" or self.tok.value in ("in", "instanceof") and self.tok.kind == "name" else ""
            power = BINARY.get(op, 0)
            if power <= least or op == "in" and not self.in_allowed:
                break
            self.next()
            right = self.binary(power - (op == "**"))
            left = self.node("LogicalExpression" if op in ("||", "&&") else "BinaryExpression", start, operator=op, left=left, right=right)
        return left

    def unary(self) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind == "punctuation" and t.value in ("!", "~", "+", "-") or t.kind == "name" and t.value in ("typeof", "void", "delete"):
            self.next()
            value = self.unary()
            return self.node("UnaryExpression", start, operator=t.value, prefix=True, argument=value)
        if t.kind == "punctuation" and t.value in ("++", "--"):
            self.next()
            value = self.unary()
            return self.node("UpdateExpression", start, operator=t.value, prefix=True, argument=value)
        if self.is_async and t.kind == "name" and t.value == "await":
            self.next()
            value = self.unary()
            return self.node("AwaitExpression", start, argument=value)
        e = self.subscripts(self.primary(), False)
        if self.tok.kind == "punctuation" and self.tok.value in ("++", "--") and not self.tok.newline:
            op = self.next().value
            return self.node("UpdateExpression", start, operator=op, prefix=False, argument=e)
        return e

    def subscripts(self, e: Node, no_call: bool) -> Node:
        start = e["start"]
        if e["type"] == "_Params" or e["type"] == "ArrowFunctionExpression" and not e.get("parenthesised"):
            return e
        while True:
            if self.eat("."):
                t = self.next()
                if t.kind != "name":
                    raise JsSyntaxError(f"expected a name at {t.start}")
                prop = self.node("Identifier", t.start, name=t.value)
                e = self.node("MemberExpression", start, object=e, property=prop, computed=False)
            elif self.at("["):
                self.next()
                allowed, self.in_allowed = self.in_allowed, True
                prop = self.expression()
                self.in_allowed = allowed
                self.expect("]")
                e = self.node("MemberExpression", start, object=e, property=prop, computed=True)
            elif self.at("(") and not no_call:
                maybe = e["type"] == "Identifier" and e["name"] == "async" and not self.tok.newline
                args = self.arguments()
                if maybe and self.at("=>"):
                    return {"type": "_Params", "start": start, "end": self.last, "params": args, "async": True}
                e = self.node("CallExpression", start, callee=e, arguments=args)
            elif self.at("`"):
                quasi = self.template()
                e = self.node("TaggedTemplateExpression", start, tag=e, quasi=quasi)
            else:
                return e

    def arguments(self) -> list[Node]:
        self.expect("(")
        allowed, self.in_allowed = self.in_allowed, True
        found = []
        while not self.at(")"):
            found.append(self.spread() if self.at("...") else self.assignment())
            if not self.at(")"):
                self.expect(",")
        self.next()
        self.in_allowed = allowed
        return found

    def spread(self) -> Node:
        start = self.expect("...").start
        value = self.assignment()
        return self.node("SpreadElement", start, argument=value)

    def literal(self) -> Node:
        t = self.next()
        if t.kind == "string":
            return self.node("StringLiteral", t.start, value=unescaped(t.value[1:-1]))
        raw = t.value.lower()
        if raw[:2] in ("0x", "0b", "0o"):
            value = float(int(raw, 0))
        elif re.fullmatch(r"0[0-7]+", raw):
            value = float(int(raw, 8))
        else:
            value = float(raw)
        return self.node("NumericLiteral", t.start, value=value)

    def primary(self) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind in ("string", "number"):
            return self.literal()
        if t.kind == "name":
            return self.word(t, start)
        if t.value == "(":
            return self.group(start)
        if t.value == "[":
            return self.array(start)
        if t.value == "{":
            return self.object(start)
        if t.value == "`":
            return self.template()
        if t.value in ("/", "/="):
            m = _REGEX.match(self.src, start)
            if not m:
                raise JsSyntaxError(f"a pattern isn't closed at {start}")
            self.last = m.end()
            self.tok = self.scan(m.end())
            return self.node("RegExpLiteral", start, pattern=m[1], flags=m[2])
        raise JsSyntaxError(f"unexpected {t.value!r} at {start}")

    def word(self, t: Token, start: int) -> Node:
        if t.value == "function":
            return self.function(start, False)
        if t.value == "class":
            return self.class_(start, "ClassExpression")
        if t.value == "async":
            after = self.peek()
            if after.value == "function" and not after.newline:
                self.next()
                return self.function(start, False, is_async=True)
        if t.value == "new":
            self.next()
            if self.eat("."):
                prop = self.identifier()
                return self.node("MetaProperty", start, property=prop)
            callee = self.subscripts(self.primary(), True)
            args = self.arguments() if self.at("(") else []
            return self.node("NewExpression", start, callee=callee, arguments=args)
        simple = {"this": ("ThisExpression", {}), "null": ("NullLiteral", {}), "true": ("BooleanLiteral", {"value": True}), "false": ("BooleanLiteral", {"value": False}), "super": ("Super", {})}
        if t.value in simple:
            self.next()
            kind, fields = simple[t.value]
            return self.node(kind, start, **fields)
        return self.identifier()

    def group(self, start: int) -> Node:
        self.next()
        allowed, self.in_allowed = self.in_allowed, True
        found, arrow = [], self.at(")")
        while not self.at(")"):
            if self.at("..."):
                found.append(self.rest())
                arrow = True
            else:
                found.append(self.assignment())
            if not self.at(")"):
                self.expect(",")
                arrow = arrow or self.at(")")
        self.next()
        self.in_allowed = allowed
        if self.at("=>") and not self.tok.newline:
            return {"type": "_Params", "start": start, "end": self.last, "params": found}
        if arrow or not found:
            raise JsSyntaxError(f"unexpected ')' at {self.last}")
        if len(found) == 1:
            return found[0] | {"parenthesised": True}
        return {"type": "SequenceExpression", "start": found[0]["start"], "end": found[-1]["end"], "expressions": found}

    def array(self, start: int) -> Node:
        self.next()
        allowed, self.in_allowed = self.in_allowed, True
        found: list[Node | None] = []
        while not self.at("]"):
            if self.at(","):
                found.append(None)
                self.next()
                continue
            found.append(self.spread() if self.at("...") else self.assignment())
            if not self.at("]"):
                self.expect(",")
        self.next()
        self.in_allowed = allowed
        return self.node("ArrayExpression", start, elements=found)

    def object(self, start: int) -> Node:
        self.next()
        allowed, self.in_allowed = self.in_allowed, True
        found = []
        while not self.at("}"):
            found.append(self.property())
            if not self.at("}"):
                self.expect(",")
        self.next()
        self.in_allowed = allowed
        return self.node("ObjectExpression", start, properties=found)

    def property(self) -> Node:
        t, start = self.tok, self.tok.start
        if self.at("..."):
            return self.spread()
        after = self.peek()
        if self.at("*") or t.kind == "name" and t.value in ("get", "set", "async") and after.value not in ("(", ",", ":", "}", "="):
            return self.method(start, "ObjectMethod")
        if after.value == "(" and t.kind != "punctuation":
            return self.method(start, "ObjectMethod")
        key, computed = self.key()
        if self.at("("):
            params, body = self.signature()
            return self.node("ObjectMethod", start, key=key, computed=computed, kind="method", params=params, body=body)
        if self.eat(":"):
            value = self.assignment()
            return self.node("ObjectProperty", start, key=key, computed=computed, shorthand=False, value=value)
        if key["type"] != "Identifier" or computed or key["name"] in RESERVED:
            raise JsSyntaxError(f"unexpected {self.tok.value!r} at {self.tok.start}")
        value = key
        if self.eat("="):  # only a pattern may have a default here
            right = self.assignment()
            value = self.node("AssignmentPattern", start, left=key, right=right)
        return self.node("ObjectProperty", start, key=key, computed=False, shorthand=True, value=value)

    def template(self) -> Node:
        start = at = self.tok.start
        at += 1
        quasis, values, src, begun = [], [], self.src, at
        while True:
            if at >= len(src):
                raise JsSyntaxError(f"a template isn't closed at {start}")
            if src[at] == "\\":
                at += 2
            elif src[at] == "`":
                quasis.append(src[begun:at])
                self.last = at + 1
                self.tok = self.scan(at + 1)
                return self.node("TemplateLiteral", start, quasis=quasis, expressions=values)
            elif src.startswith("${", at):
                quasis.append(src[begun:at])
                self.tok = self.scan(at + 2)
                values.append(self.expression())
                if not self.at("}"):
                    raise JsSyntaxError(f"a template isn't closed at {start}")
                at = begun = self.tok.end
            else:
                at += 1


def parse(src: str) -> tuple[Node, list[str]]:
    """(program, comments) of a script."""
    p = Parser(src)
    tree = p.program()
    return tree, [text for _, text in p.comments]
