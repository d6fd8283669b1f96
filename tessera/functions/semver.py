"""Semantic versions: parsing, ordering and ranges. Ranges need a parser, hence an Arrow-batched UDF."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_ID = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
_FULL = re.compile(rf"^[v=\s]*(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-({_ID}(?:\.{_ID})*))?(?:\+[0-9A-Za-z.-]+)?$")
_PART = re.compile(r"^[v=\s]*([0-9]+|[xX*])?(?:\.([0-9]+|[xX*]))?(?:\.([0-9]+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")

Version = tuple[int, int, int, tuple]


def parse(text: str | None) -> Version | None:
    m = _FULL.match(text.strip()) if text else None
    return m and (int(m[1]), int(m[2]), int(m[3]), tuple(m[4].split(".")) if m[4] else ())


def order(v: Version) -> tuple:
    """Sort key: a prerelease comes before its release; numeric identifiers before others."""
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in v[3])
    return v[:3], 0 if pre else 1, pre


def _bounds(op: str, text: str) -> list[tuple[str, Version]] | None:
    """Comparators of one simple range; None if it doesn't parse."""
    m = _PART.match(text)
    if not m:
        return None
    parts = [None if x is None or x in "xX*" else int(x) for x in m.groups()[:3]]
    for i in range(3):
        if parts[i] is None:
            parts[i:] = [None] * (3 - i)
    a, b, c = parts
    pre = tuple(m[4].split(".")) if m[4] and c is not None else ()
    low = (a or 0, b or 0, c or 0, pre)
    floor = ("0",)
    if a is None:
        return [("<", (0, 0, 0, floor))] if op in ("<", ">") else []
    up = (a + 1, 0, 0, floor) if b is None else (a, b + 1, 0, floor)
    if op == "^":
        top = (a + 1, 0, 0) if a or b is None else (0, b + 1, 0) if b or c is None else (0, 0, c + 1)
        return [(">=", low), ("<", (*top, floor))]
    if op == "~":
        return [(">=", low), ("<", up)]
    if c is None:
        return {"": [(">=", low), ("<", up)], "=": [(">=", low), ("<", up)], ">=": [(">=", low)], "<": [("<", (*low[:3], floor))], "<=": [("<", up)], ">": [(">=", up[:3] + ((),))]}[op]
    return [(op or "=", low)] if op != "=" else [("=", low)]


@lru_cache(maxsize=4096)
def parse_range(text: str) -> tuple[tuple[tuple[str, Version], ...], ...] | None:
    """Alternatives of comparators; None if the range isn't valid."""
    out = []
    for alternative in text.split("||"):
        alternative = alternative.strip()
        if m := re.fullmatch(r"(\S+)\s+-\s+(\S+)", alternative):
            low, high = _bounds(">=", m[1]), _bounds("<=", m[2])
            if low is None or high is None:
                return None
            out.append((*low, *high))
            continue
        found: list[tuple[str, Version]] = []
        for token in re.sub(r"(~>|[<>]=?|=|~|\^)\s+", r"\1", alternative).split():
            m = re.match(r"(~>|[<>]=?|=|~|\^)?(.*)$", token)
            got = _bounds({"~>": "~", None: ""}.get(m[1], m[1]), m[2])
            if got is None:
                return None
            found += got
        out.append(tuple(found))
    return tuple(out)


def satisfies(version: str | None, text: str | None) -> bool:
    """Whether the version is in the range. A prerelease only is where a comparator of that alternative has a prerelease
    of the same three numbers."""
    v, alternatives = parse(version), parse_range(text.strip()) if text is not None else None
    if v is None or alternatives is None:
        return False
    k = order(v)
    test = {"=": lambda o: k == o, ">": lambda o: k > o, ">=": lambda o: k >= o, "<": lambda o: k < o, "<=": lambda o: k <= o}
    for comparators in alternatives:
        if all(test[op](order(w)) for op, w in comparators) and (not v[3] or any(w[3] and w[3] != ("0",) and w[:3] == v[:3] for _, w in comparators)):
            return True
    return False


@F.pandas_udf(BooleanType())
def version_in_range(version: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([satisfies(v, r) for v, r in zip(version, text, strict=True)], dtype=bool)


_BOUNDS = "array<array<struct<op:string,major:bigint,minor:bigint,patch:bigint,pre:array<string>>>>"


def bounds(text: Column) -> Column:
    """The alternatives of a range, each its comparators, null for an invalid one. Python, so for tables of ranges, not for pairs."""

    def run(texts: pd.Series) -> pd.Series:
        found = [None if t is None else parse_range(t.strip()) for t in texts]
        return pd.Series([None if r is None else [[{"op": op, "major": v[0], "minor": v[1], "patch": v[2], "pre": list(v[3])} for op, v in alt] for alt in r] for r in found], dtype=object)

    return F.pandas_udf(run, _BOUNDS)(text)


def _key(major: Column, minor: Column, patch: Column, pre: Column) -> Column:
    """A version as a value that Spark orders as versions are: a prerelease before its release, numeric identifiers before others."""
    number, bare = (lambda x: x.rlike("^[0-9]+$")), (lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))  # of any length: more digits are more
    parts = F.transform(pre, lambda x: F.struct(F.when(number(x), 0).otherwise(1).alias("kind"), F.when(number(x), F.length(bare(x))).otherwise(0).alias("digits"), F.when(number(x), bare(x)).otherwise(x).alias("s")))
    return F.struct(major.alias("a"), minor.alias("b"), patch.alias("c"), F.when(F.size(pre) > 0, 0).otherwise(1).alias("release"), parts.alias("pre"))


def ordered(v: Column) -> Column:
    """The key of a version given by its ``numbers``."""
    return _key(v["major"], v["minor"], v["patch"], F.when(v["pre"] == "", F.array().cast("array<string>")).otherwise(F.split(v["pre"], r"\.")))


def comparators(alternatives: Column) -> Column:
    """``bounds`` made ready for ``holds``: each comparator with its key, and whether it names a prerelease."""
    one = lambda c: F.struct(c["op"].alias("op"), _key(c["major"], c["minor"], c["patch"], c["pre"]).alias("key"), ((F.size(c["pre"]) > 0) & (F.array_join(c["pre"], ".") != "0")).alias("named"))
    return F.transform(alternatives, lambda alt: F.transform(alt, one))


def holds(own: Column, alternatives: Column) -> Column:
    """Whether a version, as its ``ordered`` key, is in a range, as its ``comparators``: comparisons only, for joins of many pairs.

    A prerelease is only in the range where a comparator of that alternative has one of the same three numbers.
    """

    def one(c: Column) -> Column:
        key = c["key"]
        return F.when(c["op"] == "=", own == key).when(c["op"] == ">", own > key).when(c["op"] == ">=", own >= key).when(c["op"] == "<", own < key).otherwise(own <= key)

    def same(c: Column) -> Column:
        return c["named"] & (c["key"]["a"] == own["a"]) & (c["key"]["b"] == own["b"]) & (c["key"]["c"] == own["c"])

    return F.coalesce(F.exists(alternatives, lambda alt: F.forall(alt, one) & ((own["release"] == 1) | F.exists(alt, same))), F.lit(False))


def within(version: Column, alternatives: Column) -> Column:
    """Whether a version is in a range given by its ``bounds``. Invalid ones are in none."""
    v = numbers(version)
    return v.isNotNull() & holds(ordered(v), comparators(alternatives))


_END = (1 << 63) - 1


def reached(alternative: tuple[tuple[str, Version], ...]) -> tuple[int, int, int | None] | None:
    """(lowest major, highest major, the minor if there is only one) of what an alternative can hold; None if it holds nothing."""
    low, high = (0, 0), (_END, _END)
    for op, v in alternative:
        if op in (">", ">=", "="):
            low = max(low, v[:2])
        if op in ("<", "<=", "="):
            end = v[:2]
            if op == "<" and v[2:] == (0, ("0",)):  # nothing with these numbers is below
                end = (v[0], v[1] - 1) if v[1] else (v[0] - 1, _END)
            high = min(high, end)
    return None if low > high else (low[0], high[0], low[1] if low == high else None)


def reach(text: Column) -> Column:
    """{low, high, minor} of each alternative of a range that can hold something; null for an invalid range."""

    def run(texts: pd.Series) -> pd.Series:
        found = [None if t is None else parse_range(t.strip()) for t in texts]
        each = [None if r is None else [x for x in map(reached, r) if x] for r in found]
        return pd.Series([None if r is None else [{"low": x[0], "high": x[1], "minor": x[2]} for x in r] for r in each], dtype=object)

    return F.pandas_udf(run, "array<struct<low:bigint,high:bigint,minor:bigint>>")(text)


@F.pandas_udf(BooleanType())
def valid_range(text: pd.Series) -> pd.Series:
    return pd.Series([t is not None and parse_range(t.strip()) is not None for t in text], dtype=bool)


def is_valid(version: Column) -> Column:
    """Whether a text is a full version; a pattern, so it stays in the JVM."""
    return F.coalesce(F.trim(version).rlike(_FULL.pattern), F.lit(False))


def numbers(version: Column) -> Column:
    """{major, minor, patch, pre} of a version, for joins by plain comparison; null if it isn't valid."""
    part = lambda i: F.regexp_extract(F.trim(version), _FULL.pattern, i)
    return F.when(is_valid(version), F.struct(part(1).cast("long").alias("major"), part(2).cast("long").alias("minor"), part(3).cast("long").alias("patch"), part(4).alias("pre")))
