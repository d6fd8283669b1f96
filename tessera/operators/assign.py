"""One-to-one assignment of functions by bag similarity. Pairs of a file and a library of up to TASK_FUNCTIONS functions are
solved in one grouped-map task each; larger ones in rounds over a table of similar functions, with the same result."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.fractions import LONG, mean_fractions, times
from tessera.functions.text import ANONYMOUS, NAME_SEPARATOR
from tessera.operators import rounds
from tessera.operators.pairing import bag_key, first_by_name, occurrence

#: Fixed value: stands for a function that got no partner.
UNMATCHED = "__unmatched__"
#: Functions of a file and a library together that one task matches.
TASK_FUNCTIONS = 20_000
CERTAIN = (1.0, -1, -1)

Score = tuple[float, int, int]


@dataclass
class Fn:
    index: int
    name: str = ""
    tokens: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)


@dataclass
class Match:
    score: Score
    pairs: dict[int, tuple[int, Score]]  # position in unknown -> position in lib and its score


def make_score(num: int, den: int, empty: float = 1.0) -> Score:
    return (num / den if den else empty, num, den)


def bag_score(a: Counter, b: Counter) -> Score:
    num = (a & b).total()
    return make_score(num, a.total() + b.total() - num)


def similar(unknown: list[list[str]], lib: list[list[str]]) -> list[tuple[int, int, Score]]:
    """All pairs of bags that score above 0, by an index on tokens; empty bags equal one another."""
    bags = [Counter(x) for x in lib]
    posted: dict[str, list[int]] = {}
    for j, bag in enumerate(bags):
        for t in bag:
            posted.setdefault(t, []).append(j)
    out = []
    for i, tokens in enumerate(unknown):
        bag, num = Counter(tokens), Counter()
        for t, n in bag.items():
            for j in posted.get(t, ()):
                num[j] += min(n, bags[j][t])
        out += [(i, j, make_score(n, len(tokens) + len(lib[j]) - n)) for j, n in sorted(num.items())]
        if not tokens:
            out += [(i, j, make_score(0, 0)) for j, x in enumerate(lib) if not x]
    return out


def in_turn(pairs: list[tuple[int, int, Score]], lib_chooses: bool) -> dict[int, tuple[int, Score]]:
    """Each function of the choosing side, in order, takes the best one left of the other side; ties go to the lower index."""
    by: dict[int, list] = {}
    for u, b, s in pairs:
        by.setdefault(b if lib_chooses else u, []).append((-s[0], u if lib_chooses else b, s))
    taken, out = set(), {}
    for me in sorted(by):
        for _, other, s in sorted(by[me], key=lambda x: x[:2]):
            if other not in taken:
                taken.add(other)
                out[other if lib_chooses else me] = (me if lib_chooses else other, s)
                break
    return out


def best_first(pairs: list[tuple[int, int, Score]]) -> dict[int, tuple[int, Score]]:
    """The best pair of all, then the best of what is left, and so on; ties by unknown, then library index."""
    out, used = {}, set()
    for u, b, s in sorted(pairs, key=lambda p: (-p[2][0], p[0], p[1])):
        if u not in out and b not in used:
            out[u] = (b, s)
            used.add(b)
    return out


def _over_union(n_u: int, n_l: int, m: int) -> Score:
    return make_score(m, n_u + n_l - m)


def _chosen_names(unknown: list[Fn], lib: list[Fn], pairs: dict) -> Score:
    names = Counter(lib[pairs[i][0]].name if i in pairs else UNMATCHED for i in range(len(unknown)))
    return bag_score(names, Counter(f.name for f in lib))


def v1(unknown: list[Fn], lib: list[Fn], bag: Callable[[Fn], list[str]] = lambda f: f.tokens) -> Match:
    pairs = in_turn(similar([bag(f) for f in unknown], [bag(f) for f in lib]), False)
    return Match(_chosen_names(unknown, lib, pairs), pairs)


def by_types(unknown: list[Fn], lib: list[Fn]) -> Match:
    return v1(unknown, lib, lambda f: f.types)


def v2(unknown: list[Fn], lib: list[Fn]) -> Match:
    pairs = in_turn(similar([f.tokens for f in unknown], [f.tokens for f in lib]), True)
    return Match(_over_union(len(unknown), len(lib), len(pairs)), pairs)


def v3(unknown: list[Fn], lib: list[Fn]) -> Match:
    pairs = best_first(similar([f.tokens for f in unknown], [f.tokens for f in lib]))
    return Match(_over_union(len(unknown), len(lib), len(pairs)), pairs)


def v4(unknown: list[Fn], lib: list[Fn]) -> Match:
    """v2's score times the exact mean of the pairs' scores, as a reduced fraction."""
    found = v2(unknown, lib)
    _, num, den = found.score
    if not den:
        return found
    each = [Fraction(s[1], s[2]) if s[2] else Fraction(1) for _, s in found.pairs.values()]
    exact = Fraction(num, den) * (sum(each) / len(each) if each else 1)
    if max(exact.numerator, exact.denominator) >= LONG:
        return Match((exact.numerator / exact.denominator, None, None), found.pairs)  # no long holds it
    return Match(make_score(exact.numerator, exact.denominator), found.pairs)


def exact_pairs(unknown: list[list[str]], lib: list[list[str]]) -> dict[int, tuple[int, Score]]:
    """The k-th bag of unknown with the k-th equal one of lib."""
    free: dict[tuple, list[int]] = {}
    for j, tokens in enumerate(lib):
        free.setdefault(tuple(sorted(tokens)), []).append(j)
    out, used = {}, Counter()
    for i, tokens in enumerate(unknown):
        key = tuple(sorted(tokens))
        if used[key] < len(free.get(key, ())):
            out[i] = (free[key][used[key]], make_score(len(tokens), len(tokens)))
            used[key] += 1
    return out


def v5(unknown: list[Fn], lib: list[Fn]) -> Match:
    pairs = exact_pairs([f.tokens for f in unknown], [f.tokens for f in lib])
    return Match(_over_union(len(unknown), len(lib), len(pairs)), pairs)


def v6(unknown: list[Fn], lib: list[Fn]) -> Match:
    pairs = exact_pairs([f.tokens for f in unknown], [f.tokens for f in lib])
    return Match(make_score(len(pairs), len(lib), 0.0 if unknown else 1.0), pairs)


def _first_names(fns: list[Fn]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, f in enumerate(fns):
        out.setdefault(f.name, i)
    return out


def names_jaccard(unknown: list[Fn], lib: list[Fn]) -> Match:
    u, b = _first_names(unknown), _first_names(lib)
    pairs = {i: (b[n], CERTAIN) for n, i in u.items() if n in b}
    return Match(_over_union(len(u), len(b), len(pairs)), pairs)


def names_our(unknown: list[Fn], lib: list[Fn]) -> Match:
    u, b = _first_names(unknown), _first_names(lib)
    pairs = {i: (b[n], CERTAIN) for n, i in u.items() if n in b}
    return Match(make_score(len(pairs), len(b), 0.0 if u else 1.0), pairs)


def names_tokens(unknown: list[Fn], lib: list[Fn]) -> Match:
    """Named functions pair by equal full names, anonymous ones as in v1 among themselves."""
    hidden = lambda f: f.name.split(NAME_SEPARATOR)[-1] == ANONYMOUS
    sides = [([i for i, f in enumerate(x) if not hidden(f)], [i for i, f in enumerate(x) if hidden(f)]) for x in (unknown, lib)]
    (u_named, u_anon), (l_named, l_anon) = sides
    named = exact_pairs([[unknown[i].name] for i in u_named], [[lib[i].name] for i in l_named])
    anon = in_turn(similar([unknown[i].tokens for i in u_anon], [lib[i].tokens for i in l_anon]), False)
    pairs = {u_named[i]: (l_named[j], CERTAIN) for i, (j, _) in named.items()} | {u_anon[i]: (l_anon[j], s) for i, (j, s) in anon.items()}
    return Match(_over_union(len(unknown), len(lib), len(pairs)), pairs)


#: Registry of the methods; the default is v6.
METHODS: dict[str, Callable[[list[Fn], list[Fn]], Match]] = {
    "fn-st-toks-v1": v1, "fn-st-toks-v2": v2, "fn-st-toks-v3": v3, "fn-st-toks-v4": v4, "fn-st-toks-v5": v5, "fn-st-toks-v6": v6,
    "fn-st-types": by_types, "fn-names-jaccard": names_jaccard, "fn-names-our": names_our, "fn-names-st-toks": names_tokens,
}
DEFAULT_METHOD = "fn-st-toks-v6"
#: Methods that pair equal token bags only.
EXACT_METHODS = ("fn-st-toks-v5", "fn-st-toks-v6")


def method(name: str | None = None) -> Callable[[list[Fn], list[Fn]], Match]:
    if (name or DEFAULT_METHOD) not in METHODS:
        raise ValueError(f"no such method: {name}")
    return METHODS[name or DEFAULT_METHOD]


def functions_of(rows: pd.DataFrame) -> list[Fn]:
    ordered = rows.sort_values("idx")
    return [Fn(int(i), n or "", list(t) if t is not None else [], list(y) if y is not None else []) for i, n, t, y in zip(ordered.idx, ordered["name"], ordered.tokens, ordered.types, strict=True)]


MAPPED = "num bigint, den bigint, val double, unknown_idx array<int>, lib_idx array<int>, pair_val array<double>"


def match_pairs(pairs: DataFrame, unknown: DataFrame, lib: DataFrame, file: str, lib_key: str, name: str | None = None, task_functions: int = TASK_FUNCTIONS) -> DataFrame:
    """(file, lib_key, num, den, val, unknown_idx, lib_idx, pair_val) of each candidate pair, by the method named.

    unknown (file, idx, name, tokens, types) and lib (lib_key, ...) go to each of their pairs; pair arrays are parallel
    and ordered by unknown_idx. A task holds the functions of one pair, task_functions at most; pairs with more are
    matched by ``match_large``, with equal results.
    """
    both = pairs.select(file, lib_key).distinct()
    n_u, n_l = unknown.groupBy(file).agg(F.count("*").alias("_n")), lib.groupBy(lib_key).agg(F.count("*").alias("_m"))
    sized = both.join(n_u, file, "left").join(n_l, lib_key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0)))
    large = sized.filter(F.col("_n") > task_functions).select(file, lib_key)
    if large.isEmpty():
        return _in_tasks(both, unknown, lib, file, lib_key, name)
    small = sized.filter(F.col("_n") <= task_functions).select(file, lib_key)
    return _in_tasks(small, unknown, lib, file, lib_key, name).unionByName(match_large(large, unknown, lib, file, lib_key, name))


def _in_tasks(both: DataFrame, unknown: DataFrame, lib: DataFrame, file: str, lib_key: str, name: str | None) -> DataFrame:
    run = method(name)
    fields = ["idx", "name", "tokens", "types"]
    sides = both.join(unknown.select(file, *fields), file, "left").withColumn("side", F.lit(0)).unionByName(both.join(lib.select(lib_key, *fields), lib_key, "left").withColumn("side", F.lit(1)))
    kinds = {c: both.schema[c].dataType.simpleString() for c in (file, lib_key)}

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.idx.notna()]
        u, b = functions_of(rows[rows.side == 0]), functions_of(rows[rows.side == 1])
        found = run(u, b)
        at = sorted(found.pairs)
        return pd.DataFrame({file: [key[0]], lib_key: [key[1]], "num": [found.score[1]], "den": [found.score[2]], "val": [found.score[0]], "unknown_idx": [[u[i].index for i in at]], "lib_idx": [[b[found.pairs[i][0]].index for i in at]], "pair_val": [[found.pairs[i][1][0] for i in at]]}).astype({"num": "Int64", "den": "Int64"})

    return sides.groupBy(file, lib_key).applyInPandas(one, f"{file} {kinds[file]}, {lib_key} {kinds[lib_key]}, {MAPPED}")


def _mapped(pairs: DataFrame, unknown: DataFrame, lib: DataFrame, file: str, lib_key: str, name: str) -> DataFrame:
    """(file, lib_key, u, l, num, den, val) of the functions that the method pairs."""
    keys, exact = [file, lib_key], lambda df: df.withColumns({"num": F.lit(-1).cast("long"), "den": F.lit(-1).cast("long"), "val": F.lit(1.0)})

    def equal(mine: DataFrame, theirs: DataFrame, value: str) -> DataFrame:
        one = lambda df, key, idx: occurrence(df.select(key, F.col("idx").alias(idx), F.col(value).alias("v")), [key], "v", idx)
        return one(mine, file, "u").join(pairs, file).join(one(theirs, lib_key, "l"), [lib_key, "v", "k"]).select(*keys, "u", "l", *(["v"] if value == "bag" else []))

    if name in EXACT_METHODS:
        bags = lambda df: df.withColumn("bag", bag_key("tokens"))
        n = F.size("v").cast("long")
        return equal(bags(unknown), bags(lib), "bag").select(*keys, "u", "l", n.alias("num"), n.alias("den"), F.lit(1.0).alias("val"))
    if name.startswith("fn-names") and name != "fn-names-st-toks":
        return exact(equal(first_by_name(unknown, [file]), first_by_name(lib, [lib_key]), "name"))
    hidden = F.element_at(F.split("name", NAME_SEPARATOR), -1) == ANONYMOUS
    split = name == "fn-names-st-toks"
    mine, theirs = (df.filter(hidden) if split else df for df in (unknown, lib))
    edges = rounds.similar_pairs(pairs, mine, theirs, file, lib_key, "types" if name == "fn-st-types" else "tokens")
    out = rounds.best_first(edges, keys) if name == "fn-st-toks-v3" else rounds.in_turn(edges, keys, name in ("fn-st-toks-v2", "fn-st-toks-v4"))
    return out.unionByName(exact(equal(unknown.filter(~hidden), lib.filter(~hidden), "name"))) if split else out


def match_large(pairs: DataFrame, unknown: DataFrame, lib: DataFrame, file: str, lib_key: str, name: str | None = None) -> DataFrame:
    """As ``match_pairs``, with no pair's functions in one task: equi-joins for equal bags and names, rounds for similar ones."""
    name = name or DEFAULT_METHOD
    method(name)
    keys, total = [file, lib_key], lambda df, key, n: df.groupBy(key).agg(F.count("*").cast("long").alias(n))
    unknown, lib = (df.withColumns({"name": F.coalesce("name", F.lit("")), "tokens": F.coalesce("tokens", F.array().cast(df.schema["tokens"].dataType))}) for df in (unknown, lib))
    found = _mapped(pairs, unknown, lib, file, lib_key, name)
    at = F.array_sort(F.collect_list(F.struct("u", "l", "val")))
    mapped = found.groupBy(*keys).agg(at.alias("at"), F.count("*").cast("long").alias("m"))
    sides = [first_by_name(unknown, [file]), first_by_name(lib, [lib_key])] if name in ("fn-names-jaccard", "fn-names-our") else [unknown, lib]
    rows = pairs.join(mapped, keys, "left").join(total(sides[0], file, "n"), file, "left").join(total(sides[1], lib_key, "k"), lib_key, "left")
    rows = rows.fillna(0, ["m", "n", "k"])
    m, n, k = (F.col(c) for c in "mnk")
    if name in ("fn-st-toks-v1", "fn-st-types"):
        # Names of the chosen functions, and as many unmatched ones, against the library's names, as bags.
        bag = lambda df, by, value, c: df.groupBy(*by, F.col(value).alias("name")).agg(F.count("*").alias(c))
        chosen = bag(found.select(*keys, F.col("l").alias("idx")).join(lib.select(lib_key, "idx", "name"), [lib_key, "idx"]), keys, "name", "a")
        loose = rows.select(*keys, F.lit(UNMATCHED).alias("name"), (n - m).alias("a")).filter("a > 0")
        chosen = chosen.unionByName(loose).groupBy(*keys, "name").agg(F.sum("a").alias("a"))
        both = chosen.join(bag(lib, [lib_key], "name", "b"), [lib_key, "name"]).groupBy(*keys).agg(F.sum(F.least("a", "b")).cast("long").alias("both"))
        rows = rows.join(both, keys, "left").fillna(0, ["both"])
        num, den = F.col("both"), n + k - F.col("both")
    elif name in ("fn-st-toks-v6", "fn-names-our"):
        num, den = m, k
    else:
        num, den = m, n + k - m
    rows = rows.select(*keys, num.alias("num"), den.alias("den"), "at", "n")
    empty = F.when(F.col("n") == 0, 1.0).otherwise(0.0) if name in ("fn-st-toks-v6", "fn-names-our") else F.lit(1.0)
    val = F.when(F.col("den") == 0, empty).otherwise(F.col("num") / F.col("den"))
    if name == "fn-st-toks-v4":
        means = mean_fractions(found, keys).select(*keys, F.col("num").alias("by"), F.col("den").alias("of"))
        rows = rows.join(means, keys, "left").withColumn("f", times(F.col("num"), F.col("den"), F.col("by"), F.col("of"))).withColumns({"num": F.col("f.num"), "den": F.col("f.den")})
        val = F.coalesce("f.val", empty)
    part = lambda c, kind: F.coalesce(F.transform("at", lambda x: x[c]), F.array()).cast(f"array<{kind}>")
    return rows.select(*keys, "num", "den", val.alias("val"), part("u", "int").alias("unknown_idx"), part("l", "int").alias("lib_idx"), part("val", "double").alias("pair_val"))
