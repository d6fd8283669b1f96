from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import bags
from tessera.operators import assign

CASES = [([], []), (["a"], []), ([], ["a"]), (["a", "b", "b", "c", "c"], ["b", "b", "c", "d"]), ("5 3 2 1 4 1".split(), "1 2 6 3 4 8".split()), (["x"] * 3, ["x"] * 5), ("1 1 2 2 3 4 5".split(), "1 2 2 2 3 6 7".split()), (["a", "b"], ["b", "a"])]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES)], "i int, a array<string>, b array<string>")


def kept(a, b):
    left, out = Counter(b), []
    for x in a:
        if left[x]:
            left[x] -= 1
            out.append(x)
    return out


def rest(a, b):
    left, out = Counter(b), []
    for x in a:
        if left[x]:
            left[x] -= 1
        else:
            out.append(x)
    return out


def test_bag_functions(pairs):
    a, b = F.col("a"), F.col("b")
    rows = pairs.select("i", bags.bag_jaccard(a, b).alias("j"), bags.lib_portion(a, b).alias("p"), bags.repeated_ops(a, b).alias("r"), bags.pairs_of(a, b).alias("m"), bags.occurrences(a).alias("o"), bags.add_missing(a, b).alias("x")).collect()
    for r in rows:
        a, b = CASES[r.i]
        n = (Counter(a) & Counter(b)).total()
        den = len(a) + len(b) - n
        assert (r.j.num, r.j.den, r.j.val) == (n, den, n / den if den else 1.0)
        assert (r.p.num, r.p.den, r.p.val) == (n, len(b), n / len(b) if b else float(not a))
        assert (r.r.i, r.r.d, r.r.rd) == (kept(a, b), rest(a, b), rest(b, a))
        want, used = [], set()
        for i, v in enumerate(a):
            j = next((j for j, w in enumerate(b) if w == v and j not in used), None)
            if j is not None:
                used.add(j)
                want.append((i, j))
        assert [(m.i, m.j) for m in r.m] == want
        assert sorted((o.v, o.k) for o in r.o) == sorted((v, a[: i + 1].count(v)) for i, v in enumerate(a))
        assert r.x == a + [v for v in b if v not in a]


def test_set_functions(pairs):
    a, b = F.col("a"), F.col("b")
    for r in pairs.select("i", bags.set_jaccard(a, b).alias("j"), bags.set_portion(b, a).alias("p"), bags.is_subset(a, b).alias("s"), bags.union(a, b).alias("u"), bags.difference(a, b).alias("d"), bags.intersection(a, b).alias("n")).collect():
        x, y = (set(v) for v in CASES[r.i])
        assert r.j.val == (len(x & y) / len(x | y) if x | y else 1.0) and r.s == (x <= y)
        assert (set(r.u), set(r.d), set(r.n)) == (x | y, x - y, x & y)
        assert r.p.val == (len(x & y) / len(y) if y else float(not x))


def test_numbers_indexes_and_fractions(spark):
    df = spark.createDataFrame([([1.0, float("nan")], [float("nan"), 1.0], [-1, 0, 1], [0, 1, 2])], "a array<double>, b array<double>, u array<int>, l array<int>")
    r = df.select(bags.bag_jaccard(F.col("a"), F.col("b")).alias("x"), bags.bag_jaccard(F.col("a"), F.col("b"), numbers=True).alias("y"), bags.lib_portion_indexes(F.col("u"), F.col("l")).alias("z"), bags.reduced(F.lit(12), F.lit(18)).alias("f"), bags.reduced(F.lit(5), F.lit(0)).alias("g"), bags.zip_apply(lambda p, q: p + q, F.col("u"), F.col("l")).alias("h")).first()
    assert (r.x.num, r.y.num, r.z.num, r.z.den) == (2, 1, 2, 3)
    assert tuple(r.f) == (2, 3) and tuple(r.g) == (5, 1) and r.h == [-1, 1, 3]
    ok = df.select(bags.invert_pairs(F.expr("array(struct(0 i, 2 j), struct(1 i, 0 j))")).alias("v")).first().v
    assert [tuple(p) for p in ok] == [(0, 1), (2, 0)]
    with pytest.raises(Exception, match="twice"):
        df.select(bags.invert_pairs(F.expr("array(struct(0 i, 2 j), struct(1 i, 2 j))"))).collect()


def test_positions_and_chunks(spark):
    df = spark.createDataFrame([([3, 3, 4, 4, 5, 5], []), ([1], [])], "a array<int>, e array<int>")
    r = df.select(bags.first_position(F.col("a"), F.lit(4)).alias("f"), bags.last_position(F.col("a"), F.lit(4)).alias("l"), bags.last_position(F.col("a"), F.lit(2)).alias("n"), bags.chunks(F.col("a"), 4).alias("c"), bags.chunks(F.col("e"), 4).alias("z")).collect()
    assert tuple(r[0][:3]) == (2, 3, -1) and r[0].c == [[3, 3, 4, 4], [5, 5]] and r[1].c == [[1]] and r[1].z == []


# The six functions of either side on which all methods are known to agree or differ.
UNKNOWN = [("aa", "1a 1b 1c 1d"), ("bb", "1a 2b 2c 2d"), ("cc", "3a 3b 3c 3d 3d"), ("[anonymous]", "4a 4b 4d 4d"), ("ee:>>:[anonymous]", "5a 5b 6a 6b"), ("ff:>>:[anonymous]", "5a 5c 5d 5d 6c 6d 6d")]
LIB = [("aa", "1a 1b 1c 1d"), ("bb", "2a 2b 2c 2d"), ("cc", "3a 3b 3c 3d"), ("[anonymous]", "4a 4b 4c 4d 4d 4d"), ("eee:>>:[anonymous]", "5a 5b 5c 5c 5d 5d"), ("fff:>>:[anonymous]", "6a 6b 6c 6d 6d")]
FULL = {0: (0, (4, 4)), 1: (1, (3, 5)), 2: (2, (4, 5)), 3: (3, (4, 6)), 4: (5, (2, 7)), 5: (4, (4, 9))}


def fns(rows):
    return [assign.Fn(i, n, t.split(), ["t_" + x for x in t.split()]) for i, (n, t) in enumerate(rows)]


@pytest.mark.parametrize(("name", "num", "den", "mapped"), [("fn-st-toks-v1", 6, 6, 6), ("fn-st-toks-v2", 6, 6, 6), ("fn-st-toks-v3", 6, 6, 6), ("fn-st-types", 6, 6, 6), ("fn-names-st-toks", 6, 6, 6), ("fn-st-toks-v4", 598, 945, 6), ("fn-st-toks-v5", 1, 11, 1), ("fn-st-toks-v6", 1, 6, 1), ("fn-names-jaccard", 4, 8, 4), ("fn-names-our", 4, 6, 4)])
def test_methods_on_the_fixture(name, num, den, mapped):
    m = assign.method(name)(fns(UNKNOWN), fns(LIB))
    assert m.score == (num / den, num, den) and len(m.pairs) == mapped
    for i, (j, s) in m.pairs.items():
        assert s == assign.CERTAIN or (j, s[1:]) == FULL[i]


@pytest.mark.parametrize("name", list(assign.METHODS))
def test_laws(name):
    run, a = assign.method(name), fns(UNKNOWN)
    assert run([], []).score == (1.0, 0, 0)
    assert run([], a).score[:2] == (0.0, 0) and run([], a).score[2] != 0
    assert run(a, []).score[0] == 0 and (run(a, []).score[2] == 0) == (name in ("fn-st-toks-v6", "fn-names-our"))
    same = run(a, a)
    assert same.score[0] == 1 and all(i == j for i, (j, _) in same.pairs.items())
    with pytest.raises(ValueError, match="no such method"):
        assign.method("nope")


TOKENS = st.lists(st.lists(st.sampled_from("abc"), max_size=4), max_size=6)


def naive(a, b):
    n = (Counter(a) & Counter(b)).total()
    return assign.make_score(n, len(a) + len(b) - n)


@settings(max_examples=150, deadline=None)
@given(TOKENS, TOKENS)
def test_choices_match_loops_over_all_pairs(us, ls):
    pairs = assign.similar(us, ls)
    every = {(i, j): naive(a, b) for i, a in enumerate(us) for j, b in enumerate(ls)}
    assert {(i, j): s for i, j, s in pairs} == {k: s for k, s in every.items() if s[0] > 0}
    for lib_chooses in (False, True):
        want, used = {}, set()
        for me in range(len(ls) if lib_chooses else len(us)):
            best = None
            for other in range(len(us) if lib_chooses else len(ls)):
                s = every[(other, me) if lib_chooses else (me, other)]
                if other not in used and s[0] > 0 and (best is None or s[0] > best[1][0]):
                    best = (other, s)
            if best:
                used.add(best[0])
                want[best[0] if lib_chooses else me] = (me if lib_chooses else best[0], best[1])
        assert assign.in_turn(pairs, lib_chooses) == want
    best = assign.best_first(pairs)
    left = {k: s for k, s in every.items() if s[0] > 0}
    while left:
        i, j = min(left, key=lambda k: (-left[k][0], k))
        assert best[i] == (j, left[i, j])
        left = {k: s for k, s in left.items() if k[0] != i and k[1] != j}
    exact = assign.exact_pairs(us, ls)
    taken = set()
    for i, a in enumerate(us):
        j = next((j for j, b in enumerate(ls) if j not in taken and sorted(a) == sorted(b)), None)
        assert exact.get(i, (None,))[0] == j
        taken.add(j)
