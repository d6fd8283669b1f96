"""Matching in rounds against matching in one task, and exact means against Python's fractions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.functions.fractions import mean_fractions, times
from tessera.operators import assign, peel

FNS = "file string, idx int, name string, tokens array<string>, types array<string>"


@pytest.fixture(scope="module")
def sides(spark):
    """Files that meet several libraries, with anonymous functions, copies, empty bags and a null one."""
    rng, rows = random.Random(6), []
    for k in range(9):
        for i in range(rng.randrange(1, 12)):
            tokens = rng.choices("abcd", k=rng.choice([0, 1, 2, 3, 3, 5, 6]))
            name = rng.choice(["f", "g", "f:>>:[anonymous]", "[anonymous]", "h", None])
            rows.append((f"{'u' if k < 5 else 'l'}{k}", i * 2, name, tokens if rng.random() < 0.95 else None, [t + "x" for t in tokens]))
    df = spark.createDataFrame(rows, FNS).cache()
    unknown, lib = df.filter("file < 'm' or file > 'n'").filter("file like 'u%'"), df.filter("file like 'l%'").withColumnRenamed("file", "lib")
    pairs = spark.createDataFrame([(f"u{a}", f"l{b}") for a in range(6) for b in range(5, 10) if (a + b) % 3], "file string, lib string")  # u5 and l9 have no functions
    return pairs, unknown, lib


@pytest.mark.parametrize("name", list(assign.METHODS))
def test_large_pairs_match_as_small_ones(sides, name):
    def rows(task_functions):
        found = assign.match_pairs(*sides, "file", "lib", name, task_functions).collect()
        return sorted(((r.file, r.lib, r.num, r.den, round(r.val, 12), r.unknown_idx, r.lib_idx, [round(v, 12) for v in r.pair_val]) for r in found), key=str)

    want = rows(10**6)
    assert len(want) == sides[0].count() and rows(0) == want and rows(14) == want


def test_exact_means(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(0, 40), rng.choice([0, 1, 7, 97, 101, 10007, 99991, 1299709, 15485863, 2**61 - 1])) for k in range(6) for _ in range(60)] + [(9, None, 3), (9, 1, 3), (8, None, None)]
    found = {r.k: r for r in mean_fractions(spark.createDataFrame(rows, "k int, num long, den long").repartition(5), ["k"]).collect()}
    assert 8 not in found
    for k, r in found.items():
        each = [Fraction(n, d) if d else Fraction(1) for i, n, d in rows if i == k and n is not None]
        mean = sum(each) / len(each)
        assert (r.num, r.den) == (str(mean.numerator), str(mean.denominator)) and r.val == pytest.approx(float(mean))
    cases = [(3, 4, "2", "3", (1, 2)), (3, 0, "2", "3", (0, 0)), (3, 4, None, None, (3, 4)), (1, 3, str(2**70 + 1), str(2**70), (None, None))]
    df = spark.createDataFrame([c[:4] for c in cases], "a long, b long, c string, d string")
    got = df.select(times(*(F.col(c) for c in "abcd")).alias("x")).select("x.*").collect()
    assert [(r.num, r.den) for r in got] == [c[4] for c in cases] and got[3].val == pytest.approx(1 / 3) and got[1].val is None


@pytest.mark.parametrize("name", ["fn-st-toks-v6", "fn-st-toks-v2"])
def test_large_files_are_peeled_as_small_ones(spark, name):
    """Libraries with several versions, some equal, one of them the whole of what a file has; a file without candidates."""
    rng, fn = random.Random(8), lambda i, t: (i, t[0], list(t), [])
    bodies = ["".join(rng.choices("abcde", k=rng.randrange(1, 5))) for _ in range(14)]
    libs = [(f"lib{k}", f"1.{v}.0", "0000", v, *fn(i, t)) for k in range(4) for v in range(3) for i, t in enumerate(rng.sample(bodies, rng.randrange(1, 4)))]
    libs += [("lib0", "9.0.0", "0000", 3, *r[4:]) for r in libs if r[0] == "lib0" and r[1] == "1.1.0"]
    files = [(f, *fn(i, t)) for f in range(4) for i, t in enumerate(rng.choices(bodies, k=3 + 4 * f))]
    files += [(1, *fn(90 + r[4], r[6])) for r in libs if r[:2] == ("lib2", "1.2.0")]
    chosen = [(f, f"lib{k}", rng.choice([0.9, 0.5])) for f in range(3) for k in range(4)] + [(2, "absent", 0.7)]
    frames = (
        spark.createDataFrame(files, "file_key int, idx int, name string, tokens array<string>, types array<string>"), spark.createDataFrame(chosen, "file_key int, lib string, val double"),
        spark.createDataFrame(libs, "lib string, version string, lib_file string, pos int, idx int, name string, tokens array<string>, types array<string>"),
    )
    want, got = ([tuple(r) for r in peel.peel_files(*frames, name=name, task_functions=n).select("file_key", *[c for c, _ in peel.OUT]).collect()] for n in (10**6, 0))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[1] for r in want} == {"rank", "secondary", "remaining"} and any(r[4] and r[4] > 1 for r in want)
