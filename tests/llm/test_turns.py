"""Conversation repair against exhaustive search over rows, states and letters."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, gaps int, name int"


def slow_damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        fate = zlib.crc32(":".join(shown).encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        kept = out.setdefault(conv, [])
        if fate:
            row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            kept += [row] * (2 if fate == 3 else 1)
    return out


def slow_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    ts = [t for t, *_ in rows if t is not None]
    blank = dup = cut = illegal = 0
    seen, marks = set(), []
    for n, (_, role, text) in enumerate(rows):
        left = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, dup, cut = blank + (fault == "b"), dup + (fault == "d"), cut + (fault == "t")
        illegal += n > 0 and rows[n - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        marks.append(fault)
    # Every way to edit, row by row; ways with equal role initials so far compete.
    ways = {"": (0, "", [])}
    fits = lambda x: re.fullmatch("s?(ua)*u?", x)

    def shrink(x):  # the initials that decide what may follow
        return x if len(x) < 2 else ("ua" if x[-1] == "a" else "u")

    def better(new, key, way):
        if fits(key) and (key := shrink(key)) is not None and (key not in new or way[:2] < new[key][:2]):
            new[key] = way

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(2):
            for key, (cost, audit, body) in list(out.items()):
                for role in ("user", "assistant"):
                    better(out, key + role[0], (cost + 2, audit + "I", [*body, f"{role}:"]))
        return out

    for (_, role, text), fault in zip(rows, marks, strict=True):
        new = {}
        for key, (cost, audit, body) in with_inserts(ways).items():
            better(new, key, (cost + 3, audit + "D", body))
            if fault not in ("b", "d"):
                late = int(fault == "t")
                if role[:1]:
                    better(new, key + role[0], (cost + late, audit + "K", [*body, f"{role}:{text}"]))
                for made in ("user", "assistant"):
                    better(new, key + made[0], (cost + 2 + late, audit + "R", [*body, f"{made}:{text}"]))
        ways = new
    cost, audit, body = min((w for k, w in with_inserts(ways).items() if re.fullmatch("(s?(ua)+)?", k)), key=lambda w: w[:2])
    gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
    return (gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest()), body


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    texts = ["Fine.", "Well then!", "cut off", " \t\r\n", "", None, "Fine. \x0b", "x\x85", "é?", "日本.", "Long " * 3000 + "."]
    for conv in [None, *range(40)]:
        t = rng.randrange(5)
        for _ in range(rng.choice([1, 2, 3, 6, 9, 14])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Üser", "usher"])
            out.append((conv, rng.choice([t, t, t, None]), role, rng.choice(texts), 1, 2))
            t += rng.choice([0, 1, 1, 1, 3])
    out += [(77, k, "user" if k % 2 == 0 else "assistant", f"{k % 50} fine.", 1, 2) for k in range(300)]  # long, with duplicates
    out += [(78, 1, "user", "Same.", 1, 2)] * 60 + [(79, None, "assistant", "", 1, 2)]
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]


@pytest.mark.parametrize("segment", [3, 10, 512])
def test_repair(spark, rows, segment):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r[c] for c in NAMES) for r in turns.repair(turns.damage(df), copies=F.col("copies"), segment=segment).collect()}
    want = {conv: slow_repair(kept)[0] for conv, kept in slow_damage(rows).items()}
    assert set(got) == set(want) and any(not kept for kept in slow_damage(rows).values())
    for conv, w in want.items():
        assert got[conv] == w, conv


def test_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for segment in (4, 512):
        found = turns.repaired_turns(df, segment=segment).orderBy("part", "seq", "step").collect()
        bodies = {}
        for r in found:
            bodies.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
            assert r.edit != "I" or (r.text == "" and r.turn is None)
        by_conv = {}
        for conv, turn, role, text, *_ in rows:
            by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
        for conv, kept in by_conv.items():
            assert bodies.get(conv, []) == slow_repair(kept)[1]


def test_empty_and_other_names(spark):
    assert turns.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([("a b", 1, "user", "Hi.", 5), ("a b", 2, "assistant", "Ho.", 5)], "c string, t int, who string, body string, part int")
    (r,) = turns.repair(df, "c", "t", "who", "body").collect()
    assert (r.conv_id, r.cost, r.audit) == ("a b", 0, "KK") and r.digest == hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest()


def test_search_stops_and_breaks_ties():
    assert turns.cheapest([]) == {0: (0, b"")}
    assert turns.cheapest([(b"s", False, False)]) == {0: (3, b"D")}
    assert turns.cheapest([(b"u", False, False)]) == {3: (2, b"KI")}
    assert turns.cheapest([(b"a", False, True)]) == {0: (3, b"D")}  # as cheap as IK, and D comes first
    assert turns.cheapest([(b"u", False, False), (b"u", False, False)]) == {3: (2, b"KR")}
