"""Many names at once against one regular expression for each name."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import automaton
from tessera.operators import mentions

letters = st.text("ab_-. é€\U0001f600", max_size=14)


def slow_count(text, name):
    return len(re.findall(rf"[^A-Za-z0-9]{re.escape(name)}[^A-Za-z0-9]", text))


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=8), st.lists(st.text("ab_-.é ", min_size=1, max_size=4), min_size=1, max_size=8, unique=True))
def test_counts(texts, names):
    found = automaton.standing(automaton.Automaton([n.encode() for n in names]), [t.encode() for t in texts])
    got = {(t, names[n]): c for t, n, c in zip(*(x.tolist() for x in found), strict=True)}
    assert got == {(k, n): c for k, t in enumerate(texts) for n in names if (c := slow_count(t, n))}


def test_lanes(monkeypatch):
    """Long texts in several lanes, names across their borders and across steps."""
    rng = random.Random(2)
    names = ["abab", "ba", "ab ab", "a", "b-a", "abababababababababab"]
    texts = ["".join(rng.choice("ab  -_") for _ in range(n)) for n in (5000, 0, 1, 7000, 300)]
    texts[3] = texts[3][:3000] + " abababababababababab " + texts[3][3000:]
    own = automaton.Automaton([n.encode() for n in names])
    for steps in (7, 128):
        monkeypatch.setattr(automaton, "STEPS", steps)
        found = automaton.standing(own, [t.encode() for t in texts])
        got = {(t, names[n]): c for t, n, c in zip(*(x.tolist() for x in found), strict=True)}
        assert got == {(k, n): c for k, t in enumerate(texts) for n in names if (c := slow_count(t, n))}


def test_name_counts(spark, monkeypatch):
    rows = [("f", "use the jquery the the jquery.ui"), ("f", " jquery "), ("g", None), ("g", "(a+b) lodash.get lodash-get xlodash.get"), (None, " the "), ("h", ""), ("h", "_the_the_")]
    names = [("the",), ("jquery",), ("jquery.ui",), ("a+b",), ("lodash.get",), (None,), ("",), ("the",), ("nowhere",)]
    comments, known = spark.createDataFrame(rows, "file string, text string"), spark.createDataFrame(names, "name string")
    want = {}
    for f, t in rows:
        for n in {n for (n,) in names if n}:
            if t and (c := slow_count(t, n)):
                want[f, n] = want.get((f, n), 0) + c
    for block in (mentions.BLOCK_BYTES, 8):
        assert {(r.file, r.name): r.n for r in mentions.name_counts(comments, known, "file", block_bytes=block).collect()} == want
    monkeypatch.setattr(mentions, "TEXT_BYTES", 3)
    assert {(r.file, r.name): r.n for r in mentions.name_counts(comments, known, "file").collect()} == want
    assert mentions.name_counts(comments.filter("false"), known, "file").count() == mentions.name_counts(comments, known.filter("false"), "file").count() == 0


def test_names_used(spark):
    """A name is a pattern here: a point is any character, a plus repeats, and what is no pattern is nowhere."""
    rows = [("f", " lodash-get "), ("f", "(lodash.get)"), ("g", "xlodash.get "), ("g", " aab "), ("g", " é_b€c "), ("h", None)]
    names = ["lodash.get", "a+b", "a(b", "b.c", "...", "nowhere"]
    got = mentions.names_used(spark.createDataFrame(rows, "file string, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "file").collect()
    want = set()
    for f, t in rows:
        for n in names:
            try:
                pattern = re.compile(rf"[^A-Za-z0-9]{n}[^A-Za-z0-9]")
            except re.error:
                continue
            if t and pattern.search(t):
                want.add((f, n))
    assert {(r.file, r.name) for r in got} == want and ("f", "lodash.get") in want and ("g", "b.c") in want


def test_names_used_holds_no_lists_of_places():
    """Very many places of a name's plain part: 8 MB of texts take a small multiple of the bytes searched at once."""
    import tracemalloc

    import pyarrow as pa

    own = mentions._Used.build(["ab.cd", "x.y"])
    b = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([b" ab" * 700 + b" ab-cd "] * 4000)], ["key", "text"])
    tracemalloc.start()
    found = sum(len(mentions._Used()(own, part.column(1).to_pylist())[0]) for part in mentions._pieces(b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 4000 and peak < 80e6
