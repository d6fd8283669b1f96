"""License scans: each rule against texts of its own, the query against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import licenses, queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_rules_are_well_formed():
    assert len(licenses.RULES) > 250 and len({(r.label, r.pattern) for r in licenses.RULES}) == len(licenses.RULES)


@settings(max_examples=600, deadline=None)
@given(st.data())
def test_a_match_holds_its_keywords(data):
    """What a rule matches is within reach of its keywords, so the filter loses nothing; and the rule or a better one reports it."""
    rule = data.draw(st.sampled_from(licenses.RULES))
    body = rule.pattern.pattern.decode()[len("(?<![^ ])") : -len("(?![^ ])")].replace("[^ ]+", "[a-z]{2}")
    text = data.draw(st.from_regex(re.compile(body, re.ASCII), fullmatch=True))
    n = len(text.split())
    assert set(w.decode() for w in rule.words) <= set(text.split()) and n < licenses.REACH
    _, found = licenses.scan(f"Lorem, {text.replace(' ', '-').upper()}; ipsum".encode())
    assert any(h.start <= 1 and h.stop >= 1 + n and licenses.RULES[h.rule].priority >= rule.priority for h, *_ in found) or rule.base


CASES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0", 0.9),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0", 0.9),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0", 0.9),
    ("Released under the MIT License.", "mit", 0.9),
    ("All rights reserved.", "rights-reserved", 0.1),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later", 1.0),
    ("SPDX-License-Identifier: GPL-2.0", "gpl-2.0-only", 1.0),
    ("see the GNU Lesser General Public License v2.1 or", "lgpl-2.1", 0.7),
    ("wir fahren mit der Bahn", "", 0.0),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0", 0.8),
    ("gnu general public", "", 0.0),
    ("GPLv3", "gpl-3.0", 0.7),
]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    filler = "lorem ipsum dolor " * 60
    long = ("word " * 200_000) + "GNU General Public License " + ("x" * (3 << 20)) + " cc by " + "tail " * 70 + "MIT license"
    texts = [t for t, *_ in CASES] + [f"{filler} {t} {filler}" for t, *_ in CASES] + [None, "", " .,- ", long, "cc by cc by CC-BY é cc by", "the mit license mit-license", CASES[0][0]]
    rows = [(k, t, 1, "a") for k, t in enumerate(texts)] + [(None, "CC by", 1, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, hits int, base string").write.parquet(f"{folder}/documents.parquet")
    return texts, {r.doc_id: r for r in queries.QUERIES["op13_licenses"](spark, str(folder)).collect()}, folder


def test_labels(found):
    for k, (_, labels, score) in enumerate(CASES):
        for r in (found[1][k], found[1][k + len(CASES)]):
            assert (r.labels, r.score) == (labels, score), CASES[k]


def test_base_places(found):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    assert found[1][None].n_base == 1
    for k, text in enumerate(found[0]):
        ws, r = words(text), found[1][k]
        at = sorted((s, label) for p, label in phrases.items() for s in range(len(ws)) if ws[s : s + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(ws), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_all_rules_without_the_filter(found):
    """Every rule over the whole text, and containment by comparing all pairs, gives the same detections."""
    for text in found[0]:
        flat = " ".join(words(text)).encode()
        hits = []
        for n, rule in enumerate(licenses.RULES):
            hits += [licenses.Hit(n, flat[: m.start()].count(b" "), flat[: m.end()].count(b" ") + 1) for m in rule.pattern.finditer(flat)]
        rank = lambda h: (-licenses.RULES[h.rule].priority, h.rule)
        kept = {h for h in hits if licenses.RULES[h.rule].base or not any(o.start <= h.start and o.stop >= h.stop and rank(o) < rank(h) for o in hits)}
        assert {h for h, *_ in licenses.scan((text or "").encode())[1]} == kept


def test_spans_and_bad_bytes(spark):
    text = b"\xff Released under the MIT\x00License. \xfe"
    n, found = licenses.scan(text)
    assert n == 7 and {text[s:e] for _, s, e in found} == {b"Released under the MIT\x00License", b"MIT\x00License"}
    assert licenses.detections(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    df = spark.range(1).selectExpr("'a' as doc_id", "cast(X'FF204D4954206C6963656E7365' as string) as text")
    (r,) = licenses.detections(df).collect()
    assert r.n_words == 3 and {h.label for h in r.hits} == {"mit"}


@pytest.mark.parametrize("text", ["Licensed under Affero General Public License.", "released under the terms of the GNU Affero General Public License"])
def test_a_grant_of_the_affero_license(text):
    """The rule for a grant takes words with one space between them, as texts are flattened; only a mention was found before."""
    _, found = licenses.scan(text.encode())
    (h,) = [h for h, *_ in found if licenses.RULES[h.rule].label == "agpl"]
    assert h.start == 0 and licenses.RULES[h.rule].priority == 90
