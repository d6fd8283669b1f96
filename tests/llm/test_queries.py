"""Each registered query is called itself, on small tables, and held against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_groups_and_shards import slow_fingerprint, slow_groups

from tessera.llm import queries, toxicity

BAD = ["vile", "rotten", "foul", "nasty"]
GOOD = ["kana", "mora", "tuki", "sola", "grusch", "pfaff", "stolz", "wucht"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(8)
    rows, labels = [], []
    for i in range(120):
        half = GOOD[:4] if i % 2 else GOOD[4:]
        bad = list(rng.choice(BAD, 2, replace=False)) if i % 5 == 0 else []
        rows.append((i, " ".join([*rng.choice(half, 25), *bad, f"w{i}"]), ["aa", "bb"][i % 2], f"s{i % 3}", 0))
        labels.append((i, 1, int(bool(bad))))
    rows += [(200, None, "aa", None, 0), (201, "", None, "s0", 0), (202, rows[3][1], "aa", "s0", 0), (203, rows[4][1].upper(), "bb", "s0", 0), (204, "12 %%", "aa", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def run(spark, tables, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, tables[0]).collect()}


def test_op2(spark, tables):
    out = run(spark, tables, "op2_lm_score")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for i, t, *_ in tables[1]}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert set(out) == set(tokens)
    for i, r in out.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(w in c for w in tokens[i]), n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0 and math.isfinite(r.score)


def test_op5(spark, tables):
    out = run(spark, tables, "op5_simhash")
    fps = {i: slow_fingerprint(t) for i, t, *_ in tables[1]}
    root = slow_groups(list(fps.values()))
    for i, r in out.items():
        assert r.fingerprint == f"{fps[i]:016x}" and r.component_id == min(j for j in fps if root[fps[j]] == root[fps[i]])
    assert out[202].component_id == 3 and out[203].component_id == 4 and out[201].component_id == 200


def test_op8(spark, tables, monkeypatch):
    fitted = []
    monkeypatch.setattr(toxicity, "learn", lambda *a, f=toxicity.learn: fitted.append(f(*a)) or fitted[0])
    out = run(spark, tables, "op8_toxicity")
    model = fitted[0]
    assert set(out) == {r[0] for r in tables[1]} and model.basis == "features"
    for i, t, *_ in tables[1]:
        words = set(re.findall(r"[0-9a-z]+", (t or "").lower()))
        own = set(words)
        for n in (4, 5, 6):
            own |= {f"{p}*" for p, k in Counter(w[:n] for w in words if len(w) > n).items() if k >= 2}
        eta = sum(w for f, w in model.weights.items() if f in own)
        above = [1 / (1 + math.exp(c - eta)) for c in model.thresholds]
        each = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
        r = out[i]
        assert r.p_toxic == pytest.approx(above[0]) and r.severity == pytest.approx(sum(above)) and r.grade == max(range(len(each)), key=each.__getitem__)
        assert r.rejected == (above[0] >= 0.5 and bool(t and t.strip()))
        assert r.rejected == any(b in words for b in BAD)


def test_labels_of_one_kind_reject_nothing(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    labels = spark.read.parquet(f"{tables[0]}/labels.parquet")
    for toxic in (0, 1):
        model = toxicity.learn(docs, labels.filter(f"toxic = {toxic}"))
        assert model.basis == "none" and not any(r.rejected for r in toxicity.severity(docs, model).collect())


def test_op9(spark, tables):
    out = run(spark, tables, "op9_mixing")
    assert set(out) == {r[0] for r in tables[1]} and all(0 <= r.p_keep <= 1 for r in out.values())
    assert {i for i, r in out.items() if not r.p_keep} == {i for i, r in out.items() if not r.n_tokens and r.p_keep == 0}
    tokens, weighted = Counter(), Counter()
    for r in out.values():
        tokens[r.source or ""] += r.n_tokens
        weighted[r.source or ""] += r.n_tokens * r.p_keep
    aim = {k: v**0.9 for k, v in tokens.items() if v}
    for k, v in aim.items():
        assert weighted[k] / sum(weighted.values()) == pytest.approx(v / sum(aim.values()), abs=0.02)


def test_op10(spark, tables):
    out = run(spark, tables, "op10_langid")
    for i, t, g, *_ in tables[1]:
        r = out[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred == ("und" if not re.search("[a-zA-Z]", t or "") else g if i < 200 else r.lang_pred)
