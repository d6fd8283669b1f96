import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import langid, maxent, mixing, toxicity

DOC = "doc_id long, text string, lang string, source string, c string, n string, held string, words string, topic string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", "c", "n", "h", "w", "t") for i, t, g in rows], DOC)


VOICES = {"aa": ["kana", "mora", "tuki", "sola"], "bb": ["grusch", "pfaff", "stolz", "wucht"], "cc": ["être", "çà", "où", "déjà"]}


def corpus(n=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(VOICES)[i % 3]
        rows.append((i, " ".join(rng.choice(VOICES[lang], 30)) + f" w{i % 50}", lang))
    return rows


EDGES = [(1000, None, "aa"), (1001, "", "aa"), (1002, " \n\t", None), (1003, "KANA mora!" * 5000, None), (1003, "KANA mora!" * 5000, None), (None, "stolz", "bb"), (1005, "12 34 !!", "aa")]


def test_language_model_base_scores_match_brute_force(spark):
    rows = corpus() + EDGES
    out = maxent.score(docs(spark, rows), rounds=2).collect()
    assert len(out) == len(rows)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w := tokens(t)), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    apart = [r for r in out if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)
    assert maxent.score(docs(spark, rows).filter("false")).count() == 0
    none = maxent.score(docs(spark, rows[:2]), held=maxent.F.lit(True), rounds=1).collect()
    assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) for r in none)


def test_language_model_rows_are_small(spark, monkeypatch):
    """A block is dealt over rows of few tokens, whatever its size, which give the sums of one row."""
    rows = [(i, f"{t} x{i % 97}", g) for i, t, g in corpus(60)] + EDGES

    def coded():
        out = maxent.encode(docs(spark, rows).coalesce(1))[0].collect()
        sums = sorted((str(i), h, n, k, round(b, 6), round(w, 6)) for r in out for i, h, n, k, b, w in zip(r.ids, r.held, r.sizes, r.known, r.base, r.within, strict=True))
        tokens = {str(r.ids[k]): maxent.unpacked(r.tokens)[sum(r.sizes[:k]) :][: r.sizes[k]].tolist() for r in out for k in range(len(r.ids))}
        return out, sums, tokens

    whole = coded()
    monkeypatch.setattr(maxent, "ROW_TOKENS", 500, raising=False)
    out, sums, tokens = coded()
    longest = max(max(r.sizes) for r in out)
    assert len(whole[0]) == 1 and len(out) > 5 and all(sum(r.sizes) <= 500 + longest for r in out)
    assert (sums, tokens) == whole[1:]


def test_language_model_scores_match_brute_force(spark, monkeypatch):
    """The score of every text, worked out token by token from the plain definition and the fitted weights."""
    fitted = []
    monkeypatch.setattr(maxent, "train", lambda *a, f=maxent.train: fitted.append(f(*a)) or fitted[-1])
    rng = np.random.default_rng(3)
    many = [(i, " ".join(f"w{k}{'.' * int(k % 3 == 0)}" for k in rng.integers(0, 900, 60)), "aa") for i in range(60)]
    rows = many + [(i, t, g) for i, t, g in corpus(9) + EDGES if i != 1003] + [(2000, "kana once-only kana", "aa"), (2001, None, None)]
    out = maxent.score(docs(spark, rows), rounds=2).collect()
    model, bits = fitted[0], fitted[0].bits
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), " "]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    seen = {w for _, t, _ in rows for w in tokens(t)}
    heads = {w: 2 + k for k, (w, _) in enumerate(sorted(((w, n) for w, n in c.items() if w != " "), key=lambda x: (-x[1], x[0]))[: maxent.HEADS])}

    def shape_of(w):
        stem, half = w.rstrip(maxent.SIGNS), maxent.SHAPES // 2
        return 2 + maxent.HEADS + zlib.crc32(stem[-2:].encode()) % half + half * (stem != w)

    shape = {w: maxent.END if w == " " else heads.get(w, shape_of(w)) for w in seen}
    rare = {w for w in seen if w not in heads and w != " " and c[w] < 2}

    n1, n2 = (sum(1 for w in c if shape[w] >= 2 + maxent.HEADS and c[w] == k) for k in (1, 2))
    unseen = (n1 + 1) / (n1 + 2 * n2 + 2)
    mass = Counter()
    for w, n in c.items():
        if n >= 2:
            mass[shape[w]] += n

    def cell(w):
        return maxent.RARE if w in rare else shape[w]

    def past(w):
        return maxent.END if w == " " else shape[w] if w in rare else maxent.CELLS + zlib.crc32(w.encode()) % ((1 << maxent.HISTORY_BITS) - maxent.CELLS)

    def within(w):
        if w in rare:
            return (1 - unseen) / n1 if c[w] else unseen
        return 1.0 if shape[w] < 2 + maxent.HEADS else c[w] / mass[shape[w]]

    def softmax(z, k):
        return math.exp(z[k]) / sum(math.exp(x) for x in z)

    def bucket(kind, a, b=0):
        return int(maxent._mixed(kind, np.array([a]), np.array([b]), bits)[0])

    def log10_p(words):
        total, before = 0.0, [maxent.END] * 2
        for w in words:
            k, (x, y) = cell(w), before
            z = model.class_bias + sum(model.classes[f].astype(float) for f in (bucket(0, x), bucket(1, x, y), bucket(2, y)))
            q = model.cell_bias[k // 32] + sum(model.cells[f].astype(float) for f in (bucket(4, x, k // 32), bucket(5, y, k // 32)))
            total += math.log10(softmax(z, k // 32) * softmax(q, k % 32) * within(w))
            before = [past(w), x]
        return total

    assert 0 < n1 and any(w in rare and not c[w] for w in seen) and len(heads) == maxent.HEADS and mass
    want = sorted((str(i), round(log10_p(tokens(t)), 2)) for i, t, _ in rows)
    got = sorted((str(r.doc_id), round(r.score, 2)) for r in out)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=0.02)


def test_probabilities_sum_to_one_and_gradients_match_a_loop():
    rng = np.random.default_rng(0)
    shapes = [x.shape for x in maxent._empty(10)]
    model = maxent.Model(*(rng.normal(size=s).astype(np.float32) for s in shapes))
    sizes, words, cell = np.array([2, 1, 40]), rng.integers(0, 90, 43), rng.integers(0, maxent.CELLS, 43)
    past = maxent.pasts(words, sizes)
    assert past[:, :4].tolist() == [[0, words[0], 0, 0], [0, 0, 0, 0]] and past[:, 6].tolist() == words[[5, 4]].tolist()
    a, b = model.probabilities(past, cell)
    x = rng.integers(0, 1 << 32, 1000)
    assert np.array_equal(maxent.unpacked(maxent.packed(x)), x) and maxent.runs(np.array([1, maxent.PIECE, 5, 1])) == [(0, 2), (2, 4)]
    at = np.arange(43)
    assert np.allclose(np.exp(model.log_token(past, cell)), a[at, cell // 32] * b[at, cell % 32])
    assert np.allclose(a.sum(1), 1) and np.allclose(b.sum(1), 1)
    got, want, seen = maxent._empty(10), maxent._empty(10), maxent._empty(10)
    for seed in range(3000):
        maxent.add_expected(got, model, past, cell, np.random.default_rng(seed))
    maxent.add_seen(seen, past, cell, 10)
    for f in maxent.class_features(past, 10):
        for i, k in enumerate(f):
            want[0][k] += a[i]
            want[2][cell[i] // 32] += 1
    for f in maxent.cell_features(past, cell, 10):
        for i, k in enumerate(f):
            want[1][k] += b[i]
    assert np.allclose(got[0] / 3000, want[0], atol=0.06) and np.allclose(got[1] / 3000, want[1], atol=0.06)
    assert seen[0].sum() == 3 * 43 and seen[1].sum() == 2 * 43 and np.allclose(seen[2] * 3, want[2]) and seen[3].sum() == 43


def test_languages_held_out(spark):
    train = docs(spark, corpus())
    model = langid.learn(train)
    fresh = corpus(90, seed=9)
    out = {r.doc_id: r for r in langid.predict(docs(spark, [(i, t, None) for i, t, _ in fresh]), model).collect()}
    assert all(out[i].lang_pred == lang and 0.5 < out[i].score <= 1 for i, _, lang in fresh)
    edges = langid.predict(docs(spark, EDGES), model).collect()
    assert len(edges) == len(EDGES)
    assert {r.doc_id for r in edges if r.lang_pred == "und"} == {1000, 1001, 1002, 1005}
    assert all(r.lang_pred == "aa" for r in edges if r.doc_id == 1003)
    assert langid.learn(train.filter("false")) is None
    assert {r.lang_pred for r in langid.predict(docs(spark, EDGES), None).collect()} == {"und"}
    assert langid.predict(train.filter("false"), model).count() == 0


def test_code_lengths_match_the_trees_walked_byte_by_byte(monkeypatch):
    texts = {"x": [b"abracadabra 12 Abra", b"abra\xc3\xa9"], "y": [b"zzyzx zyzzy"]}
    model = langid.Model({k: langid._tree(*np.unique(langid._codes(v), return_counts=True)) for k, v in texts.items()})
    top = langid.ORDER

    def p(counts, ctx, s):
        """Method C with exclusion, straight from the definition."""
        def row(order):
            if order < 0:
                return [1 / 256] * 256
            below, own = row(order - 1), counts[order].get(tuple(ctx[top - order :]), Counter())
            n, d = sum(own.values()), len(own)
            if not n or (order >= langid.LONG and n < langid.LEAST_COUNT):
                return below
            rest = sum(q for i, q in enumerate(below) if i not in own)
            return [own[i] / (n + d) if i in own else d / (n + d) * q / rest for i, q in enumerate(below)]
        whole = row(top)
        assert sum(whole) == pytest.approx(1)
        return whole[s]

    asked = (b"abracadabra zz", b"", b"cab", b"\xff 12 Abracadabra " * 3)
    for k, lang in enumerate(model.langs):
        counts = [defaultdict(Counter) for _ in range(top + 1)]
        for t in texts[lang]:
            s = b" " * top + t
            for i in range(top, len(s)):
                for order in range(top + 1):
                    counts[order][tuple(s[i - order : i])][s[i]] += 1
        for t in asked:
            s = b" " * top + t
            bits = -sum(math.log2(p(counts, s[i - top : i], s[i])) for i in range(top, len(s)))
            assert model.code_lengths([b"q", t, b"r"])[1][k] == pytest.approx(bits, rel=1e-5, abs=1e-4)
    whole = model.code_lengths([asked[3]])
    monkeypatch.setattr(langid, "CHUNK", 7)  # a text longer than a piece
    assert np.allclose(model.code_lengths([asked[3]]), whole)


def test_lookup_finds_what_was_put():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    asked = np.r_[keys, rng.integers(0, 1 << 40, 5000).astype(np.uint64), np.arange(50, dtype=np.uint64)]
    table, known = langid.Lookup(keys, np.arange(len(keys))), {int(k): i for i, k in enumerate(keys)}
    values, found = table.get(asked)
    assert found.tolist() == [int(k) in known for k in asked] and values.tolist() == [known.get(int(k), 0) for k in asked]
    assert not langid.Lookup(keys[:0], np.zeros(0)).get(asked)[1].any()


def test_language_predictions_match_brute_force(spark):
    """op10's predictions: the language of the shortest code, from counts of the documents that may teach."""
    rows = corpus(60) + [(100, "12 !!", "aa"), (101, None, "bb"), (102, "KANA mora", None), (103, "çà et là", "cc")]
    df = docs(spark, rows)
    out = {r.doc_id: r for r in langid.predict(df, langid.learn(df.filter(~langid.held_out()))).collect()}
    taught = {g: sorted({t.encode() for i, t, x in rows if x == g and t is not None and zlib.crc32(str(i).encode()) % 3 != 1}) for g in VOICES}
    model = langid.Model({g: langid._tree(*np.unique(langid._codes(v), return_counts=True)) for g, v in taught.items()})
    for i, t, _ in rows:
        if i in (100, 101):
            assert (out[i].lang_pred, out[i].score) == ("und", 0)
            continue
        bits = model.code_lengths([t.encode()])[0]
        assert out[i].lang_pred == model.langs[int(bits.argmin())] and out[i].score == pytest.approx(1 / sum(2 ** (min(bits) - b) for b in bits), rel=1e-4)


def test_ordinal_regression(spark):
    rng = np.random.default_rng(2)
    bad = ["vile", "rotten", "foul", "nasty"]
    rows, labels = [], []
    for i in range(400):
        n = int(rng.integers(0, 4)) if i % 2 else 0
        rows.append((i, " ".join([*rng.choice(VOICES["aa"], 40), *rng.choice(bad, n, replace=False)]), "aa"))
        labels.append((i, int(n > 0), n, 1))
    df = docs(spark, rows + EDGES)
    frame = spark.createDataFrame(labels + [(1, None, None, 1), (None, 1, 1, 1)], "doc_id long, toxic int, grade int, quality int")
    for known in (frame.drop("grade"), frame):
        model = toxicity.learn(df, known)
        assert (np.diff(model.thresholds) > 0).all()
        out = {r.doc_id: r for r in toxicity.severity(df, model).collect()}
        right = sum(out[i].rejected == bool(y) for i, y, _, _ in labels)
        assert right >= 0.97 * len(labels)
        assert not any(out[i].rejected for i in (None, 1000, 1001, 1002, 1003, 1005))
        mean = [np.mean([out[i].severity for i, _, g, _ in labels if g == k]) for k in range(4)]
        assert mean == sorted(mean)
        kept = toxicity.drop_toxic(df, model)
        assert kept.columns == df.columns and kept.count() == sum(not r.rejected for r in toxicity.severity(df, model).collect())
    assert toxicity.severity(df.filter("false"), model).count() == 0
    empty = toxicity.learn(df, frame.filter("false"))
    assert not any(r.rejected for r in toxicity.severity(df, empty).collect())


def test_gradient_of_the_cumulative_link():
    rows = [(0, [0]), (1, [0]), (2, [0]), (0, [0, 1]), (2, [0, 1]), (2, [1]), (1, [1]), (0, [1]), (0, []), (1, []), (2, [1, 2]), (0, [2]), (1, [2])] * 20
    w, cuts = toxicity.fit(rows, 3, 2)

    def loss(w, cuts):
        total = 0.0
        for y, x in rows:
            eta = sum(w[i] for i in x)
            above = [1, *(1 / (1 + math.exp(c - eta)) for c in cuts), 0]
            total += math.log(above[y] - above[y + 1])
        return total / len(rows) - toxicity.RIDGE / 2 * sum(x * x for x in w)

    best = loss(w, cuts)
    for i in range(3):
        for d in (-0.05, 0.05):
            assert loss([x + d * (k == i) for k, x in enumerate(w)], cuts) <= best + 1e-6
    for i in range(2):
        for d in (-0.05, 0.05):
            assert loss(w, [x + d * (k == i) for k, x in enumerate(cuts)]) <= best + 1e-6


def test_raking_reaches_all_margins():
    rng = np.random.default_rng(4)
    cells = {(a, b, c): float(rng.integers(1, 1000)) for a in "xyz" for b in "pq" for c in "mn"}
    targets = [{"x": 0.2, "y": 0.3, "z": 0.5}, {"p": 0.7, "q": 0.3}, {"m": 0.5, "n": 0.5}]
    w = mixing.rake(cells, targets)
    total = sum(w[c] * t for c, t in cells.items())
    for m, target in enumerate(targets):
        for k, share in target.items():
            assert sum(w[c] * t for c, t in cells.items() if c[m] == k) / total == pytest.approx(share, abs=1e-6)


def n_words():
    return mixing.F.coalesce(mixing.F.regexp_count("text", mixing.F.lit(r"[^\x20\x09-\x0D]+")), mixing.F.lit(0))


def test_mixing_on_tables(spark):
    rows = [(i, "a b c " * (1 + i % 5) + ("| " * 20 if i % 7 == 0 else ""), ["aa", "bb", None][i // 3 % 3]) for i in range(3000)] + EDGES
    df = docs(spark, rows).withColumn("source", mixing.F.when(mixing.F.col("doc_id") % 3 == 0, "hot").otherwise(mixing.F.concat(mixing.F.lit("s"), mixing.F.col("doc_id") % 5)))
    margins = {"source": mixing.F.col("source"), "lang": mixing.F.col("lang")}
    small = mixing.calibrated(df, margins, n_words()).toPandas()
    large = mixing.calibrated(df, margins, n_words(), max_cells=2).toPandas()
    assert len(small) == len(large) == len(rows) and 0 < small.p_keep.max() <= 1
    a = small.assign(source=small.source.fillna("")).groupby("source").apply(lambda g: (g.p_keep * g.n_tokens).sum(), include_groups=False)
    t = small.assign(source=small.source.fillna("")).groupby("source").n_tokens.sum() ** 0.9
    assert np.allclose(a / a.sum(), t / t.sum(), atol=1e-3)
    one, two = (x.sort_values(["doc_id", "text"], na_position="first").p_keep.to_numpy() for x in (small, large))
    assert np.allclose(one, two, rtol=1e-9, atol=1e-9)
    assert small.n.tolist() == ["n"] * len(rows) and large.n.tolist() == ["n"] * len(rows)
    kept = mixing.sample(df)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows)
    assert mixing.sample(df.filter("false")).count() == 0 and mixing.probabilities(df.drop("topic").filter("false")).count() == 0
    silent = df.filter("text is null or text = ''")
    for n in (100, 0):
        assert {r.p_keep for r in mixing.calibrated(silent, margins, n_words(), max_cells=n).collect()} == {1.0}


def test_probabilities_match_brute_force(spark):
    """op9's query: words, topics by the fitted centres, raking by plain loops, and the draw by the hash."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(VOICES["aa"] if i % 4 else ["|", "#", "x"], int(rng.integers(0, 30)))), ["aa", "bb", None][i % 3]) for i in range(300)] + EDGES
    df = docs(spark, rows).drop("topic").withColumn("source", mixing.F.when(mixing.F.col("doc_id") % 3 == 0, "hot").otherwise(mixing.F.concat(mixing.F.lit("s"), mixing.F.col("doc_id") % 5)))
    out = mixing.probabilities(df)
    assert out.columns == ["doc_id", "source", "lang", "topic", "n_tokens", "p_keep", "kept"]
    found = out.collect()
    words = sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == words and len({r.topic for r in found}) > 1
    cell = [tuple(x or "" for x in (r.source, r.lang, r.topic)) for r in found]
    tokens = Counter()
    for c, r in zip(cell, found, strict=True):
        tokens[c] += r.n_tokens
    w = {c: 1.0 for c, t in tokens.items() if t}
    aims = []
    for m in range(3):
        shares = Counter()
        for c in w:
            shares[c[m]] += tokens[c]
        aims.append({k: v**0.9 / sum(x**0.9 for x in shares.values()) for k, v in shares.items()})
    for _ in range(500):
        for m, aim in enumerate(aims):
            now = Counter()
            for c in w:
                now[c[m]] += w[c] * tokens[c]
            w = {c: x * sum(tokens.values()) * aim[c[m]] / now[c[m]] for c, x in w.items()}
    top = max(w.values())
    assert np.allclose([r.p_keep for r in found], [w.get(c, 0.0) / top for c in cell], atol=1e-6)
    draw = {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", mixing.unit_hash("doc_id", "text")).collect()}
    kept = {(r.doc_id, r.text) for r in mixing.sample(df).collect()}
    assert len(kept) and {(i, u < next(r.p_keep for r in found if r.doc_id == i)) for (i, _), u in draw.items() if i is not None} == {(i, (i, t) in kept) for (i, t) in draw if i is not None}
    again = {r.doc_id: r.topic for r in mixing.probabilities(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.topic for r in found}


def test_copies_do_not_crowd_out_a_language(spark):
    rows = [(i, "kana mora tuki sola", "aa") for i in range(400)] + [(1000 + i, " ".join(np.random.default_rng(i).choice(VOICES["bb"], 6)), "bb") for i in range(40)]
    rows += [(2000 + i, "sola tuki", "aa") for i in range(5)]
    df = docs(spark, rows)
    some = langid.learn(df, docs_per_language=3)
    assert some.langs == ["aa", "bb"]
    once = docs(spark, [(0, "kana mora tuki sola", "aa"), (1, "sola tuki", "aa"), *rows[400:440]])
    same = langid.learn(once, docs_per_language=3)
    assert all(np.array_equal(x, y) for g in some.langs for a, b in zip(some.trees[g], same.trees[g], strict=True) for x, y in zip(a, b, strict=True))


def test_factors_and_joined_sums_rake_alike(spark, monkeypatch):
    rows = [("p", "x", 900.0), ("p", "y", 1.0), ("q", "x", 1.0), ("q", "y", 30.0), ("q", "z", 2.0), ("r", "z", 4.0)]
    cells = spark.createDataFrame(rows, "m0 string, m1 string, tokens double").repartition(3)
    targets = [spark.createDataFrame(t, f"m{m} string, share double") for m, t in enumerate([[("p", 0.7), ("q", 0.2), ("none", 0.1)], [("x", 0.6), ("y", 0.3), ("z", 0.1)]])]
    found = []
    for most in (100, 5):
        monkeypatch.setattr(mixing, "MAX_CATEGORIES", most)
        found.append({(r.m0, r.m1): r.w for r in mixing._rake_table(cells, ["m0", "m1"], targets, 4).collect()})
    assert len(found[0]) == 6 and found[0] == pytest.approx(found[1]) and found[0]["r", "z"] == 0
    aims = [{"p": 0.7, "q": 0.2, "none": 0.1}, {"x": 0.6, "y": 0.3, "z": 0.1}]
    assert found[0] == pytest.approx(mixing.rake({r[:2]: r[2] for r in rows}, aims, 4))


def test_both_rakings_agree_where_they_converge_slowly(spark):
    rows = [(0, "a " * 900, "x"), (1, "a", "y"), (2, "a", "x"), (3, "a " * 30, "y"), (4, " ", "z"), (5, "a a", "z"), (6, "", "y")]
    df = docs(spark, rows).withColumn("source", mixing.F.when(mixing.F.col("doc_id").isin(0, 1, 4), "p").when(mixing.F.col("doc_id") == 6, "r").otherwise("q"))
    margins = {"source": mixing.F.col("source"), "lang": mixing.F.col("lang")}
    targets = {"source": {"p": 0.8, "q": 0.2}, "lang": {"x": 0.68, "y": 0.28, "z": 0.04}}
    found = [{r.doc_id: r.p_keep for r in mixing.calibrated(d, margins, n_words(), targets, max_cells=n).collect()} for d in (df, df.filter("doc_id in (4, 6)")) for n in (100, 1)]
    assert found[0] == pytest.approx(found[1], rel=1e-8, abs=1e-12) and found[2] == found[3] == {4: 1.0, 6: 1.0}
    assert [found[1][i] for i in (4, 6)] == [0.0] * 2
    cells = {("p", "x"): 900.0, ("p", "y"): 1.0, ("q", "x"): 1.0, ("q", "y"): 30.0, ("q", "z"): 2.0}
    early, late = (mixing.rake(cells, list(targets.values()), k) for k in (25, 500))
    assert early != pytest.approx(late, rel=1e-6)


def test_texts_that_are_not_utf8_are_scored(spark):
    df = docs(spark, [(i, f"kana mora w{i % 7}", "aa") for i in range(60)])
    bad = spark.range(1).selectExpr("1000L as doc_id", "cast(X'FF20FE6B616E61' as string) as text")
    bad = bad.withColumns({c: mixing.F.lit(None).cast(df.schema[c].dataType) for c in df.columns if c not in bad.columns}).select(df.columns)
    from tessera.llm import maxent

    found = {r.doc_id: r for r in maxent.score(df.unionByName(bad)).collect()}
    assert len(found) == 61 and found[1000].n_tokens == 3 and found[1000].score < 0
