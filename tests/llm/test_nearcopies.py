import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tessera.llm import components, nearcopies, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def slow_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), least.get(find(k))) for k, (i, _) in enumerate(rows))


def test_near_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "LONG_LIST", 9)  # some posting lists are long ones
    rng = random.Random(3)
    rows, line = [], " ".join(f"licence{k}" for k in range(30))
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = f"z{rng.randrange(999)}"
            rows.append((len(rows), " ".join(text) + (" " + line if g % 2 else "")))
    rows += [(1000, None), (1001, " \n"), (1002, "one two"), (1003, "ONE  two"), (1004, rows[0][1]), (None, rows[5][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    got = sorted((str(r.doc_id), r.component_id) for r in nearcopies.near_groups(df).collect())
    assert got == slow_groups(rows)
    assert nearcopies.near_groups(df.filter("false")).count() == 0
    kept = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted({c for i, c in got if i != "None"})


def test_similar_sets_share_the_needed_prefix():
    """Sets at the threshold, whose prefixes share as few shingles as they can."""
    rng, law = random.Random(9), nearcopies._Law(80)
    for _ in range(300):
        whole = rng.sample(range(400), 60 + rng.randrange(60))
        both = whole[: int(len(whole) * rng.uniform(0.78, 1))]
        only = [x for x in whole if x not in both]
        cut = rng.randrange(len(only) + 1)
        a, b = sorted(both + only[:cut]), sorted(both + only[cut:])
        if 5 * len(both) >= 4 * len(whole):
            shared = set(a[: nearcopies.prefix_size(len(a))]) & set(b[: nearcopies.prefix_size(len(b))])
            n, m = len(a), len(b)
            least = -(-80 * (n + m) // 180)
            assert len(shared) >= max(1, min(least + 1 - -(-80 * n // 100), least + 1 - -(-80 * m // 100)))
            assert law.share(np.array([n]), np.array([m]))[0] == max(1, min(least + 1 - -(-80 * n // 100), least + 1 - -(-80 * m // 100)))
            first = min(set(a) & set(b))
            left = min(n - a.index(first), m - b.index(first))
            assert 180 * left >= 80 * (n + m)  # they meet at the first shingle that both have
            small = min((a, b), key=len)
            assert 180 * (len(small) - small.index(first)) >= 160 * len(small)


def family(n, shared, own, seed, versions=1):
    """Texts from one template, each with words of its own at the end."""
    rng = random.Random(seed)
    base = [f"t{seed}x{k}" for k in range(shared)]
    return [" ".join([*base, *(f"o{seed}x{rng.randrange(10**9)}" for _ in range(own)), *(["v%d" % (i % versions)] if versions > 1 else [])]) for i in range(n)]


def test_families_of_a_template(spark, monkeypatch):
    """Families that link to a hub, in chains, or not at all, among others; also where the sample doesn't know their shingles."""
    monkeypatch.setattr(nearcopies, "SHORT_LIST", 4)
    rng, texts = random.Random(4), [*family(60, 30, 4, 1), *family(60, 30, 3, 2), *family(50, 25, 4, 3, versions=5)]
    for g in range(3):  # two versions, each with near copies: one hub can't serve both
        a = [f"g{g}a{k}" for k in range(120)]
        b = a[:85] + [f"g{g}b{k}" for k in range(35)]
        for whole in (a, b):
            for _ in range(25):
                text = list(whole)
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**9)}"
                texts.append(" ".join(text))
    rows = list(enumerate(texts))
    for listed in (nearcopies.COMMON, 10**6):
        monkeypatch.setattr(nearcopies, "COMMON", listed)
        got = sorted((str(r.doc_id), r.component_id) for r in nearcopies.near_groups(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)).collect())
        assert got == slow_groups(rows)


def test_a_family_that_does_not_link_gives_no_pairs(spark, monkeypatch):
    """Texts of a template give a few candidates each, not one for each other text, also where the sample doesn't know their shingles."""
    pairs = []
    monkeypatch.setattr(nearcopies, "_plausible", lambda found, *a, f=nearcopies._plausible: pairs.append(found.count()) or f(found, *a))
    monkeypatch.setattr(nearcopies, "COMMON", 10**6)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(family(400, 30, 4, 7))], DOC)
    assert len({r.component_id for r in nearcopies.near_groups(df).collect()}) == 400
    assert sum(pairs) < 40 * 400


def test_sketches_lose_no_pair():
    """Sketches differ in no more bits than sets in members, so no similar pair is ruled out; sets far apart are."""
    rng, law = np.random.default_rng(5), nearcopies._Law(80)
    for n in (1, 30, 200, 9000):
        whole = rng.integers(0, 1 << 63, 2 * n, np.int64).astype(np.uint64)
        for cut in {0, n // 20, n // 10, n // 9, n // 5, n}:
            a, b = np.unique(whole[:n]), np.unique(whole[cut : n + cut])
            bits = [np.frombuffer(nearcopies.sketch(x), np.uint8) for x in (a, b)]
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum()
            assert differ <= len(np.setxor1d(a, b))
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                assert law.near(differ, len(a), len(b))
            elif n == 200 and cut == n:
                assert not law.near(differ, len(a), len(b))


def test_pairs_of_lists_in_batches():
    """Lists that go over several batches, and blocks of a long one, give the pairs of a plain loop."""
    rng, law, rows = np.random.default_rng(6), nearcopies._Law(80), []
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(30)]
    for key, lo, hi in [(1, 0, 0), (2, 0, 1), (3, 0, 0), (9, 1, 1)]:
        for node in rng.choice(30, 12 if key != 3 else 1, replace=False).tolist():
            rows.append((key, lo, hi, node % 2 if hi > lo else lo, node, len(sets[node]), len(sets[node]) - int(rng.integers(0, 4)), node % 7, nearcopies.sketch(sets[node])))
    want = set()
    for x in rows:
        for y in rows:
            shared = np.bitwise_count(np.frombuffer(x[8], np.uint8) ^ np.frombuffer(y[8], np.uint8)).sum()
            if x[:3] == y[:3] and x[4] < y[4] and x[7] != y[7] and (x[1] == x[2] or x[3] != y[3]) and 180 * min(x[6], y[6]) >= 80 * (x[5] + y[5]) and 180 * shared <= 20 * (x[5] + y[5]):
                want.add((x[4], y[4]))
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], ["key", "lo", "hi", "own", "node", "size", "left", "root", "sketch"])
    for size in (1, 5, 100):
        got = pa.Table.from_batches(nearcopies._near_pairs(table.to_batches(size), law), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        assert set(zip(*(got.column(k).to_pylist() for k in (0, 1)), strict=True)) == want
    assert not list(nearcopies._near_pairs(table.slice(0, 0).to_batches(), law))


def test_near_fingerprints_are_candidates(spark, monkeypatch):
    """The SimHash index finds near copies of long texts, and its pairs are among those that are verified."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base, "more"]), *family(3, 5, 60, 11)]
    tried = []
    monkeypatch.setattr(nearcopies, "_simhash_pairs", lambda groups, f=nearcopies._simhash_pairs: tried.extend((found := f(groups)).collect()) or found)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: (r.node, r.component_id) for r in nearcopies.near_groups(df).collect()}
    near = {got[i][0] for i in range(3)}
    assert len(tried) >= 2 and {x for r in tried for x in (r.a, r.b)} == near
    assert [got[i][1] for i in range(6)] == [0, 0, 0, 3, 4, 5]


def test_a_family_just_below_the_threshold_gives_few_pairs(spark, monkeypatch):
    """Texts that lack and add words at different places share most of their shingles, but aren't paired one with each other."""
    rng, chosen = random.Random(12), []
    for _ in range(20_000):
        spots = set(rng.sample(range(36), 3))
        if len(chosen) < 110 and all(len(spots & x) < 2 for x in chosen):
            chosen.append(spots)
    texts = []
    for spots in chosen:
        text = [f"b{k}" for k in range(184)]
        for s in spots:
            text[4 + 5 * s] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(text))
    rows, pairs = list(enumerate(texts)), []
    monkeypatch.setattr(nearcopies, "_plausible", lambda found, *a, f=nearcopies._plausible: pairs.append(found.count()) or f(found, *a))
    got = sorted((str(r.doc_id), r.component_id) for r in nearcopies.near_groups(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)).collect())
    assert got == slow_groups(rows) and len({c for _, c in got}) == len(rows)
    assert sum(pairs) < 10 * len(rows)


def test_a_family_is_joined_by_its_nearest(spark, monkeypatch):
    """A large family that is linked in chains is joined by the nearest of each text: few pairs are verified, and its lists are opened once more only."""
    rng = random.Random(21)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for _ in range(90):  # two places of each text differ: those with a place in common are near copies
        text = list(base)
        for k in rng.sample(range(4, 150, 5), 2):
            text[k] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(text))
    rows, opened, pairs = list(enumerate(texts)), [], []
    monkeypatch.setattr(nearcopies, "_open", lambda posts, *a, f=nearcopies._open: opened.append(posts.count()) or f(posts, *a))
    monkeypatch.setattr(nearcopies, "_plausible", lambda found, *a, f=nearcopies._plausible: pairs.append(found.count()) or f(found, *a))
    monkeypatch.setattr(nearcopies, "SHORT_LIST", 8)
    monkeypatch.setattr(nearcopies, "PAIRS_A_SET", 2)
    got = sorted((str(r.doc_id), r.component_id) for r in nearcopies.near_groups(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)).collect())
    assert got == slow_groups(rows) and len({c for _, c in got}) == 1
    assert len(opened) <= 3 and sum(pairs) < 4 * len(rows), (opened, pairs)


def test_nearest_pairs_of_lists():
    """With nearest, a list gives each set's nearest of another component, and no more; pairs that are sent in parts are the same."""
    rng, law = np.random.default_rng(7), nearcopies._Law(80)
    base = rng.integers(0, 1 << 63, 60, np.int64).astype(np.uint64)
    sets = [np.unique(np.r_[base[: 60 - k % 6], rng.integers(0, 1 << 63, k % 4, np.int64).astype(np.uint64)]) for k in range(40)]
    rows = [(1, 0, 0, 0, k, len(x), len(x), k % 3, nearcopies.sketch(x)) for k, x in enumerate(sets)]
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], ["key", "lo", "hi", "own", "node", "size", "left", "root", "sketch"])
    differ = lambda a, b: int(np.bitwise_count(np.frombuffer(rows[a][8], np.uint8) ^ np.frombuffer(rows[b][8], np.uint8)).sum())
    near = {(a, b): differ(a, b) for a in range(40) for b in range(40) if a % 3 != b % 3 and 180 * differ(a, b) <= 20 * (len(sets[a]) + len(sets[b]))}
    got = [tuple(x) for b in nearcopies._near_pairs(table.to_batches(), law, True) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(got) <= 40 and set(got) <= set(near)
    for k in range(40):
        least = min((v for (a, _), v in near.items() if a == k), default=None)
        assert least is None or any(k in pair and near[pair] == least for pair in got)
    whole = [set(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in nearcopies._near_pairs(table.to_batches(), law)]
    was, nearcopies.PAIRS_AT_ONCE = nearcopies.PAIRS_AT_ONCE, 50
    try:
        parts = [set(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in nearcopies._near_pairs(table.to_batches(), law)]
    finally:
        nearcopies.PAIRS_AT_ONCE = was
    assert len(parts) > 1 == len(whole) and set().union(*parts) == whole[0] == {p for p in near if p[0] < p[1]}


def test_no_plan_is_large(spark, monkeypatch):
    """Spark's driver keeps a plan whole and rewrites it after each stage: no table that is written takes more than a few shuffles and broadcasts."""
    plans = []

    def seen(df, label, f=nearcopies.materialise, **options):
        plans.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange "), label))
        return f(df, label, **options)

    for module in (nearcopies, components, simhash):
        monkeypatch.setattr(module, "materialise", seen)
    monkeypatch.setattr(nearcopies, "SHORT_LIST", 8)
    texts = [*family(40, 40, 2, 5), *family(30, 30, 4, 6)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    assert len({r.component_id for r in nearcopies.near_groups(df).collect()}) == 31
    assert {"edges", "posts", "hubs", "pairs"} <= {label for _, label in plans}
    assert max(plans)[0] <= 13, sorted(plans)[-5:]


def test_components_stop_at_stars(spark, monkeypatch):
    """Edges that are stars around their smallest nodes take no round, chains as many as they need, with the roots of a plain search."""
    steps = []
    monkeypatch.setattr(components, "_star", lambda *a, f=components._star: steps.append(a[1]) or f(*a))
    rng = random.Random(2)
    stars = [(1, 9), (8, 1), (1, 5), (20, 30), (30, 20), (7, 7), (None, 3)]
    loose = [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(k, k + 1) for k in range(200, 240)]
    for edges in (stars, [], loose, [(2, 3), (1, 3)]):
        steps.clear()
        root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
        for _ in root:
            for a, b in edges:
                if a in root and b in root:
                    root[a] = root[b] = min(root[a], root[b])
        got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
        assert len(got) == len(root) and {r.node: r.root for r in got} == root
        assert bool(steps) == (edges in (loose, [(2, 3), (1, 3)]))
