import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

from tessera.llm import decontaminate, sharding, simhash

DOC = "doc_id long, text string, size string, shard string, fp string, key string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "k", "n") for i, t in rows], DOC)


BASE = " ".join(f"word{i}" for i in range(80))
ROWS = [(0, BASE), (1, BASE), (2, BASE.replace("word40", "other")), (3, None), (4, ""), (5, "  \n"), (6, "one two"), (7, "é" * 3000 + " x"), (7, "é" * 3000 + " x"), (None, "ONE Two"), (8, "A b\tc d")]


def test_shards_hold_every_row_once(spark):
    out = sharding.assign(docs(spark, ROWS), 4).collect()
    assert len(out) == len(ROWS)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = {i: len((t or "").encode()) + 8 for i, t in ROWS}
    assert all(r["size"] == sizes[r.doc_id] for r in out)
    assert {r.text_crc32 for r in out} == {zlib.crc32((t or "").encode()) for _, t in ROWS}
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    assert sharding.assign(docs(spark, ROWS).filter("false"), 4).count() == 0


def test_shard_sizes_are_near_the_target(spark):
    df = spark.range(5000).selectExpr("id % 7 doc_id", "repeat('a', cast(id % 97 as int)) text")
    out = sharding.assign(df, 24).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 105


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps, limit=3):
    nodes = sorted(set(fps))
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= limit:
                root[find(a)] = find(b)
    return {f: find(f) for f in nodes}


def test_simhash_against_all_pairs(spark):
    out = simhash.near_groups(docs(spark, ROWS)).collect()
    assert len(out) == len(ROWS)
    fps = {t: slow_fingerprint(t) for _, t in ROWS}
    root = slow_groups(list(fps.values()))
    least = {}
    for i, t in ROWS:
        if i is not None:
            least[root[fps[t]]] = min(i, least.get(root[fps[t]], i))
    want = sorted((str(i), fps[t], least.get(root[fps[t]])) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in out) == want
    assert simhash.near_groups(docs(spark, ROWS).filter("false")).count() == 0


def test_links_match_brute_force_at_every_key_width(spark):
    import random

    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for _ in range(4):
            g = f
            for _ in range(rng.randint(1, 4)):
                g ^= 1 << rng.randrange(64)
            fps.append(g)
    centre = rng.getrandbits(64)
    fps += [centre, *(centre ^ (1 << i) for i in range(64)), *(centre ^ (3 << i) for i in range(62))]  # a bucket above SMALL_BUCKET
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = slow_groups(fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for n, long in ((10, 4096), (10, 8), (1 << 25, 4096), (1 << 25, 2), (1 << 33, 4096), (1 << 33, 1), (1 << 50, 4096)):
        found = simhash.near_links(df, len(fps), simhash.key_width(n), long).collect()
        pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in found]
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = defaultdict(set)
        for f in fps:
            groups[find(f)].add(f)
        slow = defaultdict(set)
        for f in fps:
            slow[want[f]].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_covering_holds_every_choice():
    from itertools import combinations

    for width in (2, 3, 4, 5):
        sets = [set(s) for s in simhash.covering(width)]
        assert all(any(s <= set(w) for s in sets) for w in combinations(range(8), 5))


def slow_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, hit, ids = words(text), set(), set()
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for p in range(len(d) - n + 1):
                if d[p : p + n] == w[s : s + n]:
                    hit |= set(range(p, p + n))
                    ids.add(str(i))
    return len(d), len(hit), sorted(ids)


def test_decontamination_against_all_windows(spark):
    item = " ".join(f"Q{i}" for i in range(14))
    items = [(1, item), (2, "short item"), (10, "the, the the"), (3, None), (4, ""), (5, "!!"), (12, item + " tail"), (12, item)]
    rows = [(0, "x " + item.lower() + " y"), (1, " ".join(f"q{i}" for i in range(2, 12))), (2, " ".join(f"q{i}" for i in range(2, 11))), (3, None), (4, ""), (5, "a short-item! the the the the"), (6, "short"), (7, "item"), (7, "item"), (None, item), (8, "é " * 500 + item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):
        out = decontaminate.contamination(docs(spark, rows), bench, block_bytes=block).collect()
        got = sorted((str(r.doc_id), r.n_words, sum(x.end - x.start for x in r.hits), list(r["items"])) for r in out)
        assert got == sorted((str(i), *slow_hits(t, items)) for i, t in rows)
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, t in rows if not slow_hits(t, items)[1])
    none = bench.filter("false")
    assert all(not r.hits for r in decontaminate.contamination(docs(spark, rows), none).collect())
    assert decontaminate.contamination(docs(spark, rows).filter("false"), bench).count() == 0
    assert hashlib.sha256(b"").hexdigest()[:8] == "e3b0c442"


def test_shards_keep_columns_of_any_name(spark):
    from tessera.llm import sharding

    names = ["_b0", "_first", "_pid", "_rid", "_all", "_n0", "_run", "_pos", "_idx", "_mid", "pid", "rid", "row", "o0", "b0", "n0", "whole", "run", "pos", "idx", "mid", "first", "a.b", "size"]
    df = spark.createDataFrame([(i, "x" * i, *[f"{n}{i}" for n in names]) for i in range(50)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = sharding.shard_by_bytes(df, sharding.text_size("text"), ["doc_id"], 5)
    assert out.columns == [*df.drop("size").columns, "size", "shard", "slot"]
    for r in out.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names if n != "size") and r["size"] == r.doc_id + 8
