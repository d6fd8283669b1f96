import numpy as np

from tessera.llm import embeddings


def brute(rows, threshold=0.9):
    def bad(v):
        return v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v)

    links = {i: set() for i in range(len(rows))}
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if not bad(a) and not bad(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i].add(j), links[j].add(i)
    out = []
    for i, (k, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            queue += (new := links[queue.pop()] - seen)
            seen |= new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((str(k), len(links[i]), least, k == least))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(k, v, "x", "y") for k, v in rows], "vec_id long, embedding array<float>, n string, block string")


def test_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "TILE", 16)
    base = rng.normal(size=(90, 12))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    for i in range(60):  # near copies of few vectors, with cosines on both sides of the threshold
        rows.append((100 + i, (base[i % 3] + rng.normal(size=12) * 0.3).astype(np.float32).tolist()))
    rows += [(200 + i, rows[0][1]) for i in range(20)]
    rows += [(300, None), (301, []), (302, [0.0] * 12), (303, [1.0, None] + [0.0] * 10), (304, [float("nan")] * 12), (305, [1e30] * 12), (306, [2.0] * 12), (307, [1.0, 1.0]), (308, [2.0, 2.0]), (5, rows[5][1]), (None, [1.0] * 3), (None, None)]
    out = embeddings.near_vectors(table(spark, rows)).collect()
    assert sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out), key=str) == brute(rows)


def test_extreme_magnitudes_link_like_others(spark):
    rows = [(1, [1e-170, 2e-170]), (2, [1.0, 2.0]), (3, [1e200, 2e200]), (4, [5e-324, 0.0]), (5, [1.7e308, 0.0]), (6, [-1.0, 0.0])]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]


def test_far_blocks_do_not_meet(spark):
    F = embeddings.F
    spans = spark.createDataFrame([(0, [-0.9, 0.0], [-0.8, 0.1], 0.5), (1, [-0.7, 0.0], [-0.6, 0.1], 0.7), (2, [0.8, 0.2], [0.9, 0.3], 0.4), (3, [-1.0, -1.0], [1.0, 1.0], 1.0)], "block int, lo array<double>, hi array<double>, rest double")
    met = {(r.first, r.second) for r in embeddings._block_pairs(spans.withColumn("block", F.col("block")), 0.9).collect()}
    assert met == {(0, 0), (0, 1), (1, 1), (2, 2), (0, 3), (1, 3), (2, 3), (3, 3)}


def test_empty(spark):
    assert embeddings.near_vectors(table(spark, [(1, None)]).filter("false")).count() == 0
    assert [r.n_links for r in embeddings.near_vectors(table(spark, [(1, None), (2, None)])).collect()] == [0, 0]
