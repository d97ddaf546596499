import math

import numpy as np

from tideframe.llm import embeddings

NAN, INF = float("nan"), float("inf")


def brute(rows, least=0.95):
    """n_links and component per row, by all cosines."""
    good = [i for i, (_, x) in enumerate(rows) if x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    links = {i: set() for i in range(len(rows))}
    for size in {len(rows[i][1]) for i in good}:
        part = [i for i in good if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in part], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                links[part[a]].add(part[b])
    out, seen = [], {}
    for i in range(len(rows)):
        todo, group = [i], set()
        while todo:
            k = todo.pop()
            if k not in group:
                group.add(k)
                todo += links[k]
        out.append((rows[i][0], len(links[i]), min((rows[k][0] for k in group if rows[k][0] is not None), default=None)))
    del seen
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, x, "x") for i, x in rows], "vec_id long, embedding array<float>, x string")
    return sorted(((r.id, r.n_links, r.component_id) for r in embeddings.near(df, **more).collect()), key=str)


def test_edges(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [NAN, 1.0, 0.0]), (6, [INF, 1.0, 0.0]), (9, [1.0, 2.0, 3.0]),
        (8, [2.0, 4.0, 6.0]), (7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (10, [-1.0, -2.0, -3.0]), (None, [1.0, 0.0, 0.0]), (None, [1.0, 0.1, 0.0]),
        (11, [1.0, 2.0]), (12, [1.0, 2.0]), (13, [0.0, -0.0, 5.0]), (14, [-0.0, 0.0, 5.0]),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def cloud(n, copies, d, seed, spread):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    more = base[rng.integers(0, n // 10, copies)]
    more = more + rng.normal(size=more.shape) * spread * np.linalg.norm(more, axis=1, keepdims=True) / np.sqrt(d)
    return [(i, [float(v) for v in x]) for i, x in enumerate(np.vstack([base, more, base[:50]]).astype(np.float32))]


def test_full_reach_is_exact(spark):
    rows = cloud(400, 300, 16, 1, 0.3)
    assert run(spark, rows, reach=1.0) == brute(rows)


def test_hot_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_MEMBERS", 40)
    monkeypatch.setattr(embeddings, "BLOCK_QUERIES", 60)
    rows = cloud(100, 300, 16, 2, 0.2)
    assert run(spark, rows, reach=1.0) == brute(rows)


def test_recall(spark):
    rows = cloud(1500, 600, 64, 3, 0.31)  # cosines around the limit
    want, got = brute(rows), run(spark, rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 500 and 0.98 * there <= found <= there


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.op6_embeddings(spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_links_across_borders_are_found(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(2500, 6)).astype(np.float32))]
    assert run(spark, rows) == brute(rows)
