from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideframe.llm import mixing

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    for b in BLANKS[1:]:
        text = (text or "").replace(b, " ")
    return len([w for w in text.split(" ") if w])


def plain_targets(sizes):
    """Share, cap, reshare: one source after another until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        rest = total - sum(3 * sizes[s] for s in capped)
        goal = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        above = {s for s in order if goal[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not above:
            return goal
        capped |= above


def checked(df, rows):
    """The result's rows, held against sizes, targets and limits computed apart."""
    got = df.collect()
    assert Counter((r.id, r.source, r.size) for r in got) == Counter((i, s, words(t)) for i, t, s in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    goal, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        ratio = goal[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.copies in (int(ratio + 1e-9), int(np.ceil(ratio - 1e-9)))
        taken[r.source] += r.taken
    return goal, taken


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        s = ["hot", "a", "b", "é", None][rng.choice(5, p=[0.5, 0.2, 0.1, 0.1, 0.1])]
        out.append((i, "w " * int(rng.lognormal(3, 1)), s))
    return out


def test_balance_in_groups_and_lanes(spark):
    rows = corpus(1, 3_000) + [(5_000 + i, "same text here", "copies") for i in range(700)] + [(9_999, "x y", "one row")] * 450 + [(6_000, "w " * 30_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(docs, group=128, reserve=64)
    goal, taken = checked(first, rows)
    for s, want in goal.items():
        largest = 30_000 if s == "b" else 0
        assert abs(taken[s] - want) <= max(0.01 * want, 3, largest)
    again = mixing.mix(docs.repartition(7, F.rand(3)).orderBy("text"), group=128, reserve=64)
    assert Counter(tuple(r) for r in again.collect()) == Counter(tuple(r) for r in first.collect())


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\r\n", "b"), (None, "one two", "b"), (None, "one two", "b"), (4, "one\x0btwo\x0cthree é\xa0x", None), (5, "w " * 200_000, "c"), (6, "a b", "d")]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, source string, size int, target int, `_x.h` string")
    checked(mixing.mix(docs), rows)
    empty = spark.createDataFrame([], "doc_id string, text string, source string")
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(none).collect()] == [(0.0, 0), (0.0, 0)]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = mixing.op12_mixing(spark, sf)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    source = {i: s for i, _, s in docs}
    total, goal = Counter(), {}
    for r in got.collect():
        total[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + words(t)
    assert goal == pytest.approx(plain_targets(sizes))
    for s in goal:
        assert abs(total[s] - goal[s]) <= 0.05 * goal[s]


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.sampled_from([*"abcdefgh", None]), st.integers(0, 500), min_size=1), st.randoms())
def test_targets(spark, sizes, _):
    df = spark.createDataFrame([*sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes), abs=1e-6)


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(4)
    size = rng.lognormal(0, 1, 300)
    a = np.stack([size, np.ones(300)], axis=1)
    p = rng.uniform(0.05, 0.95, 300)
    mean = np.zeros(300)
    for _ in range(200):
        q = mixing.flight(p, a, rng)
        assert ((q > 0) & (q < 1)).sum() <= 2 and np.allclose(q @ a, p @ a)
        mean += q / 200
    assert np.abs(mean - p).mean() < 0.04 and np.abs(mean - p).max() < 0.2
    down = np.argsort(-size)
    q = mixing.landing(p[down], a[down], rng)
    assert set(q) <= {0.0, 1.0} and abs((q - p[down]) @ size[down]) < 0.01 * (p @ size)
