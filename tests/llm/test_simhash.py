import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(p, seed=42) for p in pieces]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def closure(pairs):
    """Smallest id per node, by walking the links."""
    out = {}
    for start in sorted({x for p in pairs for x in p}):
        if start in out:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += [b if a == x else a for a, b in pairs if x in (a, b)]
    return out


def brute_groups(rows):
    codes = sorted({brute(t) for _, t in rows})
    near = closure([(a, b) for a in codes for b in codes if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in rows:
        g = near[brute(t)]
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, brute(t), least.get(near[brute(t)])) for i, t in rows), key=str)


def got(df):
    return sorted(((r.id, r.fingerprint & (2**64 - 1), r.component_id) for r in df.collect()), key=str)


EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "É x y"), (8, "é x y"), (9, "a b c d e f g h"),
    (10, "a b c d e f g h"), (10, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "only null id here"), (12, "w " * 30_000),
    (13, "x y z"),
]


def test_groups_against_brute_force(spark, sf):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string")
    assert got(simhash.groups(docs)) == brute_groups(EDGE)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(simhash.groups(spark.read.parquet(f"{sf}/documents.parquet"))) == brute_groups(rows)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op7_simhash(spark, sf).collect())
    assert out == sorted(brute_groups(rows))


def test_keep_one(spark):
    rows = [(*r, "x") for r in EDGE]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len({c if c is not None else (c, f) for _, f, c in brute_groups(EDGE)})
    unique = spark.createDataFrame([r for r in EDGE if r[0] not in (None, 10)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(unique).collect()) == sorted({c for _, _, c in brute_groups([r for r in EDGE if r[0] not in (None, 10)])})
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.keep_one(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 40), st.integers(0, 5), st.integers(0, 3))
def test_index_is_exact(codes, copies, limit, rotation):
    rng = np.random.default_rng(copies)
    codes = set(codes)
    for c in list(codes)[:copies]:
        for _ in range(4):
            codes.add(c ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, limit + 2), replace=False))))
    codes = np.array(sorted(codes), np.uint64)
    index = simhash.GrayIndex(codes, 16)
    found = sorted((int(min(index.codes[a], index.codes[b])), int(max(index.codes[a], index.codes[b]))) for i, j in index.within(limit) for a, b in zip(i, j))
    lead = [int(c) >> 48 for c in codes]
    want = sorted((int(a), int(b)) for x, a in enumerate(codes) for y, b in enumerate(codes) if x < y and lead[x] == lead[y] and (int(a) ^ int(b)).bit_count() <= limit)
    assert found == want


def test_hot_blocks_are_cut(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    codes = {int(b) for b in base}
    for b in base:
        for _ in range(20):
            codes.add(int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    codes |= {5 << 48 | i for i in range(200)}
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    df = spark.createDataFrame(pd.DataFrame({"code": signed}))
    want = closure([(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 3])
    for hot in (16, 10_000):
        pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(df, 3, 64, hot).distinct().collect()]
        assert closure(pairs) == want
