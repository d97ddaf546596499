import math
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import decontaminate as d


def stats(items):
    terms = [d.pairs(d.words(q) + d.words(a)) for _, q, a in items]
    terms = [t for t in terms if t]
    return len(terms), sum(map(len, terms)) / max(1, len(terms)), Counter(t for x in terms for t in set(x))


def bm25(items, tokens):
    """Scaled scores of every item against the distinct pairs of a passage, added up plainly."""
    total, mean, held = stats(items)
    asked, out = set(d.pairs(tokens)), {}
    for id, q, a in items:
        tally = Counter(d.pairs(d.words(q) + d.words(a)))
        if tally:
            size = sum(tally.values())
            weight = {t: math.log(1 + (total - held[t] + 0.5) / (held[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean)) for t, f in tally.items()}
            out[id] = sum(w for t, w in weight.items() if t in asked) / sum(weight.values())
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.sampled_from([0.05, 0.2, 0.5]), st.integers(3, 30))
def test_wand_finds_all_above_the_limit(seed, n, least, vocabulary):
    rng = random.Random(seed)
    text = lambda k: " ".join(f"w{min(int(rng.expovariate(0.3)), vocabulary)}" for _ in range(k))
    items = [(str(i), text(rng.randint(0, 12)), text(rng.randint(0, 6))) for i in range(n)]
    index = d.Index(items, stats(items))
    tokens = d.words(text(rng.randint(2, 40)))
    known = index.known(tokens)
    terms = np.unique(known[known >= 0])
    want = {i: s for i, s in bm25(items, tokens).items() if s >= least}
    got = {index.items[p].id: s for p, s in index.wand(terms.tolist(), least)} if len(terms) else {}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    if len(terms) and want:
        assert index.hopeful(terms, np.array([0]), least).all()


@given(st.integers(0, 400), st.integers(2, 90))
def test_every_half_passage_lies_in_one(n, size):
    spans = d.passages(n, size)
    half = size // 2
    assert all(any(s <= p and p + half <= e for s, e in spans) for p in range(0, n - half + 1))


ITEMS = [
    (1, "What is the colour of the sky on a clear day in June", "it is blue as far as the eye can see"),
    (2, "one two three four five six seven eight nine ten", None), (3, "", ""), (4, None, None), (5, "word", ""), (6, "tiny pair", ""),
    (2, "one two three four five six seven eight nine ten", None),
]
Q, A = ITEMS[0][1:]
FILL = "nothing of that kind is said here and nobody asks " * 30
DOCS = [
    (1, f"{FILL}{Q}? {A}. {FILL}"), (2, f"{FILL}{Q}?"), (3, f"{FILL}{A}"), (4, f"{Q.upper()},\n{FILL} ... {A}"), (5, None), (6, ""), (7, "   "),
    (8, "One,two three four five six seven eight nine; TEN"), (8, "One,two three four five six seven eight nine; TEN"), (9, "one two three four and six seven eight nine ten"),
    (10, FILL * 200 + Q + " " + A), (None, f"{Q} {A}"), (11, "a tiny pair is"), (12, "word"),
]


def test_leaks_and_their_removal(spark):
    items = spark.createDataFrame(ITEMS, "id long, question string, answer string")
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, hits string")
    found = d.leaks(docs, items).collect()
    want = [(1, 1), (4, 1), (8, 2), (8, 2), (10, 1), (None, 1), (11, 6)]
    assert sorted(((r.id, r.item_id) for r in found), key=str) == sorted(want, key=str)
    kept = d.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 9, 12]
    assert d.leaks(docs, items.limit(0)).count() == 0 and d.without_leaks(docs, items.limit(0)).count() == len(DOCS)
    assert d.leaks(docs.limit(0), items).count() == 0
    parts, size = d.indexes(items, part_bytes=20)  # several indexes find the same
    assert len(parts) > 1 and size == 64
    assert sorted(i.id for p in parts for i in p.items) == ["1", "2", "6"]


def test_query_against_brute_force(spark, sf):
    wide = sf.replace("0.001", "0.01")
    items = [(r.item_id, *d.split_item(r.text)) for r in spark.read.parquet(f"{wide}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{wide}/documents.parquet").collect():
        held, tokens = {}, d.words(r.text)
        for i, q, a in items:
            if all(d.overlap(d.shingles(d.words(x)), tokens, held) >= 0.8 for x in (q, a)):
                want.add((r.doc_id, i))
    got = [(r.doc_id, r.item_id) for r in d.op3_decontamination(spark, wide).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_edited_copies_of_one_text_items(spark, sf):
    rng = random.Random(5)
    texts = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = []
    for i, t in texts:
        for edits in (1, 2):
            for _ in range(4):
                held = t.split()
                for at in rng.sample(range(max(0, len(held) - 12), len(held)), edits):  # near the end, where the answer is cut off
                    held[at] = "qqqq"
                rows.append((len(rows), f"{FILL}{' '.join(held)} {FILL}", i))
    whole = {i: d.shingles(d.words(t)) for i, t in texts}
    want = {(n, i) for n, t, i in rows if d.overlap(whole[i], d.words(t), {}) >= 0.8}
    halves = {i: [d.shingles(d.words(x)) for x in d.split_item(t)] for i, t in texts}
    assert any(min(d.overlap(x, d.words(rows[n][1]), {}) for x in halves[i]) < 0.8 for n, i in want)
    docs = spark.createDataFrame(rows, "doc_id long, text string, of long").select("doc_id", "text")
    items = d.questions(spark.createDataFrame(texts, "item_id long, text string"))
    assert want <= {(r.id, r.item_id) for r in d.leaks(docs, items).collect()}
    assert not {n for n, _ in want} & {r.doc_id for r in d.without_leaks(docs, items).collect()}
    apart = {(r.id, r.item_id) for r in d.leaks(docs, items.drop("one_text")).collect()}
    assert want - apart  # separate columns: both halves are still asked for
    assert all(min(d.overlap(x, d.words(rows[n][1]), {}) for x in halves[i]) >= 0.8 for n, i in apart)
