import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tideframe.llm import lm

ROWS = [
    (1, None), (2, ""), (3, " \t"), (4, "The cat sat"), (5, "the CAT sat on\nthe mat"), (5, "the CAT sat on\nthe mat"), (None, "É é the"),
    (6, "w " * 5_000), (7, "unseen words everywhere"), (8, "x" * 100_000),
]


def plain(rows):
    """Tokens, known tokens and unigram score per row, by the contract."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, x in rows if not out(i) for t in lm.tokens((x or "").encode()))
    n, v = sum(c.values()), len(c)
    return [
        (i, out(i), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
        for i, x in rows for ts in [lm.tokens((x or "").encode())]
    ]


def check(out, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, out), key=key), sorted(plain(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(g[6])
    return got


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 50)
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, id int")
    check(lm.score(docs).collect(), ROWS)
    assert lm.score(docs.limit(0)).count() == 0


def test_query_and_chunks(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = check(lm.op8_lm(spark, sf).collect(), rows)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than unigrams on texts it has not seen
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    assert lm.chunked(docs).count() == 3


def test_scores_follow_the_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 50)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    chunks = lm.chunked(docs)
    parts = [(w, n) for r in chunks.collect() for w, n in zip(r.words, r.taught)]
    total = Counter()
    for w, n in parts:
        total[bytes(w)] += n
    counts = spark.createDataFrame(list(total.items()), "word binary, c long")
    model = lm.learn(chunks, counts)
    assert np.allclose((10.0**model.table).sum(axis=2), 1)
    known = [w for w, n in total.items() if n]
    k = lm.class_of(known, model.heads)
    share = np.bincount(k, 10 ** model.word_scores(k, np.array([total[w] for w in known])), lm.CLASSES) + 1 / model.mass
    assert np.allclose(share, 1)  # of every class: its words and one unseen word
    want = {}
    for i, x in ROWS:
        ts = lm.tokens((x or "").encode())
        k = [0, 0, *lm.class_of(ts, model.heads)]
        own = lm.class_of(ts, model.heads)
        want[i] = sum(model.table[k[j], k[j + 1], k[j + 2]] for j in range(len(ts))) + sum(model.word_scores(own, np.array([total[t] for t in ts])))
    for r in lm.score(docs).collect():
        assert math.isclose(r.score, want[r.id], rel_tol=1e-9)


def test_noise_contrastive_training_learns_a_chain():
    rng = np.random.default_rng(0)
    grams = np.array([(a, b, (b * 5 + 1) % 20) for a in range(20) for b in range(20)] + [(a, b, c) for a in range(20) for b in range(20) for c in rng.integers(0, 20, 2)])
    counts = np.r_[np.full(400, 40.0), np.ones(800)]
    table = lm.LogBilinear.train(grams, counts).table()
    hit = np.mean([10 ** table[a, b, (b * 5 + 1) % 20] for a in range(20) for b in range(20)])
    assert hit > 0.5  # 0.05 by unigrams
    uniform = lm.LogBilinear.train(grams[:0], counts[:0]).table()
    assert np.allclose((10**uniform).sum(axis=2), 1)


def topics(n, seed=0):
    """Texts of two topics, each with half of 64 frequent words and 40 rare ones; all rare words end alike, so they are of one upper class."""
    rng = np.random.default_rng(seed)
    frequent = [f"f{i:02d}" for i in range(64)]
    rare = [[f"{t}{i:02d}ox" for i in range(40)] for t in "ab"]
    texts = []
    for i in range(n):
        t = i % 2
        texts.append(" ".join(rng.choice(rare[t]) if rng.random() < 0.3 else frequent[32 * t + rng.integers(32)] for _ in range(40)))
    return texts


def ids(out):
    """Ids that are held out, or are not, without end."""
    return (i for i in range(10**9) if (zlib.crc32(str(i).encode()) % 7 == 2) == out)


def test_rare_words_have_vectors_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 300)
    taught, held = list(zip(ids(False), topics(600))), ids(True)
    as_context = [(next(held), x) for x in ("a03ox a17ox f05", "b03ox b17ox f45", "b03ox b17ox f05", "a03ox a17ox f45")]
    as_target = [(next(held), x) for x in ("f01 f05 a03ox", "f41 f45 b03ox", "f41 f45 a03ox", "f01 f05 b03ox")]
    out = {r.id: r.score for r in lm.score(spark.createDataFrame(taught + as_context + as_target, "doc_id long, text string")).collect()}
    for rows in (as_context, as_target):
        a, b, c, d = (out[i] for i, _ in rows)
        assert a + b > c + d + 0.5  # upper classes alone give 0: all rare words are of one


def test_words_add_up_to_one_after_rare_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 100)
    taught = list(zip(ids(False), topics(200)))
    words = sorted({w for _, x in taught for w in x.split()})
    unseen = {lm.tail_class(b"%04d" % i): f"{i:04d}" for i in range(5_000)}
    assert len(unseen) == lm.TAILS
    pasts, held = ["a03ox b07ox", "f01 a03ox", "zzzzz b11ox"], ids(True)
    asked = [(next(held), f"{past} {w}".strip()) for past in pasts for w in ["", *words, *unseen.values()]]
    docs = spark.createDataFrame(taught + asked, "doc_id long, text string")
    chunks = lm.chunked(docs.coalesce(1))
    row = chunks.first()
    model = lm.learn(chunks, spark.createDataFrame(list(zip(row.words, row.taught)), "word binary, c long"))
    blocks, norm = lm.word_vectors(chunks, spark.sparkContext.broadcast(model))
    vectors = pa.Table.from_batches(list(lm._sent(blocks.drop("norm").toArrow().to_batches())))
    size = np.array(row.sizes, np.int64)
    starts, flat = np.cumsum(size) - size, np.frombuffer(zlib.decompress(row.text), np.uint32)
    _, token = lm._token_scores(lm.class_of([bytes(w) for w in row.words], model.heads), flat, starts, vectors, model, norm)
    third = dict(zip(row.ids, 10.0 ** token[np.minimum(starts + 2, len(token) - 1)]))
    for past in pasts:
        total = 0
        for i, x in asked:
            if x == past or x.rsplit(" ", 1)[0] == past:
                word = b"" if x == past else x.rsplit(" ", 1)[1].encode()
                k = 0 if x == past else model.heads.get(word, 0)
                alone = x == past or word in model.heads  # the place of an unseen word beside the one word of the class
                total += third[i] * (model.mass[k] / (model.mass[k] - 1) if alone else 1)
        assert math.isclose(total, 1, abs_tol=1e-3)


def test_more_text_teaches_more(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 300)
    asked = list(zip(ids(True), topics(40, seed=1)))

    def held_out(n):
        taught = list(zip(ids(False), topics(n)))
        return sum(r.score for r in lm.score(spark.createDataFrame(taught + asked, "doc_id long, text string")).collect() if r.held_out)

    assert held_out(100) < held_out(1_200)


def test_target_vectors_settle_where_plain_gradients_vanish(monkeypatch):
    monkeypatch.setattr(lm, "WORD_STEPS", 2_000)
    monkeypatch.setattr(lm, "SETTLED", 1e-6)
    rng = np.random.default_rng(0)
    grams = rng.integers(0, lm.CLASSES, (3_000, 3))
    net = lm.WordNet.of(lm.LogBilinear.train(grams, np.ones(3_000), steps=50), grams, np.ones(3_000))
    met = rng.poisson(3, (20, lm.STATES)) * (rng.random((20, lm.STATES)) < 0.2)
    counts, k = met.sum(axis=1), 70
    r, b = lm._target_vectors(net, k, counts, met.astype(np.float32))
    for v, c, m, n in zip(r, b, met, counts):
        share = net.state_share[k]
        found = 1 / (1 + lm.NOISE * np.exp(-(net.states @ v + c)))
        true, noise = m + share, lm.NOISE * (n + 1) * share
        push = true * (1 - found) - noise * found
        assert np.allclose(push @ net.states - lm.TARGET_PRIOR * v, 0, atol=0.02 * n) and abs(push.sum()) < 0.02 * n


def test_pairs_are_folded_without_loss(monkeypatch):
    rng = np.random.default_rng(0)
    word, a, b = (rng.integers(0, n, 5_000) for n in (7, 5, 256))
    monkeypatch.setattr(lm, "MET_AT_ONCE", 300)
    pairs = lm.Pairs()
    for i in range(0, 5_000, 100):
        pairs.add(*(x[i : i + 100].astype(t) for x, t in ((word, np.uint64), (a, np.uint32), (b, np.uint32))))
    got = {(w, x, y): t for ws, xs, ys, ts, _ in pairs.blocks() for w, x, y, t in zip(ws.tolist(), xs.tolist(), ys.tolist(), ts[:, 0].tolist())}
    assert got == Counter(zip(word.tolist(), a.tolist(), b.tolist()))
    assert list(lm._blocks(np.array([0, 3, 4, 20]), 25, 5)) == [(0, 4), (4, 20), (20, 25)]


def test_all_held_out_and_classes(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    rows = list(zip(ids(True), topics(6)))
    check(lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    words = [b"", b"a", b"\xff", b"ab", b"the", lm.END, b"longer", "\u00e9".encode()]
    want = [0 if w == lm.END else {b"the": 5}.get(w) or lm.tail_class(w) for w in words]
    assert lm.class_of(words, {b"the": 5}).tolist() == want == lm.class_of(pa.array([b"zz", *words]).slice(1), {b"the": 5}).tolist()
    assert lm.class_of([], {}).tolist() == []
