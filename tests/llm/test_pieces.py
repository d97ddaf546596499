import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import pieces

V = pieces.vocabulary(pieces.MODEL)
TEXTS = [None, "", " ", "a", "the cat", "  two  blanks ", "line\n\nend\n", "é ü 漢字 🙂 \x00 ﬁ", "x" * 3_000, "tab\tnbsp\xa0▁low", "the and then " * 500]


def every(text):
    """All segmentations with their probabilities, spelled out character by character."""
    normal = V.model.normalize(text)
    size = V.model.get_piece_size()
    ids = {V.model.id_to_piece(i): i for i in range(size) if not (V.model.is_byte(i) or V.model.is_control(i) or V.model.is_unknown(i))}

    def ways(at):
        if at == len(normal):
            yield (), 0.0
            return
        if normal[at] not in ids:
            raw = normal[at].encode()
            for rest, w in ways(at + 1):
                yield tuple(int(V.bytes[b]) for b in raw) + rest, w + V.byte_logp * len(raw)
        for n in range(1, 17):
            if at + n <= len(normal) and normal[at : at + n] in ids:
                i = ids[normal[at : at + n]]
                for rest, w in ways(at + n):
                    yield (i, *rest), w + V.logp[i]

    found = dict(ways(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {k: math.exp(w - total) for k, w in found.items()}


def draws(text, k, n, seed=0):
    return pieces.sample(pieces.Slice([V.chunks(text)] * n), pieces.row_keys(list(range(n)), seed), V, k)


@pytest.mark.parametrize("text", ["a", "the", "at the", "is\nit é"])
def test_samples_are_distinct_complete_and_scored(text):
    want = every(text)
    for row in draws(text, 40, 30):
        assert len(row) == min(40, len(want)) and len({tuple(r[0]) for r in row}) == len(row)
        values = [r[2] for r in row]
        assert values == sorted(values, reverse=True)
        for ids, logp, _, inclusion in row:
            assert math.isclose(math.exp(logp), want[tuple(ids.tolist())], rel_tol=1e-9) and inclusion <= 0
            if len(want) <= 40:
                assert inclusion == 0
    smaller = draws(text, 2, 30)
    for a, b in zip(draws(text, 40, 30), smaller):  # a longer run begins with the shorter one
        assert [tuple(x[0]) for x in a[:2]] == [tuple(x[0]) for x in b]


def test_order_follows_sampling_without_replacement():
    text, n = "then", 20_000
    want = every(text)
    first, second, chance = Counter(), defaultdict(Counter), Counter()
    for row in draws(text, 2, n, 5):
        a, b = (tuple(r[0].tolist()) for r in row)
        first[a] += 1
        second[a][b] += 1
        for r in row:
            chance[tuple(r[0].tolist())] += 1 / math.exp(r[3])
    for s, p in want.items():
        assert abs(first[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        assert abs(chance[s] / n - 1) < 0.3 or p < 0.02  # weighting by inclusion is unbiased
    best = max(want, key=want.get)
    for s, p in want.items():
        if s != best:
            q = p / (1 - want[best])
            m = first[best]
            assert abs(second[best][s] / m - q) < 5 * math.sqrt(q * (1 - q) / m) + 2e-3


def test_keys_alone_decide():
    texts = ["the cat sat on the mat", "other words", "the cat sat on the mat"]
    keys = pieces.row_keys([1, 2, 1], 0)
    together = pieces.sample(pieces.Slice([V.chunks(t) for t in texts]), keys, V, 3)
    alone = pieces.sample(pieces.Slice([V.chunks(texts[0])]), keys[:1], V, 3)[0]
    same = lambda a, b: all((x[0] == y[0]).all() and np.allclose(x[1:], y[1:]) for x, y in zip(a, b))
    assert same(together[0], alone) and same(together[2], alone)


def plain_and_cut(texts, vocab=V):
    """Segmentations of texts in whole chunks, and in chunks cut where no piece crosses."""
    keys = pieces.row_keys(range(len(texts)), 3)
    for part in (pieces.Slice([vocab.chunks(t) for t in texts]), pieces.Slice([vocab.model.normalize(t or "") for t in texts], vocab)):
        yield part, part.encode(vocab), pieces.sample(part, keys, vocab, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TEXTS[:8]), st.text(alphabet=st.sampled_from(" \n\0\u0301'satheQz.,!(é漢🙂▁"), max_size=20)), max_size=5))
def test_cut_chunks_give_the_same_segmentations(texts):
    (_, own, found), (_, own_cut, found_cut) = plain_and_cut(texts)
    assert [o.tolist() for o in own] == [o.tolist() for o in own_cut] == [V.model.encode(t or "") for t in texts]
    for a, b in zip(found, found_cut, strict=True):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
        assert np.allclose([x[1:] for x in a], [x[1:] for x in b])


def test_lattices_are_built_once(monkeypatch):
    vocab = pieces.Vocabulary(pieces.MODEL, 1.0)
    built = []
    monkeypatch.setattr(vocab.lattice, "add", lambda chunks, add=vocab.lattice.add: built.extend(chunks) or add(chunks))
    texts = [f"thonre hedly{m} qanonly {m}\nthonre" for m in ".,;:!?)"]
    for n in range(0, len(texts), 2):  # a slice of texts after the other
        part = pieces.Slice([vocab.model.normalize(t) for t in texts[n : n + 2]], vocab)
        part.encode(vocab), pieces.sample(part, pieces.row_keys([1, 2][: len(part.many)], 0), vocab, 2)
    assert len(built) == len(set(built)) and sum("hedly" in c for c in built) == 1


def test_chunks_beyond_those_remembered(monkeypatch):
    texts = ["the cat, the hat", "a cat. (the end)", "", "the hat!", "other words, the cat"]
    keys = pieces.row_keys([1], 0)
    for limit in (0, 40, 10**6):
        monkeypatch.setattr(pieces, "REMEMBERED_EDGES", limit)
        vocab = pieces.Vocabulary(pieces.MODEL, 1.0)
        for t in texts * 2:
            part = pieces.Slice([vocab.model.normalize(t)], vocab)
            assert part.encode(vocab)[0].tolist() == vocab.model.encode(t)
            got, want = pieces.sample(part, keys, vocab, 3)[0], pieces.sample(pieces.Slice([V.chunks(t)]), keys, V, 3)[0]
            assert [x[0].tolist() for x in got] == [x[0].tolist() for x in want]
        assert (limit >= 10**6) == (len(vocab.known) == len({c for t in texts for c in pieces.Slice([vocab.model.normalize(t)], vocab).chunks}))


class Counting:
    """numpy with a count of the exponentials taken."""

    taken = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def exp(self, x, **more):
        self.taken += np.size(x)
        return np.exp(x, **more)


def test_only_nodes_that_may_branch_are_rated(monkeypatch):
    part = pieces.Slice([V.model.normalize("the cat sat, then another ran away. " * 2_000), V.model.normalize("a"), ""], V)
    own = part.encode(V)
    monkeypatch.setattr(pieces, "np", counting := Counting())
    found = pieces.sample(part, pieces.row_keys([1, 2, 3], 0), V, 4)
    assert [len(f) for f in found] == [4, 2, 1] and len(found[0][0][0]) > 10_000 < len(own[0])
    assert 0 < counting.taken < len(own[0]) // 2


def test_windows_leave_the_samples_alone(monkeypatch):
    texts = ["the cat sat on another mat. " * 300, "2 2 2 2 2 2 2 2 2 " * 200 + "then", "at the", "", "漢 is\n" * 400]
    part, keys, found = pieces.Slice([V.model.normalize(t) for t in texts], V), pieces.row_keys(range(5), 9), []
    for window in (1, 16, 10**6):
        monkeypatch.setattr(pieces, "WINDOW", window)
        found.append([(x[0].tolist(), *x[1:]) for row in pieces.sample(part, keys, V, 6) for x in row])
    assert found[0] == found[1] == found[2]


def test_encode_and_decode(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (3, "a"), (None, "no key")], "doc_id int, text string")
    rows = docs.withColumn("ids", pieces.encode(docs.text)).withColumn("back", pieces.decode(pieces.col("ids"))).collect()
    for r in rows:
        assert r.ids == V.model.encode(r.text or "") and r.back == (r.text or "").replace("▁", " ")
    out = pieces.segment(docs.withColumnRenamed("doc_id", "_both").withColumn("Pieces", docs.text), "_both", k=3).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 1 <= len(r.samples) <= 3 and r.decodes and r.pieces == V.model.encode(r.text or "")
        assert all(V.decode(s.ids) == (r.text or "").replace("▁", " ") for s in r.samples)
    assert pieces.segment(docs.limit(0)).count() == 0


def test_query(spark, sf):
    rows = pieces.op1_sentencepiece(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.decodes for r in rows)
    assert all(r.n_pieces == len(V.model.encode(docs[r.doc_id])) and r.n_samples == len(set(r.sample_hashes)) for r in rows)
    assert all(r.gumbel == sorted(r.gumbel, reverse=True) for r in rows)
