import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, least=100, top=2_000, width=5):
    """All phrases counted in a dictionary, all cuts and containments looked up there."""
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in cut(text):
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, width + 1):
                    if i + k <= len(words):
                        f[lang][tuple(words[i : i + k])] += 1
    for lang, counts in f.items():
        common = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {q for p, a in common.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) for q in [p[i : i + k]] if 100 * a >= 100 * counts[q]}
        found = []
        for p, a in common.items():
            if p not in covered:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def corpus(seed, docs=300, words=40):
    rng = np.random.default_rng(seed)
    names = [f"{'É' if i % 7 == 0 else 'W'}{i}" for i in range(words)]
    share = 1 / np.arange(1, words + 1)
    rows = []
    for d in range(docs):
        text = ""
        for w in rng.choice(words, rng.integers(0, 60), p=share / share.sum()):
            text += names[w] + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "\xa0"])
        rows.append((text + (" licence of the very long kind here" if d % 3 == 0 else ""), ["en", "de", None][d % 3]))
    return rows


EDGE = [(None, "en"), ("", "en"), (" \t\n", "xx"), ("one", "en"), ("a b " * 30_000, "en"), ("A  B\ta b. a,b a:b", None), ("x\x00y x\x00y", "e"), ("zz zz zz zz zz zz zz zz", "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("budget, part_words", [(co.BUDGET, co.PART_WORDS), (500, 700)])
def test_against_plain_counting(spark, monkeypatch, budget, part_words):
    monkeypatch.setattr(co, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(co, "BURST", 50)
    monkeypatch.setattr(co, "HELD_COUNTERS", 40)
    rows = [*corpus(2), *EDGE]
    out = co.collocations(frame(spark, rows).repartition(3), least=5, top=40, budget=budget, part_words=part_words)
    assert got(out) == plain(rows, least=5, top=40)
    assert [t for _, t in out.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]


def test_query_and_clashing_names(spark, sf, tmp_path):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(t, la) for t, la in corpus(3, 200)] * 2 + EDGE
    docs = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "text string, lang string, id int, word string, rank int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert got(co.op11_collocations(spark, str(tmp_path))) == plain(rows)
    empty = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(empty).count() == 0
    assert got(co.collocations(frame(spark, EDGE[:4]), least=1, top=None)) == plain(EDGE[:4], least=1)


def test_products_beyond_64_bits(spark):
    phrases = spark.sql("SELECT 10000000000000 AS a, 30000000000000 AS n, 10000000000000 AS l, 10000000000001 AS r")
    big = phrases.selectExpr("cast(1000 as decimal(5,0)) * cast(a as decimal(20,0)) * cast(n as decimal(20,0)) AS o", "cast(l as decimal(20,0)) * cast(r as decimal(20,0)) AS u")
    assert big.selectExpr("o div u AS s").first().s == 1000 * 10**13 * 3 * 10**13 // (10**13 * (10**13 + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=12), max_size=12), st.integers(1, 40), st.integers(1, 8))
def test_trie_counts_windows(pieces, budget, burst):
    pieces = pieces or [[1]]
    codes = np.array([c for p in pieces for c in p] or [0], np.int64)
    piece = np.r_[np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]), 0][: len(codes)]
    trie, total = co.HatTrie(5, budget, burst), Counter()
    found = co.windows(codes, co.linked(codes > 0, piece), 5)
    left = [*trie.add(found)]
    assert trie.entries <= budget
    while trie.entries:
        left.append(trie.spill(trie.entries))
    for rows, n in left:
        for row, k in zip(rows.tolist(), n.tolist()):
            total[tuple(row)] += k
    want = Counter()
    for p in pieces:
        for i in range(len(p)):
            run = []
            for c in p[i : i + 5]:
                if not c:
                    break
                run.append(c)
            if len(run) > 1:
                want[(*run, *[0] * (5 - len(run)))] += 1
    assert total == want


def test_words_of_a_slice():
    texts = [b"Ab  c.D\te", b"", "É é\x0bx".encode(), b" ", b"c"]
    words, codes, pieces, text = co.cut_words(texts)
    assert [words[int(c)].as_py() for c in codes] == [b"ab", b"c", b"d", b"e", "É".encode(), "é".encode(), b"x", b"c"]
    assert text.tolist() == [0, 0, 0, 0, 2, 2, 2, 4] and len(set(pieces.tolist())) == 5
    assert len(co.cut_words([b""])[1]) == 0 and isinstance(words, pa.Array)
