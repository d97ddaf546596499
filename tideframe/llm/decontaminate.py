"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import col, query, saved, table

K1, B = 1.2, 0.75
#: Postings of one index block.
BLOCK = 8
#: Item groups whose bounds are added for all passages at once before any cursor moves.
GROUPS = 64

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def pairs(tokens: list[str]) -> list[str]:
    """Neighbouring words: the terms of the index. In running text single words say too little about an item."""
    return list(map(" ".join, zip(tokens, tokens[1:])))


def shingles(tokens: list[str], n: int = 5) -> set[tuple[str, ...]]:
    """All runs of ``n`` words, or the whole if it is shorter; none of no word."""
    return {tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))} if tokens else set()


@dataclass
class Item:
    id: object
    question: set
    answer: set
    whole: set | None = None


class Index:
    """Inverted lists of normalised BM25 impacts: 1 is the score of an item against its own text.

    A term is a pair of neighbouring words. ``items``: (id, question, answer) rows, with a true
    fourth field where both are cut from one text. ``stats``: (items, mean length in terms, {term: items that hold it}) of the whole benchmark, so that
    parts of it score alike.
    """

    def __init__(self, items: list[tuple], stats: tuple[int, float, dict[str, int]]):
        total, mean, held = stats
        self.items, lists = [], {}
        ordered = sorted(items, key=lambda r: (words(r[1]) + words(r[2]), str(r[0])))  # like items share blocks
        for id, question, answer, *one_text in ordered:
            q, a = words(question), words(answer)
            held_pairs = pairs(q + a)
            if not held_pairs:
                continue
            place, tally, size = len(self.items), Counter(held_pairs), len(held_pairs)
            self.items.append(Item(id, shingles(q), shingles(a), shingles(q + a) if any(one_text) else None))
            raw = {}
            for t, f in tally.items():
                idf = math.log(1 + (total - held[t] + 0.5) / (held[t] + 0.5))
                raw[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))
            whole = sum(raw.values())
            for t, w in raw.items():
                lists.setdefault(t, []).append((place, w / whole))
        split = [t.split(" ") for t in lists]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in split for w in t}), 1)}
        self.base = len(self.vocabulary) + 1
        codes = np.array([self.vocabulary[x] * self.base + self.vocabulary[y] for x, y in split], np.int64)
        self.term_of = np.argsort(codes)
        self.codes = codes[self.term_of]
        self.docs = [np.array([p for p, _ in x], np.int64) for x in lists.values()]
        self.impacts = [np.array([w for _, w in x]) for x in lists.values()]
        self.top = [float(w.max()) for w in self.impacts]
        self.block_top = [np.maximum.reduceat(w, np.arange(0, len(w), BLOCK)) for w in self.impacts]
        self.block_last = [d[np.minimum(np.arange(BLOCK - 1, len(d) + BLOCK - 1, BLOCK), len(d) - 1)] for d in self.docs]
        width = max(1, -(-len(self.items) // GROUPS))
        self.bounds = np.zeros((len(lists), -(-len(self.items) // width) if self.items else 1), np.float32)
        for t, (d, w) in enumerate(zip(self.docs, self.impacts)):
            np.maximum.at(self.bounds[t], d // width, w)

    def known(self, tokens: list[str]) -> np.ndarray:
        """The term that starts at each word, -1 where the index has none."""
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), np.int64, len(tokens))
        if len(ids) < 2 or not len(self.codes):
            return np.full(max(0, len(ids) - 1), -1)
        code = ids[:-1] * self.base + ids[1:]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.term_of[at], -1)

    def hopeful(self, terms: np.ndarray, starts: np.ndarray, least: float) -> np.ndarray:
        """Which runs of distinct terms may reach ``least``: the summed bounds of some item group do."""
        return np.add.reduceat(self.bounds[terms], starts, axis=0).max(axis=1) >= least - 1e-4

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """(item, score) of every item that scores ``least`` or more against the distinct ``terms``."""
        cursors = [[int(self.docs[t][0]), 0, t] for t in terms]
        end, out = len(self.items), []
        while True:
            cursors.sort()
            bound, pivot = 0.0, None
            for n, (doc, _, t) in enumerate(cursors):  # the first item that the lists' maxima let reach the limit
                if doc == end:
                    break
                bound += self.top[t]
                if bound >= least - 1e-9:
                    pivot = doc
                    break
            if pivot is None:
                return out
            while n + 1 < len(cursors) and cursors[n + 1][0] == pivot:
                n += 1
            block_bound, border = 0.0, end
            for doc, at, t in cursors[: n + 1]:
                block = int(np.searchsorted(self.block_last[t], pivot))
                if block < len(self.block_last[t]):
                    block_bound += float(self.block_top[t][block])
                    border = min(border, int(self.block_last[t][block]) + 1)
            if n + 1 < len(cursors):
                border = min(border, cursors[n + 1][0])
            if block_bound < least - 1e-9:  # no item before the nearest block border can reach it
                self._advance(cursors[: n + 1], max(border, pivot + 1), end)
            elif cursors[0][0] == pivot:
                score = sum(float(self.impacts[t][at]) for doc, at, t in cursors[: n + 1])
                if score >= least - 1e-9:
                    out.append((pivot, score))
                self._advance(cursors[: n + 1], pivot + 1, end)
            else:
                self._advance([c for c in cursors[:n] if c[0] < pivot], pivot, end)

    def _advance(self, cursors: list, to: int, end: int) -> None:
        for c in cursors:
            c[1] = int(np.searchsorted(self.docs[c[2]], to))
            c[0] = int(self.docs[c[2]][c[1]]) if c[1] < len(self.docs[c[2]]) else end


def overlap(part: set, tokens: list[str], held: dict[int, set]) -> float:
    """Share of the shingles that the text holds; 1 of none. ``held`` keeps the text's shingles by length."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    if n not in held:
        held[n] = shingles(tokens, n)
    return len(part & held[n]) / len(part)


def passages(n: int, size: int) -> list[tuple[int, int]]:
    """Half-overlapping windows over ``n`` words: every run of ``size // 2`` words lies in one."""
    step = max(1, size // 2)
    return [(s, min(n, s + size)) for s in range(0, max(1, n - size + step), step)]


def search(text: str | None, index: Index, size: int, least: float, verify: float) -> list[tuple]:
    """(item place, best score, question overlap, answer overlap) of the items that a text holds."""
    tokens = words(text)
    known = index.known(tokens)
    at = np.flatnonzero(known >= 0)  # the few places that count
    terms, runs = known[at], []
    for s, e in passages(len(tokens), size):
        first, last = np.searchsorted(at, (s, e - 1))
        if first < last:
            runs.append(np.unique(terms[first:last]))
    if not runs:
        return []
    starts = np.cumsum([0] + [len(r) for r in runs[:-1]])
    best: dict[int, float] = {}
    for n in np.flatnonzero(index.hopeful(np.concatenate(runs), starts, least)):
        for item, score in index.wand(runs[n].tolist(), least):
            best[item] = max(best.get(item, 0.0), score)
    out, held = [], {}
    for item, score in sorted(best.items()):
        found = index.items[item]
        q, a = (overlap(x, tokens, held) for x in (found.question, found.answer))
        if min(q, a) >= verify or (found.whole is not None and overlap(found.whole, tokens, held) >= verify):
            out.append((item, score, q, a))
    return out


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of a test item kept as one text: the last sentences of five words or more answer.

    If that leaves a question of under five words, the whole is the question.
    """
    sentences = re.split(r"(?<=[.!?])\s+", (text or "").strip())
    for n in range(len(sentences) - 1, 0, -1):
        answer = " ".join(sentences[n:])
        if len(words(answer)) >= 5:
            question = " ".join(sentences[:n])
            return (question, answer) if len(words(question)) >= 5 else (text, "")
    return text or "", ""


#: Bytes of item text that one index, which is broadcast, is built from.
PART_BYTES = 8 << 20

_HITS = "array<struct<item:string,score:double,question_overlap:double,answer_overlap:double>>"


def _terms(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(pairs(words(t.as_py())))) for t in texts], pa.list_(pa.string()))

    return distinct(text)


def _count(text: Column) -> Column:
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(pairs(words(t.as_py()))) for t in texts], pa.int64())

    return count(text)


def indexes(items: DataFrame, part_bytes: int = PART_BYTES) -> tuple[list[Index], int]:
    """Indexes over ``items(id, question, answer[, one_text])`` and the length of a passage in words.

    Items go to parts of about ``part_bytes`` of text, one index each; only a part at a time
    reaches the driver. Weights come from the whole benchmark, counted by Spark.
    """
    both = F.concat_ws(" ", "question", "answer")
    one_text = F.coalesce("one_text", F.lit(False)) if "one_text" in items.columns else F.lit(False)
    items = saved(items.select(F.col("id").cast("string").alias("id"), "question", "answer", one_text.alias("one_text"), _count(both).alias("n")).distinct())
    total, mean, longest, size = items.where("n > 0").agg(F.count("*"), F.avg("n"), F.max("n"), F.sum(F.octet_length(both))).first()
    if not total:
        return [], 64
    longest += 1  # words
    parts = -(-size // part_bytes)
    items = items.withColumn("part", F.pmod(F.xxhash64("id", "question", "answer"), F.lit(parts)))
    terms = items.select("part", F.explode(_terms(both)).alias("term"))
    held = saved(terms.groupBy("term").agg(F.count("*").alias("held"), F.collect_set("part").alias("parts")))
    out = []
    for part in range(parts):
        weights = {r.term: r.held for r in held.where(F.array_contains("parts", F.lit(part).cast("long"))).select("term", "held").collect()}
        rows = [tuple(r) for r in items.where(F.col("part") == part).select("id", "question", "answer", "one_text").collect()]
        if rows:
            out.append(Index(rows, (total, mean, weights)))
    return out, max(64, 2 * longest)


def _finder(spark, index: Index, size: int, least: float, verify: float):
    shared = spark.sparkContext.broadcast(index)
    shape = pa.list_(pa.struct([("item", pa.string()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    @F.arrow_udf(_HITS)
    def hits(texts: pa.Array) -> pa.Array:
        found, known = shared.value, ("item", "score", "question_overlap", "answer_overlap")
        rows = (search(t.as_py(), found, size, least, verify) for t in texts)
        return pa.array([[dict(zip(known, (found.items[i].id, *rest))) for i, *rest in r] for r in rows], shape)

    return hits


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.4, verify: float = 0.8) -> DataFrame:
    """``(id, item_id, score, question_overlap, answer_overlap)`` for every benchmark item that a row of ``docs`` holds.

    ``items(id, question, answer)``: an empty or null answer is not asked for. A true ``one_text``
    (optional column) says that an item is one text and the halves only a guess. Every text is
    cut into half-overlapping passages twice as long as the longest item. Each passage
    queries the inverted index of word pairs with BM25, scaled so that an item scores 1 against itself;
    items that score ``least`` or more are then held against the whole text: ``verify`` of the
    five-word shingles of the question and of the answer must occur in it; of an item that is
    one text, those of the whole or of both halves. Items of fewer
    than two words are never found. Null and empty texts hold nothing, repeated rows stay repeated,
    repeated items count once, equal ids of different items give a row each.
    """
    kind = items.schema["id"].dataType
    parts, size = indexes(items)
    out = None
    for index in parts:
        hits = _finder(docs.sparkSession, index, size, least, verify)(col(text))
        found = docs.select(col(id).alias("id"), hits.alias("hits")).where(F.size("hits") > 0).select("id", F.explode("hits").alias("h"))
        found = found.select("id", F.col("h.item").cast(kind).alias("item_id"), "h.score", "h.question_overlap", "h.answer_overlap")
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = F.lit(0.0)
        return docs.select(col(id).alias("id"), F.lit(None).cast(kind).alias("item_id"), none.alias("score"), none.alias("question_overlap"), none.alias("answer_overlap")).where("false")
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", least: float = 0.4, verify: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``items(id, question, answer[, one_text])``, unchanged."""
    parts, size = indexes(items)
    for index in parts:
        docs = docs.where(F.size(_finder(docs.sparkSession, index, size, least, verify)(col(text))) == 0)
    return docs


def questions(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """``(id, question, answer, one_text)`` of a benchmark that keeps each item as one text; see ``split_item``."""

    @F.arrow_udf("struct<question:string,answer:string>")
    def halves(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("question", "answer"), split_item(t.as_py()))) for t in texts], pa.struct([("question", pa.string()), ("answer", pa.string())]))

    return benchmark.select(col(id).alias("id"), halves(col(text)).alias("h")).select("id", "h.question", "h.answer", F.lit(True).alias("one_text"))


@query("op3_decontamination")
def op3_decontamination(spark, sf):
    """Every document that holds a benchmark item, with the item and the overlaps."""
    found = leaks(table(spark, sf, "documents").select("doc_id", "text"), questions(table(spark, sf, "benchmark")))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("score", 6).alias("score"), "question_overlap", "answer_overlap")
