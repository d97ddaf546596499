"""Phrase collocations: exact phrase counts from burst tries of word ids, scored by their weakest cut."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import small
from .base import col, give_back, query, saved, table, written

#: Words of the longest phrase, occurrences of the rarest, rows of a language.
WORDS, LEAST, TOP = 5, 100, 2_000
#: Bytes of text that are cut into words at once.
SLICE_BYTES = 4 << 20
#: Entries of a container that bursts, and of a task's trie that spills half of itself.
BURST, BUDGET = 4_096, 400_000
#: Windows of one prefix partition, and the most such partitions.
PART_WORDS, MOST_PARTS = 1 << 20, 1 << 20
#: Bits of the filter of frequent words: so many a word, and at most 2 ** so many (64 MiB).
BITS_A_WORD, MOST_BITS = 32, 29
PAGE_BITS = 1 << 15
#: Counters of word pairs: one for so many positions, and at most 2 ** MOST_BITS; a page of them is added up at a time.
POSITIONS_A_COUNTER, PAGE_COUNTERS = 16, 1 << 16
#: Distinct counters that a task holds.
HELD_COUNTERS = 2_000_000

#: 0: a byte of a word, 1: a blank, 2: the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lower-cased words, and of every word in turn its number among them, its piece and its text."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = _KIND[raw]
    word = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = _LOWER[raw[word]]
    whole = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    pieces = np.cumsum(kind == 2, dtype=np.int32)[starts]
    sizes = np.array([len(t) + 1 for t in texts])
    return whole.dictionary, whole.indices.to_numpy(), pieces, np.searchsorted(np.cumsum(sizes), starts, side="right")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts, some megabytes at a time."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_binary())):
            langs.append(lang)
            texts.append(text.as_py())
            size += len(texts[-1]) + 1
            if size >= SLICE_BYTES:
                yield langs, texts
                langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def _pairs(langs: list[str], texts: list[bytes]) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (language, word) pairs of a slice, their counts, and the pair and piece of every word."""
    words, codes, pieces, text = cut_words(texts)
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    lang = np.array([number[x] for x in langs], np.int64)[text]
    pair, which, n = np.unique(lang * max(1, len(words)) + codes, return_inverse=True, return_counts=True)
    lang_of, word_of = np.divmod(pair, max(1, len(words)))
    return [names[i] for i in lang_of], words.take(pa.array(word_of)), n, which, pieces, lang_of


def word_id(salt: int, lang: str, word: bytes) -> int:
    """The id of a word of a language, as Spark's ``xxhash64`` gives it for the same text."""
    h = xxhash.xxh64_intdigest(f"{salt}:{len(lang)}:{lang}:".encode() + word, seed=42)
    return h - (1 << 64) if h >> 63 else h


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, word, n, id`` of every word of ``rows`` (lang, text); no two words share an id."""

    def count(batches):
        for langs, texts in _slices(batches):
            lang, words, n, *_ = _pairs(langs, texts)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), words.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    counts = written(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    salt = 0
    while True:
        ids = counts.withColumn("id", F.xxhash64(F.concat(F.lit(f"{salt}:"), F.length("lang").cast("string"), F.lit(":"), "lang", F.lit(":"), "word")))
        if ids.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return ids.withMetadata("id", {"salt": salt})
        salt += 1


class Filter:
    """One bit per value of a word id's leading bits, set for frequent words; rarer ones may pass, none is lost."""

    def __init__(self, frequent: DataFrame, n: int):
        self.bits = min(MOST_BITS, max(15, (n * BITS_A_WORD).bit_length()))
        self.pages = np.zeros((1 << self.bits) // 8, np.uint8)
        bit = F.shiftrightunsigned("id", 64 - self.bits)
        page = frequent.groupBy(F.floor(bit / PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(bit % PAGE_BITS).alias("set"))
        for row in page.collect():  # 4 KiB each, 64 MiB at most
            self.pages[row.page * (PAGE_BITS // 8) :][: PAGE_BITS // 8] = np.frombuffer(row.set, np.uint8)

    def holds(self, ids: np.ndarray) -> np.ndarray:
        bit = ids.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.pages[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pair_counter(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The counter of pairs of word ids."""
    mix = (first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (second.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mix >> np.uint64(64 - bits)).astype(np.int64)


def linked(known: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Where a word and the next one are both known and of one piece."""
    return known[:-1] & known[1:] & (pieces[:-1] == pieces[1:])


def windows(codes: np.ndarray, links: np.ndarray, width: int) -> np.ndarray:
    """From every word on, up to ``width`` word numbers, ended by 0 where the next word is not linked; single words are left out."""
    at, n = np.flatnonzero(links), len(codes)
    out = np.zeros((len(at), width), np.uint32)
    out[:, 0], out[:, 1] = codes[at], codes[at + 1]
    on, more = np.ones(len(at), bool), np.r_[links, False]
    for k in range(2, width):
        on = on & more[np.minimum(at + k - 1, n - 1)]
        out[on, k] = codes[at[on] + k]
    return out


class HatTrie:
    """Counts windows of word numbers: a shallow trie over the first words with hash containers below.

    A container maps the rest of a window to its count and bursts into one container per next
    word when it is full. When the trie holds more than ``budget`` entries, whole subtrees, the
    largest first, leave it until half is free.
    """

    def __init__(self, width: int, budget: int = BUDGET, burst: int = BURST):
        self.root: dict | Counter = Counter()
        self.width, self.budget, self.burst, self.entries = width, budget, burst, 0

    def add(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Counts ``found`` (n, width); yields (windows, counts) of what had to leave."""
        for at in range(0, len(found), self.budget):
            self.root = self._add(self.root, found[at : at + self.budget])
            if self.entries > self.budget:
                yield self.spill(self.entries - self.budget // 2)

    def _add(self, node, rows: np.ndarray):
        if isinstance(node, Counter):
            before = len(node)
            node.update(_keys(rows))
            self.entries += len(node) - before
            return self._burst(node, rows.shape[1]) if len(node) > self.burst and rows.shape[1] > 2 else node
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        at = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        keys = _keys(rows[:, 1:])
        for word, i, j in zip(rows[at, 0].tolist(), at.tolist(), [*at[1:].tolist(), len(rows)]):
            child = node.get(word)
            if child is None:
                child = node[word] = Counter()
            if isinstance(child, Counter) and len(child) + j - i <= self.burst:
                before = len(child)
                child.update(keys[i:j])
                self.entries += len(child) - before
            else:
                node[word] = self._add(child, rows[i:j, 1:])
        return node

    def _burst(self, node: Counter, width: int) -> dict:
        out: dict = {}
        for key, n in node.items():
            out.setdefault(int.from_bytes(key[:4], "little"), Counter())[key[4:]] = n
        return {w: self._burst(c, width - 1) if len(c) > self.burst and width > 3 else c for w, c in out.items()}

    def spill(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes the largest subtrees of the root out until ``least`` entries have left."""
        if isinstance(self.root, Counter):
            left, self.root = [((), self.root)], Counter()
        else:
            sizes = sorted(((_size(c), w) for w, c in self.root.items()), reverse=True)
            left, gone = [], 0
            for n, w in sizes:
                if gone >= least:
                    break
                left.append(((w,), self.root.pop(w)))
                gone += n
        keys, counts = [], []
        while left:
            path, node = left.pop()
            if isinstance(node, Counter):
                head = np.array(path, "<u4").tobytes()
                keys.extend([head + k for k in node])
                counts.extend(node.values())
            else:
                left.extend(((*path, w), c) for w, c in node.items())
        self.entries -= len(keys)
        return np.frombuffer(b"".join(keys), "<u4").reshape(-1, self.width), np.array(counts, np.int64)


def _size(node) -> int:
    return len(node) if isinstance(node, Counter) else sum(map(_size, node.values()))


def _keys(rows: np.ndarray) -> list[bytes]:
    return np.ascontiguousarray(rows, "<u4").view(f"V{4 * rows.shape[1]}").ravel().tolist()


def _sorted(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """The order of rows by ``columns`` of non-negative numbers below 2 ** bits; as many as fit go into one sort key."""
    per, keys = max(1, 63 // max(1, bits)), []
    for i in range(0, len(columns), per):
        key = columns[i].astype(np.int64)
        for c in columns[i + 1 : i + per]:
            key = key << bits | c.astype(np.int64)
        keys.append(key)
    return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")


def _part(ids: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The prefix partition of windows of ids: by two words, of hot first words by three."""
    u = ids.view(np.uint64)
    mix = (u[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (u[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    if ids.shape[1] > 2 and len(hot):
        mix ^= np.where(np.isin(ids[:, 0], hot), u[:, 2] * np.uint64(0x165667B19E3779F9), np.uint64(0))
    mix ^= mix >> np.uint64(29)
    return ((mix * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


_RUN = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("windows", pa.binary()), ("wide", pa.bool_()), ("counts", pa.binary())])


def runs(found: np.ndarray, counts: np.ndarray, ids: np.ndarray, hot: np.ndarray, parts: int) -> pa.RecordBatch:
    """Spilled subtrees as one sorted run per prefix partition, with the ids of its words."""
    order = np.argsort(ids)  # ids[0] is that of no word
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    rank[order] += 1
    rank[0] = 0
    ranks = np.concatenate([[0], ids[order]])
    part = _part(ids[found], hot, parts)
    rows = rank[found]
    at = _sorted([part, *rows.T], max(int(part.max()).bit_length(), int(rank.max()).bit_length()))
    part, rows, counts = part[at], rows[at], counts[at].astype("<u4")
    cut = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    out = []
    for i, j in zip(cut, cut[1:]):
        used, code = np.unique(rows[i:j], return_inverse=True)
        shift = int(used[0] != 0)  # number 0 is the end of a window
        wide = len(used) + 1 > 1 << 16
        code = (code.reshape(j - i, -1) + shift).astype("<u4" if wide else "<u2")
        out.append((int(part[i]), ranks[used[1 - shift :]].tobytes(), code.T.tobytes(), wide, counts[i:j].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _RUN)], schema=_RUN)


def merged(blocks: list[dict], width: int, hot: np.ndarray, least: int) -> tuple[list[list[int]], list[int], list[bool]]:
    """Phrases of two words and more of one prefix partition: ids, occurrences, whether that is all of them."""
    ids = [np.frombuffer(b["ids"], np.int64) for b in blocks]
    known, rows = np.unique(np.concatenate(ids)), []
    for b, own in zip(blocks, ids):
        code = np.frombuffer(b["windows"], "<u4" if b["wide"] else "<u2").reshape(width, -1)
        rows.append(np.concatenate([[0], np.searchsorted(known, own) + 1])[code])
    rows, counts = np.concatenate(rows, axis=1), np.concatenate([np.frombuffer(b["counts"], "<u4") for b in blocks]).astype(np.int64)
    at = _sorted(list(rows), int(len(known) + 1).bit_length())
    rows, counts = rows[:, at], counts[at]
    new, found, n, whole = np.zeros(len(counts), bool), [], [], []
    for k in range(width):
        new |= np.diff(rows[k], prepend=-1) != 0
        if not k:
            continue
        start = np.flatnonzero(new)
        f = np.add.reduceat(counts, start)
        part = np.isin(known[rows[0][start] - 1], hot) if k == 1 and width > 2 else np.zeros(len(start), bool)
        keep = (rows[k][start] > 0) & (part | (f >= least))
        found += known[rows[: k + 1, start[keep]] - 1].T.tolist()
        n += f[keep].tolist()
        whole += (~part[keep]).tolist()
    return found, n, whole


def _ids(batches: Iterator[pa.RecordBatch], salt: int, passes: Filter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice: ids of distinct words, which of them may be frequent, and the word and piece of every place."""
    for langs, texts in _slices(batches):
        lang, found, _, which, pieces, _ = _pairs(langs, texts)
        own = np.array([word_id(salt, x, w) for x, w in zip(lang, found.to_pylist())], np.int64)
        yield own, passes.holds(own), which, pieces


_COUNTED = pa.schema([("page", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])


def _counted(counters: list[np.ndarray], counts: list[np.ndarray], least: int) -> Iterator[pa.RecordBatch]:
    """Counts by page; a count above ``least`` says no more than ``least``."""
    at, inverse = np.unique(np.concatenate(counters), return_inverse=True)
    n = np.minimum(np.bincount(inverse, np.concatenate(counts)), least).astype("<u4")
    cut = np.flatnonzero(np.diff(at // PAGE_COUNTERS, prepend=-1)).tolist()
    rows = [(int(at[i]) // PAGE_COUNTERS, (at[i:j] % PAGE_COUNTERS).astype("<u2").tobytes(), n[i:j].tobytes()) for i, j in zip(cut, [*cut[1:], len(at)])]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _COUNTED)], schema=_COUNTED)


def frequent_pairs(rows: DataFrame, shared, salt: int, positions: int, least: int) -> tuple[np.ndarray, int, int]:
    """A bit for every counter of neighbouring frequent words that reaches ``least``; the counters' bits; their sum.

    Pairs share counters, so a set bit may be that of a rare pair, but a pair of an unset one is
    rare: longer phrases need not cross it. Counters are summed by page.
    """
    bits = min(MOST_BITS, max(16, (positions // POSITIONS_A_COUNTER).bit_length()))

    def count(batches):
        counters, counts, held = [], [], 0
        for own, may, which, pieces in _ids(batches, salt, shared.value):
            at = np.flatnonzero(linked(may[which], pieces))
            found, n = np.unique(pair_counter(own[which[at]], own[which[at + 1]], bits), return_counts=True)
            counters.append(found)
            counts.append(n)
            held += len(found)
            if held > HELD_COUNTERS:
                yield from _counted(counters, counts, least)
                counters, counts, held = [], [], 0
        if held:
            yield from _counted(counters, counts, least)

    def add(batches):
        def close(page, total):
            return pa.RecordBatch.from_pydict({"page": [page], "bits": [np.packbits(total >= least, bitorder="little").tobytes()], "n": [int(total[total >= least].sum())]})

        now, total = None, None
        for batch in batches:
            for page, at, n in zip(batch["page"].to_pylist(), batch["at"], batch["n"]):
                if page != now:
                    if now is not None:
                        yield close(now, total)
                    now, total = page, np.zeros(PAGE_COUNTERS, np.int64)
                total[np.frombuffer(at.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<u4")
        if now is not None:
            yield close(now, total)

    counted = rows.mapInArrow(count, "page long, at binary, n binary").repartition("page").sortWithinPartitions("page")
    out, n = np.zeros((1 << bits) // 8, np.uint8), 0
    for r in counted.mapInArrow(add, "page long, bits binary, n long").toLocalIterator():  # 8 KiB a page, 64 MiB at most
        out[r.page * (PAGE_COUNTERS // 8) :][: PAGE_COUNTERS // 8] = np.frombuffer(r.bits, np.uint8)
        n += r.n
    return out, bits, n


def phrase_counts(rows: DataFrame, words: DataFrame, width: int = WORDS, least: int = LEAST, budget: int = BUDGET, part_words: int = PART_WORDS) -> DataFrame:
    """``ids, f``: phrases of 2 to ``width`` words that occur ``least`` times or more, by word ids.

    ``words``: from ``word_counts``. A word, or a pair of words, that is rarer than ``least`` ends
    every phrase. So tasks share two filters of fixed size (64 MiB at most each): frequent words by
    their ids' leading bits, and hashed counters of pairs. From every word on, the window of up to
    ``width`` words that they let through is counted once in a HAT-trie; what a full trie gives up
    leaves as sorted runs, one per prefix partition, in which each window counts for all its
    prefixes. Runs of a partition are merged by sorting; partitions are cut by the first two words,
    of very frequent first words by three (their pairs are summed once more), so none holds all of
    a word.
    """
    spark = rows.sparkSession
    salt = words.schema["id"].metadata["salt"]
    frequent = words.where(F.col("n") >= least)
    n, positions = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    passes = spark.sparkContext.broadcast(Filter(frequent, n))
    pairs, bits, found = frequent_pairs(rows, passes, salt, positions, least)
    parts = max(1, min(MOST_PARTS, -(-found // part_words)))
    # Words that alone could fill partitions: one for so many partitions at most.
    hot = np.sort(np.array([r.id for r in frequent.where(F.col("n") > 4 * part_words).select("id").collect()] if parts > 1 else [], np.int64))
    shared = spark.sparkContext.broadcast((passes.value, pairs, hot))

    def spill(batches):
        passes, pairs, hot = shared.value
        trie, numbers, ids = HatTrie(width, budget), {}, [0]
        for own, may, which, pieces in _ids(batches, salt, passes):
            links = linked(may[which], pieces)
            at = np.flatnonzero(links)
            counter = pair_counter(own[which[at]], own[which[at + 1]], bits)
            links[at] = (pairs[counter >> 3] >> (counter & 7).astype(np.uint8)) & 1 == 1
            code = np.zeros(len(own), np.int64)
            at = np.flatnonzero(links)
            for i in np.unique(which[np.concatenate([at, at + 1])]).tolist():
                k = int(own[i])
                if k not in numbers:
                    numbers[k] = len(ids)
                    ids.append(k)
                code[i] = numbers[k]
            for left in trie.add(windows(code[which], links, width)):
                yield runs(*left, np.array(ids, np.int64), hot, parts)
        while trie.entries:
            yield runs(*trie.spill(trie.entries), np.array(ids, np.int64), hot, parts)
        del trie, numbers, ids
        give_back()

    def merge(batches):
        now, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if blocks and row["part"] != now:
                    yield _found(blocks)
                    blocks = []
                now = row["part"]
                blocks.append(row)
        if blocks:
            yield _found(blocks)

    def _found(blocks):
        found, n, whole = merged(blocks, width, shared.value[2], least)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(whole, pa.bool_())], ["ids", "f", "whole"])

    spilled = rows.mapInArrow(spill, "part long, ids binary, windows binary, wide boolean, counts binary")
    found = saved(spilled.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "ids array<long>, f long, whole boolean"))
    pairs_of_hot = found.where(~F.col("whole")).groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return found.where("whole").select("ids", "f").unionByName(pairs_of_hot)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", width: int = WORDS, least: int = LEAST, top: int | None = TOP, budget: int = BUDGET, part_words: int = PART_WORDS) -> DataFrame:
    """The phrases of every language that hold together best: ``lang, rank, phrase, a, l, r, n, score``.

    ``n`` words of the language; ``a`` occurrences of the phrase, ``least`` or more; its weakest
    cut has parts of ``l`` and ``r`` occurrences and the lowest ``score = floor(1000 a n / (l r))``
    (ties: the earliest cut). Phrases that never occur outside a longer candidate are dropped.
    Ranks go by score, then a (both falling), then phrase in byte order; ``top`` None keeps all.
    Products are decimals of 38 digits and divided exactly.

    Null texts are empty, a null language is ``und``; texts without a word add nothing. Very long
    texts are cut into words whole (one must fit a task). Repeated rows count each time. Empty
    tables give no rows. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), F.encode(F.coalesce(col(text), F.lit("")), "UTF-8").alias("text"))
    words = word_counts(rows)
    phrases = saved(phrase_counts(rows, words, width, least, budget, part_words))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("total"))
    known = saved(words.where(F.col("n") >= least).join(small(sizes, sizes.count()), "lang").select("id", "lang", "word", "total", F.col("n").alias("f")))
    every = known.select(F.array("id").alias("ids"), "f").unionByName(phrases)
    shorter = phrases.where(F.size("ids") > 2).select(
        F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), "f"
    )
    kept = phrases.join(shorter, ["ids", "f"], "left_anti")
    cuts = kept.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("_left"), F.expr("slice(ids, k + 1, size(ids))").alias("_right"))
    cuts = cuts.join(every.select(F.col("ids").alias("_left"), F.col("f").alias("l")), "_left").join(every.select(F.col("ids").alias("_right"), F.col("f").alias("r")), "_right")
    cuts = cuts.join(known.select(F.col("id").alias("_id"), "lang", F.col("total").alias("n")), F.col("ids")[0] == F.col("_id"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumns({"_over": F.lit(1000).cast("decimal(5,0)") * big("a") * big("n"), "_under": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("_over div _under"))
    best = cuts.groupBy("ids", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("ids", "lang", "a", "n", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a")]
    if top is not None:  # with all ties, so that words are looked up for these only
        best = best.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    best = saved(best)
    spelt = best.select("ids", F.posexplode("ids").alias("at", "id")).join(known.select("id", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = best.join(spelt, "ids").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SQL = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM spots, (SELECT unnest(range(1, {WORDS + 1})) AS k) WHERE i + k - 1 <= len(w))
  GROUP BY ALL HAVING k = 1 OR count(*) >= {LEAST}),
totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
longer AS (
  SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1 : k - 1], ' '), array_to_string(string_split(phrase, ' ')[2 : k], ' ')]) AS inner_phrase
  FROM f WHERE k > 2),
kept AS (SELECT * FROM f WHERE k > 1 AND f >= {LEAST} AND NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = f.lang AND x.inner_phrase = f.phrase AND x.f >= f.f)),
cuts AS (SELECT lang, phrase, f AS a, k, unnest(range(1, k)) AS c FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(string_split(cuts.phrase, ' ')[1 : c], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(string_split(cuts.phrase, ' ')[c + 1 : cuts.k], ' ')
  JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE o = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {TOP}
"""


@query("op11_collocations", _SQL)
def op11_collocations(spark, sf):
    """The 2,000 strongest phrases of every language of all documents."""
    return collocations(table(spark, sf, "documents"))
