"""Token ids in training order: a keyed permutation of all sequences into fixed-stride shards."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import col, give_back, query, shared_folder, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids a task remembers, ids that they may have in all (some 60 MB), and bytes encoded at a time.
REMEMBERED, REMEMBERED_IDS, SLICE_BYTES = 400_000, 4_000_000, 2_000_000
#: Row key (8 bytes), number of the sequence in its row (4), tokens in it (2), all little-endian.
HEADER = np.dtype([("key", "<i8"), ("piece", "<i4"), ("size", "<u2")])
NO_KEY = -(1 << 63)


#: A blank followed by one of these does not begin a word: white space of one byte, and of two or three bytes.
_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, list(b"\t\n\v\f\r "))
_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
#: No piece of the pattern goes on from an ASCII letter or digit to an ASCII mark.
_WORD = np.isin(_BYTES, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_MARK = (_BYTES > 0x20) & (_BYTES < 0x7F) & ~_WORD
_APART = "\0"


def _starts(letters: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where stretches begin in the bytes of texts that lie between ``cuts``: each text, each blank before a word, each mark after one."""
    begins = letters == 0x20
    begins[:-1] &= ~_SPACE[letters[1:]]
    begins[cuts[1:][cuts[1:] > cuts[:-1]] - 1] = False  # the last blank of a text
    if letters.max() >= 0x80:
        blanks = np.flatnonzero(begins)
        lead = letters[blanks + 1]
        two, three = blanks[lead == 0xC2], blanks[(lead >= 0xE1) & (lead <= 0xE3)]
        code = lambda at, n: sum(letters[at + 1 + i].astype(np.int64) << 8 * (n - 1 - i) for i in range(n))
        begins[two[np.isin(code(two, 2), _WIDE)]] = False
        begins[three[np.isin(code(three, 3), _WIDE)]] = False
    begins[1:] |= _WORD[letters[:-1]] & _MARK[letters[1:]]
    begins[cuts[:-1][cuts[1:] > cuts[:-1]]] = True
    return np.flatnonzero(begins)


class Tokenizer:
    """Byte-level BPE by a rank file; a text is followed by the end id, which is the size of the vocabulary.

    The word pattern always cuts before the blank in front of a word and between a word and a
    mark behind it. So the distinct stretches between such cuts are encoded once for many texts,
    and those met first are remembered.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.end = max(ranks.values()) + 1
        if self.end > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={_APART: self.end})
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.cuts = np.zeros(0, "<u2"), np.zeros(1, np.int64)  # ids of the known words one after the other

    def _alone(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each encoded alone, and where each word's end; the end id, spelled as a zero, keeps them apart."""
        raw = _APART.encode().join([*words, b""])
        if raw.count(b"\0") == len(words):
            ids = self.bpe.encode_to_numpy(raw.decode(), allowed_special={_APART}, disallowed_special=()).astype("<u2")
            ends = np.flatnonzero(ids == self.end)
            return np.delete(ids, ends), ends - np.arange(len(ends))
        each = [self.bpe.encode_ordinary(w.decode()) for w in words]  # a word has a zero of its own
        return np.array(list(chain.from_iterable(each)), "<u2"), np.cumsum([len(e) for e in each])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, 16 bits each and without end ids, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        cuts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        first, size = int(cuts[0]), int(cuts[-1] - cuts[0])
        if not size:
            return np.zeros(0, "<u2"), np.zeros(len(texts), np.int64)
        data, cuts = texts.buffers()[2].slice(first, size), cuts - first
        starts = _starts(np.frombuffer(data, np.uint8), cuts)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, size)), data]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(number < 0)
        ids, cuts_of = self.ids, self.cuts
        if len(fresh):
            number[fresh] = len(self.known) + np.arange(len(fresh))
            new = [distinct[i] for i in fresh.tolist()]
            more, ends = self._alone(new)
            ids, cuts_of = np.concatenate([ids, more]), np.concatenate([cuts_of, cuts_of[-1] + ends])
            if len(cuts_of) <= REMEMBERED and len(ids) <= REMEMBERED_IDS:  # the words met first are the frequent ones: they stay
                self.known.update(zip(new, number[fresh].tolist()))
                self.ids, self.cuts = ids, cuts_of
        held = pa.Array.from_buffers(pa.large_binary(), len(cuts_of) - 1, [None, pa.py_buffer(2 * cuts_of), pa.py_buffer(ids)])
        out = held.take(pa.array(number[words.indices.to_numpy()]))
        ends = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1)
        ids = np.frombuffer(out.buffers()[2], "<u2", int(ends[-1]) // 2)
        return ids, np.diff(ends[np.searchsorted(starts, cuts)]) // 2

    def encode(self, text: str | None) -> np.ndarray:
        return np.append(self.encode_all(pa.array([text], pa.string()))[0], np.uint16(self.end))

    def decode(self, ids) -> str:
        return self.bpe.decode([int(i) for i in ids if i != self.end])


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, total: int, key: int, rounds: int = 6) -> np.ndarray:
    """Place of each index in a keyed permutation of 0 .. total - 1.

    A balanced Feistel network permutes the smallest even number of bits that holds the
    total; a place beyond the total is permuted again until it falls inside (cycle-walking),
    which takes under four steps on average.
    """
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _mix(np.uint64(key % (1 << 64)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.asarray(index).astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= total]
    return out.astype(np.int64)


@dataclass
class Layout:
    """What a reader needs: slot s lies in shard s // per_shard at byte (s % per_shard) * stride."""

    path: str
    total: int
    length: int
    per_shard: int
    key: int
    end: int

    @property
    def stride(self) -> int:
        return HEADER.itemsize + 2 * self.length + 1

    @property
    def shards(self) -> int:
        return max(1, -(-self.total // self.per_shard))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row ids, token ids and tokens of each row with its end id, about SLICE_BYTES bytes of text at a time."""
    words = tokenizer(path)
    for batch in batches:
        keys = batch["id"].fill_null(NO_KEY).to_numpy()
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
        a = 0
        while a < len(keys):
            b = 1 + int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_BYTES))
            ids, counts = words.encode_all(batch["text"].slice(a, b - a))
            yield keys[a:b], ids, counts + 1
            a = b
    words.forget()
    give_back()


def write(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", length: int = 256, key: int = 1, shard_bytes: int = 16 << 20, ranks: str = RANKS) -> Layout:
    """Write all sequences of ``docs`` in training order below ``path`` and return the layout.

    A row's tokens and the end id are cut into sequences of ``length``, the last one padded
    with end ids. Sequences are numbered through all rows without gaps and a keyed permutation
    gives each number its slot. A shard holds ``per_shard`` consecutive slots in order, each in
    ``stride`` bytes: header, ids (16 bits), a line feed. So slot s is found without an index,
    reading is sequential, and a run resumes at any slot.

    Numbers come from two passes over ``docs``: the first counts the sequences of every
    partition, the second starts each partition at its sum. ``docs`` must give the same rows to
    the same partitions in both passes, as files do; the second pass compares counts and
    content of each partition with the first and fails if they differ, so a table that changes
    is never written wrongly. Tokens are shuffled once, to their shards. Null texts are
    empty and have the end id alone; null ids have the smallest long as key. Ids are integers.
    Repeated rows stay repeated; an empty table gives one empty shard.
    """
    rows = docs.select(col(id).cast("long").alias("id"), col(text).alias("text"))

    def count(batches):
        n = check = 0
        for _, _, sizes in _encoded(batches, ranks):
            n += int((-(-sizes // length)).sum())
            check = zlib.crc32(sizes.tobytes(), check)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "sum": [check]})

    counted = {r.part: (r.n, r.sum) for r in rows.mapInArrow(count, "part long, n long, sum long").collect()}  # a row per partition
    starts, total = {}, 0
    for part in sorted(counted):
        starts[part] = (total, *counted[part])
        total += counted[part][0]
    layout = Layout(path.rstrip("/"), total, length, max(1, shard_bytes // (HEADER.itemsize + 2 * length + 1)), key, tokenizer(ranks).end)
    known = docs.sparkSession.sparkContext.broadcast(starts)  # three numbers per partition

    def emit(batches):
        start, n, wanted = known.value.get(TaskContext.get().partitionId(), (0, 0, 0))
        at, check = start, 0
        for keys, ids, sizes in _encoded(batches, ranks):
            check = zlib.crc32(sizes.tobytes(), check)
            pieces = -(-sizes // length)
            many = int(pieces.sum())
            body = np.full((many, length), layout.end, "<u2")
            first = np.cumsum(pieces) - pieces
            inner = sizes - 1  # the end id is there already
            body.reshape(-1)[np.repeat(first * length - (np.cumsum(inner) - inner), inner) + np.arange(len(ids))] = ids
            head = np.zeros(many, HEADER)
            owner = np.repeat(np.arange(len(keys)), pieces)
            head["key"], head["piece"] = keys[owner], np.arange(many) - first[owner]
            head["size"] = np.minimum(sizes[owner] - head["piece"].astype(np.int64) * length, length)
            record = np.hstack([head.view(np.uint8).reshape(many, -1), body.view(np.uint8).reshape(many, -1)])
            slots = permute(np.arange(at, at + many), total, key)
            at += many
            for a in range(0, many, 20_000):
                part = record[a : a + 20_000]
                cuts = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
                values = pa.Array.from_buffers(pa.binary(), len(part), [None, cuts.buffers()[1], pa.py_buffer(np.ascontiguousarray(part))])
                yield pa.RecordBatch.from_pydict({"slot": slots[a : a + 20_000], "record": values})
        if (at - start, check) != (n, wanted):
            raise ValueError("the input changed between the two passes over it: write it to a table first")

    shard = F.floor(F.col("slot") / F.lit(layout.per_shard)).cast("int")
    placed = rows.mapInArrow(emit, "slot long, record binary").repartitionById(layout.shards, shard).sortWithinPartitions("slot")
    # A text writer puts the line feed after each record; its bytes are written as they are.
    placed.select(F.col("record").cast("string").alias("value")).write.text(f"{layout.path}/shards")
    return layout


def read(spark: SparkSession, layout: Layout, first: int = 0, last: int | None = None) -> DataFrame:
    """``(slot, key, piece, size, ids)`` of the slots from ``first`` up to ``last``, reading only their shards.

    ``ids`` are the sequence's ``size`` ids, 16 bits each; a null row id comes back as null.
    """
    last = layout.total if last is None else min(last, layout.total)

    stride, length, per_shard = layout.stride, layout.length, layout.per_shard
    files = spark.read.format("binaryFile").load(f"{layout.path}/shards").select(F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("int").alias("shard"), "content")
    files = files.where(F.col("shard").between(first // per_shard, max(0, last - 1) // per_shard))


    def cut(batches):
        for batch in batches:
            for shard, content in zip(batch["shard"].to_pylist(), batch["content"]):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                start = shard * per_shard
                a, b = max(0, first - start), max(0, min(len(raw), last - start))
                for i in range(a, b, 20_000):
                    part = raw[i : min(b, i + 20_000)]
                    head = np.ascontiguousarray(part[:, : HEADER.itemsize]).view(HEADER).reshape(-1)
                    bodies = np.ascontiguousarray(part[:, HEADER.itemsize : HEADER.itemsize + 2 * length])
                    ids = pa.array([row[: 2 * n].tobytes() for row, n in zip(bodies, head["size"].tolist())], pa.binary())
                    keys = pa.array(head["key"], pa.int64(), mask=head["key"] == NO_KEY)
                    yield pa.RecordBatch.from_pydict({
                        "slot": np.arange(start + i, start + i + len(part)), "key": keys, "piece": head["piece"].astype(np.int32),
                        "size": head["size"].astype(np.int32), "ids": ids,
                    })

    return files.mapInArrow(cut, "slot long, key long, piece int, size int, ids binary")


@query("op5_training_order")
def op5_training_order(spark, sf):
    """Every sequence as its shard holds it: slot, shard, byte offset, document, tokens and crc32 of the ids."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    layout = write(docs, f"{shared_folder(spark).rstrip('/')}/training-{uuid.uuid4().hex}")
    shard = F.floor(F.col("slot") / F.lit(layout.per_shard))
    out = read(spark, layout).withColumn("shard", shard.cast("int"))
    offset = (F.col("slot") - F.col("shard") * F.lit(layout.per_shard)) * layout.stride
    return out.select("slot", "shard", offset.cast("long").alias("byte_offset"), F.col("key").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
