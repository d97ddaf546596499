"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import col, components, query, saved, table, unused

#: Children of an index node.
FANOUT = 8
#: Query-node pairs looked at together.
FRONTIER = 1 << 18


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each of the 64 bits (the lowest first)."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()  # of bytes: only A-Z change, only the six ASCII blanks separate
    if len(words) >= shingle:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    else:
        pieces, n = iter([b" ".join(words)]), int(bool(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, n) if n else np.empty(0, np.uint64)


def _fingerprints(texts: pa.Array, shingle: int) -> pa.Array:
    out = np.zeros(len(texts), np.uint64)
    power = np.uint64(1) << np.arange(64, dtype=np.uint64)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def close():
        nonlocal held, size
        if held:
            lengths = np.array([len(h) for _, h in held])
            counts = _bit_counts(np.concatenate([h for _, h in held]), np.cumsum(lengths) - lengths)
            out[[i for i, _ in held]] = ((counts * 2 > lengths[:, None]) * power).sum(axis=1, dtype=np.uint64)
        held, size = [], 0

    for i, text in enumerate(texts.cast(pa.binary())):
        h = _hashes(text.as_py() or b"", shingle)
        if len(h):
            held.append((i, h))
            size += len(h)
        if size > 200_000:
            close()
    close()
    return pa.array(out.view(np.int64))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """64-bit SimHash of the shingles of ``text`` as a long.

    Words are separated by ASCII blanks, A-Z are lower-cased, repeated shingles count again.
    A text of fewer words is one shingle; a null or blank text has fingerprint 0.
    """

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return _fingerprints(texts, shingle)

    return simhash(text)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(shift))
    return code


def _rotate(code: np.ndarray, bits: int) -> np.ndarray:
    return code if bits == 0 else (code << np.uint64(bits)) | (code >> np.uint64(64 - bits))


class GrayIndex:
    """Hierarchy over sorted codes: a node keeps the bits that all codes below it share.

    The codes are sorted by the Gray rank of their value, so that neighbours differ in few
    bits. A leaf node is one code; every upper node covers up to FANOUT neighbours that agree
    in the leading ``block`` bits, and the top has one node per value of these bits. A
    node holds the mask and the pattern of the bits that its codes share *beyond* those its
    parent holds, so differences add up on the way down and a node whose sum exceeds the limit
    drops with all codes below it.
    """

    def __init__(self, codes: np.ndarray, block: int):
        self.codes = codes[np.lexsort((gray_rank(codes), codes >> np.uint64(64 - block)))]
        self.top = top = self.codes >> np.uint64(64 - block)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        low, high, group = self.codes, self.codes, top
        levels = [(np.full(len(codes), full), self.codes, None)]
        while True:
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            if len(first) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            starts = np.flatnonzero(place % FANOUT == 0)
            low, high, group = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts), group[starts]
            mask = ~(low ^ high)
            levels.append((mask, low & mask, np.r_[starts, len(levels[-1][0])]))
        self.roots, self.levels = group, levels[::-1]
        shared = self.levels[0][0]  # what remains of each mask below its parent's
        self.rest = [shared]
        for (above, _, starts), (mask, _, _) in zip(self.levels, self.levels[1:]):
            self.rest.append(mask & ~np.repeat(above, np.diff(starts)))

    def within(self, limit: int):
        """Blocks of (i, j) places in ``codes``, i < j, of codes with equal block bits that differ in ``limit`` bits at most."""
        home = np.searchsorted(self.roots, self.top)
        work = [(0, np.arange(len(self.codes)), home, np.zeros(len(self.codes), np.int64))]
        while work:
            depth, asks, nodes, sums = work.pop()
            if len(asks) > FRONTIER:
                half = len(asks) // 2
                work += [(depth, asks[half:], nodes[half:], sums[half:]), (depth, asks[:half], nodes[:half], sums[:half])]
                continue
            _, pattern, starts = self.levels[depth]
            sums = sums + np.bitwise_count((self.codes[asks] ^ pattern[nodes]) & self.rest[depth][nodes])
            near = sums <= limit
            asks, nodes, sums = asks[near], nodes[near], sums[near]
            if starts is None:
                later = asks < nodes
                if later.any():
                    yield asks[later], nodes[later]
            elif len(asks):
                width = starts[nodes + 1] - starts[nodes]
                at = np.repeat(starts[nodes] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                work.append((depth + 1, np.repeat(asks, width), at, np.repeat(sums, width)))


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the sets of the linked places; ``parent`` stays flat and points to the smallest place."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _linked(codes: np.ndarray, rotation: int, block: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code that has a link in this group: itself and a code of its set, enough to hold every set together."""
    index = GrayIndex(_rotate(codes, rotation * block), block)
    parent = np.arange(len(codes))
    for i, j in index.within(limit):
        _join(parent, i, j)
    back = _rotate(index.codes, (64 - rotation * block) % 64)
    linked = parent != np.arange(len(codes))
    return back[linked], back[parent[linked]]


def links(codes: DataFrame, limit: int = 3, bucket_codes: int = 4_096, hot_codes: int = 32_768) -> DataFrame:
    """Links ``(a, b)`` between the distinct longs of ``codes(code)`` whose closure is that of all pairs within ``limit`` bits.

    Two codes that differ in ``limit`` bits agree in one of ``limit + 1`` blocks of bits. For
    each block the codes are rotated so that it leads; codes that agree in it share the top
    mask of a GrayIndex, which finds the others. Many blocks share a group of about
    ``bucket_codes`` codes; a block held by more than ``hot_codes`` codes is cut into pieces,
    and every two pieces meet in a group of their own. A group returns one link per code at
    most, however many pairs it has.
    """
    if not 0 <= limit <= 15:
        raise ValueError("limit must be 0 to 15")
    width = 64 // (limit + 1)
    total = codes.count()
    buckets = max(1, -(-total // bucket_codes))
    value = [F.shiftrightunsigned("code", 64 - width * (r + 1)).bitwiseAND((1 << width) - 1) for r in range(limit + 1)]
    turned = codes.select("code", F.posexplode(F.array(*value)).alias("rotation", "block"))
    sizes = turned.groupBy("rotation", "block").agg(F.count("*").alias("n")).where(F.col("n") > hot_codes)
    pieces = F.ceil(F.col("n") * 2 / hot_codes).cast("int")
    hot = saved(sizes.select("rotation", "block", pieces.alias("pieces")))
    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets))
    if hot.isEmpty():
        dealt = turned.select("rotation", "code", bucket.alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        cold = turned.join(F.broadcast(hot) if hot.count() < 100_000 else hot, ["rotation", "block"], "left")
        mine = F.pmod(F.xxhash64("code"), F.col("pieces")).cast("int")
        cold = cold.withColumn("mine", mine).withColumn("other", F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))))
        cold = cold.where(F.col("pieces").isNull() | (F.col("other") != F.col("mine")))
        dealt = cold.select(
            "rotation", "code", F.when(F.col("pieces").isNull(), bucket).otherwise(-1 - F.col("block")).alias("bucket"),
            F.coalesce(F.least("mine", "other"), F.lit(0)).alias("i"), F.coalesce(F.greatest("mine", "other"), F.lit(0)).alias("j"),
        )

    def search(group: pa.Table) -> pa.Table:
        code = group["code"].to_numpy().view(np.uint64)
        a, b = _linked(code, group["rotation"][0].as_py(), width, limit)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("rotation", "bucket", "i", "j").applyInArrow(search, "a long, b long")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """``(id, fingerprint, group_code, component_id)`` for every row of ``docs``: fingerprints that differ in ``limit`` bits are linked.

    ``group_code`` is the smallest fingerprint of the component, ``component_id`` its smallest
    id. Equal fingerprints are one node, so copies never form pairs. Null texts count as
    empty (fingerprint 0, linked like any other); null ids are never the smallest unless a
    component has no other, then ``component_id`` is null. Repeated rows stay repeated.
    """
    marked = saved(docs.select(col(id).alias("id"), fingerprint(col(text), shingle).alias("fingerprint")))
    classes = saved(marked.groupBy(F.col("fingerprint").alias("code")).agg(F.min("id").alias("rep")))
    sets = components(links(classes.select("code"), limit)).select(F.col("node").alias("code"), F.col("component").alias("group_code"))
    named = classes.join(sets, "code", "left").withColumn("group_code", F.coalesce("group_code", "code"))
    least = named.groupBy("group_code").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "group_code").select(F.col("code").alias("fingerprint"), "group_code", "component_id")
    return marked.join(named, "fingerprint").select("id", "fingerprint", "group_code", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component one row with its smallest id stays.

    Rows that share an id are told apart by their fingerprint; of rows equal in both, any one
    stays. All columns are kept as they are.
    """
    found = saved(groups(docs, id, text, shingle, limit))
    first = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("group_code").agg(F.min("fingerprint").alias("code"), F.min("id").alias("id"))
    unclear = saved(found.groupBy("id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("id").isNull()).select("id"))
    key, code = unused(docs, "_key", "_code")
    first = first.select(F.col("id").alias(key), F.col("code").alias(code))
    if unclear.isEmpty():
        return docs.join(first, col(id) == col(key), "left_semi")
    shared = unclear.select(F.col("id").alias(key))
    same = col(id).eqNullSafe(col(key))
    plain = docs.join(shared, same, "left_anti").join(first, col(id) == col(key), "left_semi")
    mark = unused(docs, "_mark")[0]
    rest = docs.join(shared, same, "left_semi").withColumn(mark, fingerprint(col(text), shingle))
    rest = rest.join(first, same & (col(mark) == col(code)), "left_semi").dropDuplicates([id, mark]).drop(mark)
    return plain.unionByName(rest)


@query("op7_simhash")
def op7_simhash(spark, sf):
    """Fingerprint and component of every document: 3-word shingles, 3 differing bits."""
    found = groups(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
