"""Embedding near-duplicates: inverted lists, residual product codes, table look-up distances, exact check."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import col, components, query, saved, table

#: The sample that centroids and code books are fitted on: so many vectors, and so many bytes of doubles.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
#: Members and queries that meet in one task at most.
BLOCK_MEMBERS, BLOCK_QUERIES = 4_096, 8_192
#: Words of a subspace code book.
BOOK = 64
#: Inverted lists at most.
MAX_LISTS = 2_048
#: How far beyond the border of its own list a vector looks, as a part of the largest distance of a link.
#: Both ends look; their distances from the border add up to at most the link's, so half finds every link.
REACH = 0.5


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's steps from evenly spaced rows; an empty cluster keeps its centre."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances less the squared length of the row, which all centres share."""
    return np.square(centers).sum(axis=1) - 2 * x @ centers.T


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return _gaps(x, centers).argmin(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


@dataclass
class Quantizer:
    """Coarse centres and one code book per subspace of the residuals, all over unit vectors."""

    centers: np.ndarray
    apart: np.ndarray  # distances between the centres
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Quantizer:
        centers = _kmeans(x, max(1, min(lists, len(x))))
        rest = x - centers[_nearest(x, centers)]
        d = x.shape[1]
        parts = max(1, min(d, 16))
        cuts = [round(d * i / parts) for i in range(parts + 1)]
        books = [_kmeans(np.ascontiguousarray(rest[:, a:b]), min(BOOK, len(x))) for a, b in zip(cuts, cuts[1:])]
        gaps = np.square(centers).sum(axis=1)[:, None] + _gaps(centers, centers)
        return cls(centers, np.sqrt(np.maximum(gaps, 0)).astype(np.float32), books, cuts)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centers[lists]
        return np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.centers[lists] + np.hstack([book[codes[:, j]] for j, book in enumerate(self.books)])

    def probes(self, x: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Own list per row, and which other lists have a border within ``slack`` of the row.

        A vector of list l lies on l's side of the border between l and the row's own list; the
        row's distance from that border bounds its distance from the vector.
        """
        gaps = _gaps(x, self.centers)
        own = gaps.argmin(axis=1)
        return own, gaps - gaps[np.arange(len(x)), own][:, None] <= 2 * slack * self.apart[own] + 1e-6

    def tables(self, x: np.ndarray, center: int) -> np.ndarray:
        """Row x subspace x word: inner products of the rows with the code words; the centre's is added to the first."""
        out = np.stack([self._padded(x[:, a:b] @ book.T) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1)
        out[:, 0] += (x @ self.centers[center])[:, None]
        return out.astype(np.float32)

    @staticmethod
    def _padded(products: np.ndarray) -> np.ndarray:
        return np.pad(products, ((0, 0), (0, BOOK - products.shape[1])))


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite linked places; ``parent`` stays flat and points to the smallest."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _vectors(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _search(group: pa.Table, model: Quantizer, least: float) -> pa.Table:
    """Links of one block of members with one block of queries: per class its linked vectors and a class of its set."""
    d = model.centers.shape[1]
    x = unit(_vectors(group["x"], d))
    ids, n = group["cid"].to_numpy(), group["n"].to_numpy()
    member = group["member"].to_numpy(zero_copy_only=False).astype(bool)
    rank = group["rank"].to_numpy()  # a pair counts in the task of its higher rank's query
    m, q = np.flatnonzero(member), np.flatnonzero(~member)
    if not len(m) or not len(q):
        return pa.table({"cid": ids[:0], "links": n[:0], "root": ids[:0]})
    codes = np.frombuffer(b"".join(group["code"].take(m).to_pylist()), np.uint8).reshape(len(m), -1)
    home = int(group["list"][0].as_py())
    origin, lists = group["home"].to_numpy(), len(model.centers)
    asks = group["probes"].combine_chunks().take(pa.array(m))
    asking = np.repeat(m, asks.value_lengths().to_numpy()) * lists + asks.flatten().to_numpy()  # members and the lower lists they ask
    error = np.sqrt(np.square(x[m] - model.decode(codes, np.full(len(m), home))).sum(axis=1)).astype(np.float32)
    links, parent = np.zeros(len(x), np.int64), np.arange(len(x))
    for at in range(0, len(q), 256):
        ask = q[at : at + 256]
        look = model.tables(x[ask], home)
        score = np.zeros((len(ask), len(m)), np.float32)
        for j in range(codes.shape[1]):
            score += look[:, j, codes[:, j]]
        a, b = np.nonzero(score + error >= least - 1e-4)  # no vector is nearer than its code less its error
        a, b = ask[a], m[b]
        right = rank[a] > rank[b]
        a, b = a[right], b[right]
        once = (origin[a] >= home) | ~np.isin(b * lists + origin[a], asking)  # what both ask counts for the higher list's vector
        a, b = a[once], b[once]
        exact = np.einsum("ij,ij->i", x[a], x[b]) >= least
        a, b = a[exact], b[exact]
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        _join(parent, a, b)
    hit = np.flatnonzero(links)
    return pa.table({"cid": ids[hit], "links": links[hit], "root": ids[parent[hit]]})


def _valid(x: Column) -> Column:
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def class_links(classes: DataFrame, d: int, least: float = 0.95, reach: float = REACH) -> DataFrame:
    """``(cid, links, root)`` rows between distinct vectors ``classes(cid, n, x)`` of ``d`` components.

    ``links``: how many vectors of other classes a class is linked to, in parts to be added;
    ``root``: another class of the same component, or itself. A class appears only with links.
    """
    total = classes.count()
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(bound).select("x").toArrow()["x"]
    model = Quantizer.fit(unit(_vectors(sample, d)), min(MAX_LISTS, int(math.sqrt(total) / 2) + 1))
    lists = len(model.centers)
    shared = classes.sparkSession.sparkContext.broadcast(model)  # at most a few code books over the bounded sample
    slack = reach * math.sqrt(2 - 2 * least)

    @F.arrow_udf("struct<list:int,code:binary,probes:array<int>>")
    def place(vectors: pa.Array) -> pa.Array:
        x = unit(_vectors(pa.chunked_array([vectors]), d))
        homes, probes = [], []
        for part in np.array_split(x, len(x) // 1024 + 1):
            own, near = shared.value.probes(part, slack)
            homes.append(own)
            near[np.arange(len(own)), own] = False
            probes += [np.flatnonzero(row).tolist() for row in near]
        own = np.concatenate(homes)
        codes = shared.value.encode(x, own)
        fields = [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(probes, pa.list_(pa.int32()))]
        return pa.StructArray.from_arrays(fields, ["list", "code", "probes"])

    placed = saved(classes.withColumn("p", place("x")).select("cid", "n", "x", "p.list", "p.code", "p.probes"))
    sizes = {r.list: r.n for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    asks = {r.l: r.n for r in placed.select(F.explode("probes").alias("l")).groupBy("l").agg(F.count("*").alias("n")).collect()}
    members = F.array(*[F.lit(-(-sizes.get(i, 1) // BLOCK_MEMBERS)) for i in range(lists)])
    queries = F.array(*[F.lit(-(-(asks.get(i, 0) + sizes.get(i, 0)) // BLOCK_QUERIES) or 1) for i in range(lists)])
    salt = lambda seed, parts: F.pmod(F.xxhash64("cid", F.lit(seed)), parts).cast("int")
    low = placed.select(
        "cid", "n", "x", "code", F.col("list"), F.col("list").alias("home"), F.filter("probes", lambda p: p < F.col("list")).alias("probes"),
        F.lit(True).alias("member"), F.col("cid").alias("rank"),
        salt(1, members[F.col("list")]).alias("block"), F.explode(F.sequence(F.lit(0), queries[F.col("list")] - 1)).alias("part"),
    )
    asked = placed.withColumn("to", F.explode(F.concat("probes", F.array("list"))))
    own = F.col("to") == F.col("list")
    high = asked.select(
        "cid", "n", "x", "code", F.col("to").alias("list"), F.col("list").alias("home"), F.expr("array()").cast("array<int>").alias("probes"), F.lit(False).alias("member"),
        F.when(own, F.col("cid")).otherwise(F.lit((1 << 63) - 1)).alias("rank"),
        F.explode(F.sequence(F.lit(0), members[F.col("to")] - 1)).alias("block"), salt(2, queries[F.col("to")]).alias("part"),
    )

    def search(group: pa.Table) -> pa.Table:
        return _search(group, shared.value, least)

    return low.unionByName(high).groupBy("list", "block", "part").applyInArrow(search, "cid long, links long, root long")


def near(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", least: float = 0.95, reach: float = REACH) -> DataFrame:
    """``(id, n_links, component_id)`` for every row: links are pairs of cosine ``least`` or more.

    Equal vectors are one class, which links to others once and counts as often as it
    occurs. Null or zero vectors and those with null or non-finite components link with
    nothing, nor do vectors of different lengths. Candidates come from inverted lists and
    residual product codes; every link is an exact cosine in double precision. A vector looks
    into its own list and all whose border lies within ``reach`` times the largest distance of
    a link; as both ends of a link look, 0.5 or more finds every link. ``component_id`` is the smallest id reachable; null ids are never
    the smallest unless a component has no other. Repeated rows stay repeated and are linked.
    """
    marked = vectors.select(col(id).alias("id"), col(embedding).alias("x")).withColumn("ok", _valid(F.col("x")))
    keys = [F.when(F.col("ok"), F.xxhash64("x", F.lit(s))).alias(k) for s, k in ((1, "h"), (2, "k"))]
    marked = marked.select("id", "x", "ok", *keys)
    classes = marked.where("ok").groupBy("h", "k").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x"))
    classes = saved(classes.withColumn("d", F.size("x"))).withColumn("cid", F.monotonically_increasing_id())  # of written rows, so it stays
    found = None
    for d in [r.d for r in classes.select("d").distinct().collect()]:
        part = class_links(classes.where(F.col("d") == d).select("cid", "n", "x"), d, least, reach)
        found = part if found is None else found.unionByName(part)
    plain = classes.select("cid", "h", "k", "rep", "n")
    if found is None:
        named = plain.select("h", "k", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    else:
        found = saved(found)
        degree = found.groupBy("cid").agg(F.sum("links").alias("links"))
        sets = components(found.select("cid", "root"), "cid", "root").select(F.col("node").alias("cid"), "component")
        joined = plain.join(degree, "cid", "left").join(sets, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        least_id = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = joined.join(least_id, "component").select("h", "k", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = marked.where("ok").select("id", "h", "k").join(named, ["h", "k"]).select("id", "n_links", "component_id")
    alone = marked.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


@query("op6_embeddings")
def op6_embeddings(spark, sf):
    """Links and component of every vector at cosine 0.95."""
    found = near(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
