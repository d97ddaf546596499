"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import join_on, row_index, small
from .base import col, query, saved, table

#: A source's words come at most so many times.
MOST = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Documents of one flight group, and of one lane inside it.
GROUP, LANE = 4_096, 32
#: Documents a source keeps (expected) for the landing, beside what the flights leave over.
RESERVE = 512
#: Equal rows that share one entry until they reach a task.
COPIES = 100
#: A landing that misses the last group's words by more than this share is drawn again, so many times at most.
NEAR, TRIES = 0.002, 64
EPS = 1e-9
BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Words between ASCII blanks; null has none."""
    marks = F.translate(F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "x"), BLANKS, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str = "source", size: str = "source_size", weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (a row per source) with ``target``: all words shared by weight, at most ``most`` times a source's own.

    Sources are weighed in code-point order, null last, by ``weights`` in turn. The target is
    ``least(most * size, level * weight)``: every pass counts, in Spark, the sources above their
    limit at the present level and reshares what they cannot take, until no further one is above.
    """
    ranked = sizes.withColumns({"_all": F.lit(0), "_last": F.col(source).isNull().cast("int")})
    ranked = row_index(ranked, ["_all"], ["_last", source], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = saved(ranked.select(source, size, weight.alias("_weight"), (F.col(size) * float(most)).alias("_limit")))
    total, free = ranked.agg(F.sum(size).cast("double"), F.sum("_weight")).first()
    level, full = (total or 0.0) / (free or 1.0), 0
    while True:
        above = F.col("_limit") < level * F.col("_weight")
        taken, free, n = ranked.agg(F.sum(F.when(above, F.col("_limit"))), F.sum(F.when(~above, F.col("_weight"))), F.count_if(above)).first()
        if n == full or not free:
            break
        level, full = (total - taken) / free, n
    return ranked.select(source, size, F.least("_limit", F.col("_weight") * level).alias("target"))


def _null_vectors(a: np.ndarray) -> np.ndarray:
    """A vector of the null space of every matrix (..., d, d + 1)."""
    if not a.shape[-2]:
        return np.ones((*a.shape[:-2], a.shape[-1]))
    return np.linalg.svd(a)[2][..., -1, :]


def _steps(p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far p may go along v and against it inside the cube."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(v > EPS, (1 - p) / v, np.where(v < -EPS, -p / v, np.inf))
        down = np.where(v > EPS, p / v, np.where(v < -EPS, (p - 1) / v, np.inf))
    return up.min(axis=-1), down.min(axis=-1)


def _moved(p: np.ndarray, v: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """p after one martingale step to a face of the cube: along v as often as the way back is long."""
    up, down = _steps(p, v)
    step = np.where(draw * (up + down) < down, up, -down)
    p = p + step[..., None] * v
    return np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))


def lanes(p: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flights side by side: ``p`` (lanes, units) moves while ``sum(a * p)`` of each lane stays.

    A lane looks at d + 1 undecided units, moves them along a null vector of their d balancing
    columns ``a`` (lanes, units, d) until one is 0 or 1, and takes the next unit in; at most d
    undecided units are left in a lane.
    """
    n, units, d = a.shape
    p, row = p.copy(), np.arange(n)
    slots, ahead = np.full((n, d + 1), -1), np.zeros(n, np.int64)
    open_ = (p > 0) & (p < 1)
    nth = np.where(open_.any(axis=1), open_.argmax(axis=1), units)
    following = np.full((n, units + 1), units)  # the next undecided unit at or after each place
    for j in range(units - 1, -1, -1):
        following[:, j] = np.where(open_[:, j], j, following[:, j + 1])
    ahead = nth
    while True:
        for s in range(d + 1):
            decided = (slots[:, s] < 0) | (p[row, slots[:, s]] <= 0) | (p[row, slots[:, s]] >= 1)
            take = decided & (ahead < units)
            slots[:, s] = np.where(take, ahead, np.where(decided, -1, slots[:, s]))
            ahead = np.where(take, following[row, np.minimum(ahead + 1, units)], ahead)
        on = np.flatnonzero((slots >= 0).all(axis=1))
        if not len(on):
            return p
        at = (on[:, None], slots[on])
        p[at] = _moved(p[at], _null_vectors(a[at].swapaxes(1, 2)), rng.random(len(on)))


def flight(p: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase of one group: lanes, then lanes of what they leave, until at most d units are undecided."""
    p, d = p.copy(), a.shape[1]
    while True:
        left = np.flatnonzero((p > 0) & (p < 1))
        if len(left) <= d:
            return p
        n = -(-len(left) // LANE)
        pad = n * LANE - len(left)
        q = np.concatenate([p[left], np.zeros(pad)]).reshape(LANE, n).T
        b = np.concatenate([a[left], np.zeros((pad, d))]).reshape(LANE, n, d).swapaxes(0, 1)
        p[left] = lanes(q, b, rng).T.reshape(-1)[: len(left)]


def landing(p: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides all units, the first ones first, with all later ones as counterweights.

    The unit in turn moves along its projection on the null space of the balancing columns over
    all undecided units. Where few units are left and nothing can move, the last column is given
    up, then the one before; so the first column is off by less than the last units' share.
    """
    p, d = p.copy(), a.shape[1]
    left = np.flatnonzero((p > 0) & (p < 1))
    while len(left):
        b = a[left, :d].T
        v = np.zeros(len(left))
        v[0] = 1.0
        if d:
            v -= np.linalg.pinv(b) @ b[:, 0]
        if v[0] < 1e-7:
            d -= 1
            continue
        p[left] = _moved(p[left], v / np.abs(v).max(), rng.random())
        left = left[(p[left] > 0) & (p[left] < 1)]
    return p


def landed(p: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The landing that misses the words least.

    A few documents cannot always make up for a large one, so up to ``TRIES`` landings are drawn,
    the second half of them balancing words alone.
    """
    best, least = p, np.inf
    for n in range(TRIES):
        q = landing(p, a if 2 * n < TRIES else a[:, :1], rng)
        off = abs((q - p) @ a[:, 0])
        if off < least:
            best, least = q, off
        if least <= NEAR * (p @ a[:, 0]):
            break
    return best


_UNIT = "id {id}, source {source}, size long, base long, p double, copies long, h long"


def _units(batches: Iterator[pa.RecordBatch], seed: str, decide) -> Iterator[pa.RecordBatch]:
    """Runs ``decide`` over every (source, bucket) of a sorted stream; equal rows are counted out first."""

    def close(parts):
        rows = pa.Table.from_batches(parts)
        copies = rows["copies"].to_numpy()
        rows = rows.take(np.repeat(np.arange(len(copies)), copies)).combine_chunks()
        p, size = rows["p"].to_numpy(), rows["size"].to_numpy().astype(float)
        name = f"{seed}|{rows['source'][0]}|{rows['bucket'][0]}"
        a = np.stack([size / max(1.0, size.max()), np.ones(len(p))], axis=1)
        p = decide(p, a, np.random.default_rng(xxhash.xxh64_intdigest(name)))
        out = rows.drop_columns(["bucket"])
        out = out.set_column(out.column_names.index("p"), "p", pa.array(p))
        out = out.set_column(out.column_names.index("copies"), "copies", pa.array(np.ones(len(p), np.int64)))
        yield from out.to_batches()

    now, parts = None, []
    for batch in batches:
        start = 0
        keys = zip(batch["source"].to_pylist(), batch["bucket"].to_pylist())
        for key, same in groupby(keys):
            n = sum(1 for _ in same)
            if parts and key != now:
                yield from close(parts)
                parts = []
            now = key
            parts.append(batch.slice(start, n))
            start += n
    if parts:
        yield from close(parts)


def _run(units: DataFrame, order: Sequence[Column], seed: str, decide) -> DataFrame:
    ddl = _UNIT.format(id=units.schema["id"].dataType.simpleString(), source=units.schema["source"].dataType.simpleString())
    dealt = units.repartition("source", "bucket").sortWithinPartitions("source", "bucket", *order, "h", "id")
    return dealt.select("id", "source", "size", "base", "p", "copies", "h", "bucket").mapInArrow(lambda b: _units(b, seed, decide), ddl)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 0, group: int = GROUP, reserve: int = RESERVE) -> DataFrame:
    """How often the mix takes every document: ``id, source, size, source_size, target, copies, taken``.

    A document's size is its number of words. A source whose target is r times its size takes
    every document floor(r) times, and the rest of r is an inclusion probability that the cube
    method rounds: probabilities move through the null space of two balancing columns (words,
    documents), so their totals stay. Sources are cut into groups by a hash of id and size; a
    group flies in lanes and leaves at most two undecided documents, which fly again in fewer
    groups. The last group of a source also holds about ``reserve`` of its documents that have
    not flown; there documents land from the largest to the smallest, the undecided rest making
    up for each, so a source's words miss the target by a few of its smallest documents.

    Draws depend on source and group alone: reruns agree, however the rows are dealt out. Null
    texts have no words and empty documents weigh nothing but count as documents; null ids and
    null sources are values like others; equal rows are separate documents (counted before they
    are dealt out, so they do not meet in one task); a very long text is one large document.
    Empty tables give no rows. Other columns are ignored.
    """
    rows = docs.select(col(id).alias("id"), col(source).alias("source"), n_words(col(text)).alias("size"))
    rows = saved(rows.groupBy("id", "source", "size").agg(F.count("*").alias("m")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    goal = saved(join_on(targets(sizes.select("source", "source_size"), weights=weights, most=most), sizes.select("source", "n"), ["source"]))
    n_sources, largest = goal.agg(F.count("*"), F.max("n")).first()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.when(F.abs(ratio - F.round(ratio)) < EPS, F.round(ratio)).otherwise(ratio)
    facts = goal.select("source", "source_size", "target", "n", F.floor(near).alias("base"), (near - F.floor(near)).alias("p"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES)))
    units = rows.select("id", "source", "size", "m", chunk.alias("chunk"))
    units = units.withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("m") - F.col("chunk") * COPIES)).withColumn("h", F.xxhash64(F.lit(seed), "id", "size", "chunk"))
    units = join_on(units, small(facts, n_sources), ["source"])
    kept = F.pmod(F.xxhash64(F.lit("reserve"), "h"), F.lit(1 << 30)) * F.col("n") < reserve * (1 << 30)
    plain = ["id", "source", "size", "base", "p", "copies", "h"]
    whole = units.where(F.col("p") == 0).select(*plain)
    rest = units.where(F.col("p") > 0)
    held = rest.where(kept).select(*plain)
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / group))
    now = rest.where(~kept).withColumn("bucket", F.pmod("h", groups)).select(*plain, "bucket")
    decided, left = [whole], -(-(largest or 0) // group)
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    level = 0
    while (largest or 0) > reserve:
        flown = saved(_run(now, [], f"{seed}|{level}", flight))
        decided.append(flown.where(~undecided))
        now, level = flown.where(undecided), level + 1
        if 2 * left <= group:
            break
        left = -(-2 * left // group)
        now = now.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "h"), F.lit(left)))
    last = held.unionByName(now.select(*plain)).withColumn("bucket", F.lit(-1).cast("long"))
    decided.append(_run(last, [F.desc("size")], f"{seed}|landing", landed))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    out = out.withColumn("times", F.col("base") + F.col("p").cast("long")).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    out = join_on(out.select("id", "source", "size", "times"), small(facts.select("source", "source_size", "target"), n_sources), ["source"])
    return out.select("id", "source", "size", "source_size", "target", F.col("times").alias("copies"), (F.col("size") * F.col("times")).alias("taken"))


@query("op12_mixing")
def op12_mixing(spark, sf):
    """The mix of all documents by source, weights 1, 2, 3 in turn."""
    taken = mix(table(spark, sf, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
