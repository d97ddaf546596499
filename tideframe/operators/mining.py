"""Frequent and discriminatory item sets and sub-sequences of string series.

A model is a table of patterns with their statistics. ``coverage`` is the number of series that match,
``original_size`` the number of series, the binary frequency their ratio; the multi-match frequency
counts every disjoint occurrence of the set. Statistics of a match use the first occurrence of each
item (item sets) or the earliest in-order match (sub-sequences).
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..handle import TS
from ..plans import join_on, saved


def _n_series(ts: TS) -> int:
    return ts.df.select(*ts.keys).distinct().count()


def _first_items(ts: TS) -> DataFrame:
    """(keys, item, first tick, occurrences), built by a map-side combined aggregate."""
    return ts.df.where(F.col("value").isNotNull()).groupBy(*ts.keys, F.col("value").alias("item")).agg(
        F.min("tick").alias("tick"), F.count(F.lit(1)).alias("times")
    )


def frequent_item_sets(ts: TS, min_support: float, max_size: int | None = None) -> DataFrame:
    """Model table (``item_set``, ``item_set_id``, statistics) of the sets that at least ``min_support`` of the series hold."""
    n = _n_series(ts)
    items = saved(_first_items(ts))
    sets = _mine_sets(ts, items, n, min_support, max_size)
    return _with_statistics(ts, items, sets, n)


#: Series of one block of bit lists, and items whose pairs are counted at once.
BLOCK_ROWS, TILE = 16_384, 256


def _mine_sets(ts: TS, items: DataFrame, n: int, min_support: float, max_size) -> DataFrame:
    """The sets level by level: every block of series counts the pairs of last items that follow a common prefix."""
    few = max(1, min_support * n)  # against all series, also those without any common item
    common = items.groupBy("item").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= few)
    common = saved(common.select("item", F.monotonically_increasing_id().alias("_i")))
    blocks = _blocks(items.join(common, items["item"].eqNullSafe(common["item"])).groupBy(*ts.keys).agg(F.collect_list("_i").alias("items")).select("items"))
    found = common.select(F.array("_i").alias("ids"))
    every, length = found, 1
    while max_size is None or length < max_size:  # a longer frequent set extends two that share all but their last items
        length += 1
        tails = found.groupBy(F.slice("ids", 1, length - 2).alias("prefix")).agg(F.sort_array(F.collect_list(F.element_at("ids", -1))).alias("tails"))
        found = saved(_pairs(blocks, tails.where(F.size("tails") > 1)).groupBy("ids").agg(F.sum("n").alias("n")).where(F.col("n") >= few).select("ids"))
        if found.isEmpty():
            break
        every = every.unionByName(found)
    named = every.select("ids", F.explode("ids").alias("_i")).join(common, "_i").groupBy("ids").agg(F.array_sort(F.collect_list("item")).alias("item_set"))
    return saved(named.select("item_set", F.xxhash64(F.array_join("item_set", "\x1f")).alias("item_set_id")))


def _blocks(baskets: DataFrame) -> DataFrame:
    """Vertical bit lists: per block of series (rows of ``items``) the items that occur, each with one bit per series."""
    size = BLOCK_ROWS

    def run(batches):
        part, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def close():
            lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in held])
            ids, at = np.unique(np.concatenate([x.flatten().to_numpy() for x in held]), return_inverse=True)
            order = np.argsort(at, kind="stable")
            series = np.repeat(np.arange(len(lengths)), lengths)[order]
            ends = np.cumsum(np.bincount(at, minlength=len(ids)))
            bits = []
            for a, b in zip(np.r_[0, ends[:-1]], ends):
                row = np.zeros(len(lengths), np.uint8)
                row[series[a:b]] = 1
                bits.append(np.packbits(row).tobytes())
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + made], pa.int64()), "items": pa.array([ids], pa.list_(pa.int64())), "bits": pa.array([bits], pa.list_(pa.binary()))})

        for batch in batches:
            col, at = batch["items"], 0
            while at < len(col):
                held.append(col.slice(at, size - rows))
                at, rows = at + len(held[-1]), rows + len(held[-1])
                if rows == size:
                    yield close()
                    made, held, rows = made + 1, [], 0
        if held:
            yield close()

    return saved(baskets.mapInArrow(run, "block long, items array<long>, bits array<binary>"))


def _pairs(blocks: DataFrame, tails: DataFrame) -> DataFrame:
    """(ids, n) per block: in how many of its series ``prefix`` occurs with two of ``tails``, for the pairs that do.

    A block's bit lists and the prefixes meet in one sorted stream; the counts are products of bit matrices.
    """
    asked = blocks.select("block").crossJoin(tails)
    both = blocks.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.select("block", "kind", "items", "bits", "prefix", "tails").repartition("block").sortWithinPartitions("block", "kind")
    tile = TILE

    def counted(bits, prefix, tails):
        base = bits[prefix[0]] if prefix else np.uint8(255)
        for p in prefix[1:]:
            base = base & bits[p]
        known = np.array([t for t in tails if t in bits], np.int64)
        dense = lambda ids: np.unpackbits(np.stack([bits[t] for t in ids.tolist()]) & base, axis=1).astype(np.float32)
        for i in range(0, len(known), tile):
            left = dense(known[i : i + tile])
            for j in range(i, len(known), tile):
                n = left @ (left if i == j else dense(known[j : j + tile])).T
                x, y = np.nonzero(np.triu(n, 1) if i == j else n)
                if len(x):
                    flat = np.hstack([np.tile(np.array(prefix, np.int64), (len(x), 1)), known[i + x][:, None], known[j + y][:, None]])
                    ids = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())
                    yield pa.RecordBatch.from_pydict({"ids": ids, "n": pa.array(n[x, y].astype(np.int64))})

    def run(batches):
        bits = {}
        for batch in batches:
            for kind, items, packed, prefix, last in zip(batch["kind"].to_pylist(), *(batch[c] for c in ("items", "bits", "prefix", "tails"))):
                if kind == 0:
                    bits = {i: np.frombuffer(b, np.uint8) for i, b in zip(items.as_py(), packed.as_py())}
                elif all(p in bits for p in prefix.as_py()):
                    yield from counted(bits, prefix.as_py(), last.as_py())

    return both.mapInArrow(run, "ids array<long>, n long")


def item_set_matches(ts: TS, sets: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Score: a row per (item set, matching series) with ``first``, ``last`` (ticks of the match) and ``matches``."""
    items = _first_items(ts) if items is None else items
    wanted = sets.select("item_set_id", F.size("item_set").alias("_k"), F.explode("item_set").alias("item"))
    hits = items.join(wanted, "item").groupBy("item_set_id", *ts.keys).agg(
        F.count(F.lit(1)).alias("_have"), F.first("_k").alias("_k"), F.min("tick").alias("first"), F.max("tick").alias("last"), F.min("times").alias("matches")
    )
    return hits.where("_have = _k").drop("_have", "_k")


_FACTS = (("average", F.avg), ("max", F.max), ("min", F.min), ("sd", F.stddev_samp), ("sum", F.sum), ("variance", F.var_samp))


def _duration(matches: DataFrame, ts: TS) -> list:
    """Aggregates of match duration, lead time (start of series to match) and end time (match to end of series)."""
    spans = {"": F.col("last") - F.col("first"), "_lead_time": F.col("first") - F.col("_a"), "_end_time": F.col("_z") - F.col("last")}
    return [F.count(F.lit(1)).alias("count"), *[f(c).alias(f"{name}{suffix}") for suffix, c in spans.items() for name, f in _FACTS]]


def _matched(ts: TS, sets: DataFrame, items: DataFrame) -> DataFrame:
    ends = ts.df.groupBy(*ts.keys).agg(F.min("tick").alias("_a"), F.max("tick").alias("_z"))
    return join_on(item_set_matches(ts, sets, items), ends, ts.keys)


def _statistics(ts: TS, sets: DataFrame, items: DataFrame, n: int) -> DataFrame:
    m = _matched(ts, sets, items)
    dur = _duration(m, ts)
    out = m.groupBy("item_set_id").agg(F.sum("matches").alias("_all"), *dur)
    names = [c for c in out.columns if c not in ("item_set_id", "_all")]
    return out.select(
        "item_set_id", F.col("count").alias("coverage"), F.lit(n).cast("long").alias("original_size"),
        (F.col("count") / F.lit(n)).alias("binary_match_norm_frequency"), (F.col("_all") / F.lit(n)).alias("multi_match_norm_frequency"),
        F.struct(*names).alias("duration_statistics"),
    )


def _with_statistics(ts, items, sets, n) -> DataFrame:
    return sets.join(_statistics(ts, sets, items, n), "item_set_id")


def discriminatory_item_sets(left: TS, right: TS, min_support: float, min_lift: float = 0.0, max_size: int | None = None) -> DataFrame:
    """Sets frequent on the left, with their frequency on both sides; ``lift`` = left / right frequency (null when the right has none)."""
    nl, nr = _n_series(left), _n_series(right)
    items = saved(_first_items(left))
    sets = _mine_sets(left, items, nl, min_support, max_size)
    a = _statistics(left, sets, items, nl).select(
        "item_set_id", F.col("coverage").alias("coverage_left"), F.col("original_size").alias("original_size_left"),
        F.col("binary_match_norm_frequency").alias("binary_match_norm_frequency_left"), "duration_statistics",
    )
    b = item_set_matches(right, sets).groupBy("item_set_id").agg(F.count(F.lit(1)).alias("coverage_right"))
    out = sets.join(a, "item_set_id").join(b, "item_set_id", "left")
    cover = F.coalesce("coverage_right", F.lit(0).cast("long"))
    freq = cover / F.lit(max(nr, 1))
    lift = F.try_divide(F.col("binary_match_norm_frequency_left"), freq)
    out = out.withColumn("coverage_right", cover).withColumn("original_size_right", F.lit(nr).cast("long"))
    out = out.withColumn("binary_match_norm_frequency_right", freq).withColumn("lift", lift)
    return out.where(F.col("lift").isNull() | (F.col("lift") >= min_lift))


# Sub-sequences ----------------------------------------------------------------------------------

#: Rows of a series that one set of position lists covers.
LIST_ROWS = 100_000
#: Pairs of pattern and item that a task counts before it hands them on.
HELD = 1_000_000


def _lists(ts: TS, wanted: DataFrame) -> tuple[DataFrame, bool]:
    """Vertical lists: per series, stretch of ``LIST_ROWS`` rows and item the sorted positions and their ticks.

    ``wanted``: the items (``value``) that matter. Tells also whether any series has several stretches.
    """
    rows = ts.row_index("_rn", ts.df.where(F.col("value").isNotNull()))
    rows = rows.select(*ts.keys, "_rn", "tick", "value").join(wanted, "value", "left_semi")
    size = min(LIST_ROWS, ts.chunk_rows)
    spots = F.array_sort(F.collect_list(F.struct("_rn", "tick")))
    lists = rows.groupBy(*ts.keys, F.floor(F.col("_rn") / size).alias("_c"), "value").agg(spots.alias("_at"))
    many = ts.max_rows() > size
    return saved(lists.select(*ts.keys, "_c", "value", F.col("_at._rn").alias("_rns"), F.col("_at.tick").alias("_ticks"))), many


def _firsts(ts: TS, lists: DataFrame) -> DataFrame:
    """Patterns of one item at their earliest position: (keys, sequence, ticks, at)."""
    first = lists.groupBy(*ts.keys, "value").agg(F.min(F.struct(F.col("_rns")[0].alias("at"), F.col("_ticks")[0].alias("tick"))).alias("_m"))
    return first.select(*ts.keys, F.array("value").alias("sequence"), F.array("_m.tick").alias("ticks"), F.col("_m.at").alias("at"))


def _counts(ts: TS, found: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, value, c): in how many series ``value`` occurs after the match of pattern ``id``; nothing is kept per match.

    An item follows a match where its last position in the series lies behind it.
    """
    keys = list(ts.keys)
    lasts = lists.groupBy(*keys, "value").agg(F.max(F.element_at("_rns", -1)).alias("_last"))
    both = lasts.withColumn("kind", F.lit(0)).unionByName(found.select(*keys, "id", "at", F.lit(1).alias("kind")), allowMissingColumns=True)
    both = both.select(*keys, "kind", "value", "_last", "id", "at").repartition(*keys).sortWithinPartitions(*keys, "kind")
    kind = both.schema["value"].dataType.simpleString()

    def run(batches):
        series, values, lasts = None, [], []
        numbers, total, made = {}, Counter(), None
        for batch in batches:
            made = batch.schema.field("value").type
            ids = list(zip(*[batch[k].to_pylist() for k in keys], batch["kind"].to_pylist()))
            ats, names, start, seen = batch["at"].fill_null(0).to_numpy(), batch["id"].fill_null(0).to_numpy(), 0, []
            for key, same in itertools.groupby(ids):
                end = start + sum(1 for _ in same)
                if key[:-1] != series:
                    series, values, lasts = key[:-1], [], []
                if key[-1] == 0:
                    values += [numbers.setdefault(v, len(numbers)) for v in batch["value"].slice(start, end - start).to_pylist()]
                    lasts += batch["_last"].slice(start, end - start).to_pylist()
                elif values:
                    hit = np.nonzero(np.array(lasts)[None, :] > ats[start:end, None])
                    seen.append((names[start:end][hit[0]], np.array(values)[hit[1]]))
                start = end
            if seen:
                pairs = np.array([np.concatenate(x) for x in zip(*seen)], np.int64)
                pairs = pairs[:, np.lexsort(pairs)]
                new = np.r_[True, (np.diff(pairs) != 0).any(axis=0)] if pairs.shape[1] else np.zeros(0, bool)
                at = np.flatnonzero(new)
                for i, v, n in zip(pairs[0, at].tolist(), pairs[1, at].tolist(), np.diff(np.r_[at, pairs.shape[1]]).tolist()):
                    total[i, v] += n
                if len(total) > HELD:  # many patterns: hand on what is there
                    yield out(total, numbers, made)
                    total = Counter()
        if total:
            yield out(total, numbers, made)

    def out(total, numbers, made):
        names = list(numbers)
        ids, values = zip(*total)
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "value": pa.array([names[v] for v in values], made), "c": pa.array(total.values(), pa.int64())})

    return both.mapInArrow(run, f"id long, value {kind}, c long").groupBy("id", "value").agg(F.sum("c").alias("c"))


def _grow(ts: TS, found: DataFrame, lists: DataFrame, many: bool) -> DataFrame:
    """Extend each (pattern, series) match by those of its items ``next`` that occur after it, at their earliest position.

    Lists and matches of a series (stretch) run side by side through one sorted stream; all matches
    of a pattern look up an item by one binary search over its positions. The lists of one stretch
    are all that is held.
    """
    keys = list(ts.keys)
    if many:
        ends = lists.groupBy(*keys).agg(F.max("_c").alias("_z"))
        size = min(LIST_ROWS, ts.chunk_rows)
        spread = F.explode(F.sequence(F.floor(F.col("at") / size), F.col("_z"))).alias("_c")
        right = join_on(found, ends, keys).select(*keys, spread, "sequence", "ticks", "at", "next")
    else:
        right = found.select(*keys, F.lit(0).cast("long").alias("_c"), "sequence", "ticks", "at", "next")
    both = lists.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.select(*keys, "_c", "kind", "value", "_rns", "_ticks", "sequence", "ticks", "at", "next")
    both = both.repartition(*keys, "_c").sortWithinPartitions(*keys, "_c", "kind")
    kinds = {c: both.schema[c].dataType.simpleString() for c in both.columns}
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{c} {kinds[c]}" for c in ("sequence", "ticks", "value")], "at long", "tick long"])

    def run(batches):
        series, items = None, {}
        for batch in batches:
            ids = list(zip(*[batch[k].to_pylist() for k in [*keys, "_c"]], batch["kind"].to_pylist()))
            ats = batch["at"].fill_null(0).to_numpy()
            parents, values, at, tick, start = [], [], [], [], 0
            for key, same in itertools.groupby(ids):
                end = start + sum(1 for _ in same)
                if key[:-1] != series:
                    series, items = key[:-1], {}
                if key[-1] == 0:
                    part = batch.slice(start, end - start)
                    for v, r, t in zip(part["value"].to_pylist(), part["_rns"], part["_ticks"]):
                        items[v] = (r.values.to_numpy(), t.values.to_numpy())
                else:
                    asked = {}
                    for row, wanted in enumerate(batch["next"].slice(start, end - start).to_pylist(), start):
                        for v in wanted:
                            if v in items:
                                asked.setdefault(v, []).append(row)
                    for v, above in asked.items():
                        (r, t), above = items[v], np.array(above)
                        to = np.searchsorted(r, ats[above], side="right")
                        hit = np.flatnonzero(to < len(r))
                        parents.append(above[hit])
                        values.extend([v] * len(hit))
                        at.append(r[to[hit]])
                        tick.append(t[to[hit]])
                start = end
            if values:
                up = pa.array(np.concatenate(parents))
                old = [batch[c].take(up) for c in [*keys, "sequence", "ticks"]]
                new = [pa.array(values, batch.schema.field("value").type), pa.array(np.concatenate(at), pa.int64()), pa.array(np.concatenate(tick), pa.int64())]
                yield pa.RecordBatch.from_arrays([*old, *new], [*keys, "sequence", "ticks", "value", "at", "tick"])

    grown = both.mapInArrow(run, ddl)
    if many:  # the earliest of all stretches
        nxt = grown.groupBy(*keys, "sequence", "value").agg(F.min(F.struct("at", "tick", "ticks")).alias("_m")).select(*keys, "sequence", "value", "_m.*")
    else:
        nxt = grown
    return nxt.select(*keys, F.concat("sequence", F.array("value")).alias("sequence"), F.concat("ticks", F.array("tick")).alias("ticks"), "at")


def _levels(ts: TS, min_count: float, max_length: int | None) -> DataFrame:
    """Earliest match of every frequent pattern in every series: (keys, sequence, ticks, at), level by level.

    A level is counted before it is built, so only matches of frequent patterns are ever written.
    """
    held = ts.df.where(F.col("value").isNotNull()).groupBy(*ts.keys, "value").agg(F.lit(1)).groupBy("value").agg(F.count("*").alias("_c"))
    lists, many = _lists(ts, held.where(F.col("_c") >= min_count).select("value"))
    found = saved(_firsts(ts, lists))
    every, length = found, 1
    while max_length is None or length < max_length:  # a longer frequent pattern starts with a frequent one
        length += 1
        known = saved(found.select("sequence").distinct().withColumn("id", F.monotonically_increasing_id()))
        more = _counts(ts, found.join(known, "sequence"), lists).where(F.col("c") >= min_count)
        more = saved(more.groupBy("id").agg(F.collect_list("value").alias("next")).join(known, "id").select("sequence", "next"))
        if more.isEmpty():
            break
        found = saved(_grow(ts, found.join(more, "sequence"), lists, many))
        every = every.unionByName(found)
    return every


def _sequence_statistics(matches: DataFrame, n: int) -> DataFrame:
    gaps = F.transform(F.sequence(F.lit(1), F.size("ticks") - 1), lambda i: F.col("ticks")[i] - F.col("ticks")[i - 1])
    gaps = F.when(F.size("ticks") > 1, gaps)
    cover = matches.groupBy("sequence").agg(F.count(F.lit(1)).alias("coverage"))
    flat = matches.select("sequence", F.explode(gaps).alias("_g"))
    inter = flat.groupBy("sequence").agg(
        F.struct(F.avg("_g").alias("average"), F.count("_g").alias("count"), F.max("_g").alias("max"), F.min("_g").alias("min"),
                 F.stddev_samp("_g").alias("sd"), F.sum("_g").alias("sum")).alias("inter_arrival_statistics")
    )
    out = cover.join(inter, "sequence", "left").withColumn("original_size", F.lit(n).cast("long"))
    out = out.withColumn("binary_match_normalized_frequency", F.col("coverage") / F.lit(n))
    return out.withColumn("sequence_id", F.xxhash64(F.array_join("sequence", "\x1f")))


def frequent_sub_sequences(ts: TS, min_support: float, max_length: int | None = None) -> DataFrame:
    """Model table of the ordered patterns (gaps allowed) that at least ``min_support`` of the series hold.

    All lengths are found unless ``max_length`` is given; a low support over long series has many patterns.

    Patterns grow item by item; a match is kept as one row per (pattern, series) with its earliest
    position. Where an item comes next is looked up in its list of positions.
    """
    n = _n_series(ts)
    return _sequence_statistics(_levels(ts, min_support * n, max_length), n)


def sub_sequence_matches(ts: TS, patterns: DataFrame) -> DataFrame:
    """Score: (keys, sequence, ticks) of the earliest match of each pattern (column ``sequence``) in each series."""
    want = saved(patterns.select("sequence").distinct())
    longest = want.agg(F.max(F.size("sequence"))).first()[0] or 0
    prefixes = want.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("sequence")), lambda k: F.slice("sequence", 1, k))).alias("sequence")).distinct()
    prefixes = saved(prefixes)
    lists, many = _lists(ts, prefixes.select(F.explode("sequence").alias("value")).distinct())
    found = saved(_firsts(ts, lists).join(prefixes, "sequence", "left_semi").select(*ts.keys, "sequence", "ticks", "at"))
    every = found
    after = prefixes.where(F.size("sequence") > 1).groupBy(F.expr("slice(sequence, 1, size(sequence) - 1)").alias("sequence")).agg(F.collect_list(F.element_at("sequence", -1)).alias("next"))
    after = saved(after)
    for _ in range(longest - 1):
        found = saved(_grow(ts, found.join(after, "sequence"), lists, many))
        every = every.unionByName(found)
    return every.join(want, "sequence", "left_semi").select(*ts.keys, "sequence", "ticks")


def discriminatory_sub_sequences(left: TS, right: TS, min_support: float, max_length: int | None = None, min_lift: float = 0.0) -> DataFrame:
    """Patterns frequent on the left, with their frequency on both sides; ``lift`` as for item sets."""
    nl, nr = _n_series(left), _n_series(right)
    mine = saved(_sequence_statistics(_levels(left, min_support * nl, max_length), nl))
    theirs = sub_sequence_matches(right, mine).groupBy("sequence").agg(F.count(F.lit(1)).alias("_c"))
    out = mine.withColumnsRenamed({
        "coverage": "coverage_left", "original_size": "original_size_left", "binary_match_normalized_frequency": "binary_match_normalized_frequency_left"
    }).join(theirs, "sequence", "left")
    cover = F.coalesce("_c", F.lit(0).cast("long"))
    out = out.withColumn("coverage_right", cover).withColumn("original_size_right", F.lit(nr).cast("long"))
    out = out.withColumn("binary_match_normalized_frequency_right", cover / F.lit(max(nr, 1))).drop("_c")
    out = out.withColumn("lift", F.try_divide("binary_match_normalized_frequency_left", "binary_match_normalized_frequency_right"))
    return out.where(F.col("lift").isNull() | (F.col("lift") >= min_lift))


def save_model(model: DataFrame, path: str, min_support: float | None = None) -> None:
    """Parquet, with the creation date and the support beside the patterns."""
    model.withColumn("creation_date", F.current_timestamp()).withColumn("min_support", F.lit(min_support)).write.mode("overwrite").parquet(path)
