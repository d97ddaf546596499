"""Order-based building blocks that survive a hot key.

Every operator that needs "the rows of one series in order" is written on four blocks:

* ``row_index``  0-based position of each row in its series
* ``running``    unbounded carries (running sum / max, previous / next non-null value)
* ``frame``      bounded row frames (lag, lead, moving aggregates)
* ``fold``       a sequential Python state machine

When no series has more than ``rows`` rows (checked with one pre-aggregated count) they are
plain windows per key. Otherwise the hot series are cut into chunks of about ``rows`` rows, each
chunk is processed on its own, and only a summary row per chunk is carried along the series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce as _reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import saved

CHUNK_ROWS = 1_000_000
BROADCAST_ROWS = 200_000
_BUCKETS = 2048


def join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``cols`` in which null keys match; right's copies are dropped."""
    names = {c: f"_r_{c}" for c in cols}
    right = right.withColumnsRenamed(names)
    cond = _reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[names[c]]) for c in cols])
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast ``df`` when its counted size ``n`` allows it."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def is_bounded(df: DataFrame, keys: Sequence[str], rows: int | None) -> bool:
    """True when no key has more than ``rows`` rows; ``None`` says that this is known already."""
    if rows is None:
        return True
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).isEmpty()


def longest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def _scale(df: DataFrame, c: str, step: int) -> Column | None:
    """An order column as a double to cut by. None: it has no (further) scale.

    Values that a double cannot tell apart differ in a later step: a string goes on with its next
    six bytes, a long, timestamp or decimal with what the doubles before left of it.
    """
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        block = F.substring(F.encode(F.col(c), "UTF-8"), 6 * step + 1, 6)
        return F.when(F.col(c).isNotNull(), F.conv(F.rpad(F.hex(block), 12, "0"), 16, 10).cast("double"))
    value, exact = F.col(c), None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value, exact = F.unix_micros(value.cast("timestamp")), "decimal(38,0)"
    elif isinstance(kind, T.LongType):
        exact = "decimal(38,0)"
    elif isinstance(kind, T.DecimalType):
        exact = f"decimal(38,{kind.scale})"
    elif isinstance(kind, T.BooleanType):
        value = value.cast("int")
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif not isinstance(kind, T.NumericType):
        return None
    if step and (exact is None or step > _steps(kind)):
        return None
    for _ in range(step):
        value = value.cast(exact) - F.coalesce(value.cast("double").try_cast(exact), F.lit(0).cast(exact))
    return value.cast("double")


def _steps(kind: T.DataType) -> int:
    """Further steps that tell all values of a type apart."""
    if isinstance(kind, T.DecimalType):
        return 2 if kind.precision > 15 else 0
    return 1 if isinstance(kind, (T.LongType, T.TimestampType, T.TimestampNTZType)) else 0


def add_chunk(df: DataFrame, keys: Sequence[str], by: Sequence[str], rows: int) -> tuple[DataFrame, int]:
    """Add ``_chunk``: an orderable cut of every hot series into about ``rows`` rows.

    Equal-depth cuts come from a pre-aggregated histogram of the first order column between its 1st and
    99th percentile, the rest at both ends being a bucket each; so every cut splits a chunk, whatever
    the scale or the outliers. A chunk that is still too full is cut again, until none is or its rows
    are equal in that column; then by the next one. A string is cut by its bytes. Only rows that are
    equal in all order columns stay together.
    Returns the frame and the number of chunks (0: nothing was hot and ``_chunk`` is absent).
    """
    left = [(c, 0) for c in by]
    group, path, chunks = list(keys), [], 0
    while left:
        pos = _scale(df, *left[0])
        if pos is None:
            break
        column, step = left[0]
        text = isinstance(df.schema[column].dataType, T.StringType)
        finite = F.when(~F.isnan(pos) & (F.abs(pos) != float("inf")), pos)
        ends = F.percentile_approx(finite, F.array(F.lit(0.01), F.lit(0.99)), F.lit(1000))
        hot = saved(
            df.groupBy(*group)
            .agg(
                F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_least"), F.max(pos).alias("_most"), F.count(pos).alias("_there"), ends.alias("_ends"),
                (F.max(F.octet_length(column)) if text else F.lit(0)).alias("_length"),
            )
            .where(F.col("_n") > (2 * rows if path else rows))
            .select(*group, "_n", "_least", "_most", "_there", F.col("_ends")[0].alias("_lo"), F.col("_ends")[1].alias("_hi"), "_length")
        )
        uneven = (F.col("_least") < F.col("_most")) | ((F.col("_there") > 0) & (F.col("_there") < F.col("_n")))
        n_hot, n_wide, length = hot.agg(F.count(F.lit(1)), F.count_if(uneven), F.max("_length")).first()
        if n_hot == 0:
            break
        if n_wide == 0:
            left.pop(0)
            if length > 6 * (step + 1) if text else step < _steps(df.schema[column].dataType):
                left.insert(0, (column, step + 1))
            continue
        name, bucket = f"_c{len(path)}", F.col("_bucket")
        lo, hi = F.col("_lo"), F.col("_hi")
        inner = F.floor((pos - lo) / (hi - lo) * (_BUCKETS - 1)).cast("long") + 1
        df = join_on(df, small(hot.select(*group, "_lo", "_hi", F.lit(True).alias("_is_hot")), n_hot), group, "left").withColumn(
            "_bucket",
            F.when(F.col("_is_hot").isNull(), F.lit(None).cast("long"))
            .when(pos.isNull(), F.lit(-1).cast("long"))
            .when(lo.isNull(), F.when(F.isnan(pos), 2).when(pos > 0, 1).otherwise(0).cast("long"))
            .when(pos < lo, F.lit(0).cast("long"))
            .when(pos > hi, F.lit(_BUCKETS + 1).cast("long"))
            .when(hi > lo, inner)
            .otherwise(F.lit(1).cast("long")),
        )
        before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        seen = F.coalesce(F.sum("_n").over(before), F.lit(0))
        # A new chunk starts where the rows so far pass a multiple of ``rows``, and around a bucket too full for one.
        full = F.col("_n") > rows
        cuts = saved(
            df.where(bucket.isNotNull())
            .groupBy(*group, "_bucket")
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_seen", seen)
            .withColumn("_full", F.coalesce(F.sum(full.cast("int")).over(before), F.lit(0)))
            .select(*group, "_bucket", (F.floor(F.col("_seen") / rows) + F.col("_full") + full.cast("int")).alias(name))
        )
        n_cuts = n_hot * (_BUCKETS + 3)  # an upper bound, also on the number of chunks
        chunks += n_cuts
        df = join_on(df, small(cuts, n_cuts), [*group, "_bucket"], "left").drop("_bucket", "_lo", "_hi", "_is_hot")
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))
        group.append(name)
        path.append(name)
    if not path:
        return df, 0
    # The count travels with the column, so later steps on the same rows need not cut again.
    return df.withColumn("_chunk", F.array(*path)).withMetadata("_chunk", {"chunks": chunks}).drop(*path), chunks


def _asc(by):
    return [F.col(c).asc() for c in by]


def _desc(by):
    return [F.col(c).desc() for c in by]


# kind -> (direction, include own row)
_KINDS = {
    "sum": ("fwd", True),
    "sum_before": ("fwd", False),
    "max": ("fwd", True),
    "max_before": ("fwd", False),
    "min": ("fwd", True),
    "last": ("fwd", True),
    "last_before": ("fwd", False),
    "first": ("bwd", True),
    "first_after": ("bwd", False),
}


def _over(kind: str, col: Column, fwd, bwd) -> Column:
    direction, own = _KINDS[kind]
    w = (fwd if direction == "fwd" else bwd).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    base = kind.split("_")[0]
    if base in ("last", "first"):
        return F.last(col, ignorenulls=True).over(w)  # a backward window runs in descending order
    return {"sum": F.sum, "max": F.max, "min": F.min}[base](col).over(w)


def running(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    specs: dict[str, tuple[str, str]],
    rows: int = CHUNK_ROWS,
    bounded: bool | None = None,
) -> DataFrame:
    """Add unbounded carries ``{out: (kind, column)}``; kinds are the keys of ``_KINDS``.

    A frame that already has ``_chunk`` is not cut again and keeps the column.
    """
    chunks, cut = 0, "_chunk" in df.columns
    if cut:
        chunks = df.schema["_chunk"].metadata.get("chunks", BROADCAST_ROWS + 1)
    elif not (bounded or (bounded is None and is_bounded(df, keys, rows))):
        df, chunks = add_chunk(df, keys, by, rows)
    part = [*keys, "_chunk"] if chunks else list(keys)
    fwd = Window.partitionBy(*part).orderBy(*_asc(by))
    bwd = Window.partitionBy(*part).orderBy(*_desc(by))
    out = df.withColumns({o: _over(k, F.col(c), fwd, bwd) for o, (k, c) in specs.items()})
    if not chunks:
        return out
    pos = F.struct(*by)

    def summary(kind, col):
        base = kind.split("_")[0]
        if base in ("last", "first"):
            pick = F.max_by if base == "last" else F.min_by
            return pick(col, F.when(col.isNotNull(), pos))
        return {"sum": F.sum, "max": F.max, "min": F.min}[base](col)

    table = df.groupBy(*part).agg(*[summary(k, F.col(c)).alias(f"_s_{o}") for o, (k, c) in specs.items()])
    along_f = Window.partitionBy(*keys).orderBy(F.col("_chunk").asc())
    along_b = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc())
    def carried(kind, col):
        base = kind.split("_")[0]
        w = (along_f if _KINDS[kind][0] == "fwd" else along_b).rowsBetween(Window.unboundedPreceding, -1)
        if base in ("last", "first"):
            return F.last(col, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max, "min": F.min}[base](col).over(w)

    carry = table.select(*part, *[carried(k, F.col(f"_s_{o}")).alias(f"_i_{o}") for o, (k, _) in specs.items()])
    # Only chunks of hot series have anything carried in; their number was counted above.
    carry = carry.where(" OR ".join(f"_i_{o} IS NOT NULL" for o in specs))
    out = join_on(out, small(carry, chunks), part, "left")

    def merge(kind, local, into):
        base = kind.split("_")[0]
        if base == "sum":
            return F.coalesce(local + into, local, into)
        if base in ("max", "min"):
            return (F.greatest if base == "max" else F.least)(local, into)
        return F.coalesce(local, into)

    out = out.withColumns({o: merge(k, F.col(o), F.col(f"_i_{o}")) for o, (k, _) in specs.items()})
    return out.drop(*([] if cut else ["_chunk"]), *[f"_i_{o}" for o in specs])


def row_index(df, keys, by, out="rn", rows=CHUNK_ROWS, bounded=None) -> DataFrame:
    """Add the 0-based position of each row in its series."""
    if bounded or (bounded is None and is_bounded(df, keys, rows)):
        w = Window.partitionBy(*keys).orderBy(*_asc(by))
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    counted = running(ones, keys, by, {out: ("sum", "_one")}, rows, bounded=False)
    return counted.withColumn(out, F.col(out) - 1).drop("_one")


def frame(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    exprs: Callable[[Window], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    rows: int = CHUNK_ROWS,
    bounded: bool | None = None,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    A hot series is cut into equal blocks of positions; each block takes a copy of its neighbours'
    edge rows along, so no window sees more than one block.
    """
    if bounded or (bounded is None and is_bounded(df, keys, rows)):
        return df.withColumns(exprs(Window.partitionBy(*keys).orderBy(*_asc(by))))
    size = max(rows, before, after, 1)
    df = row_index(df, keys, by, "_at", rows, bounded=False)
    blk, off = F.floor(F.col("_at") / size), F.col("_at") % size
    none = F.lit(None).cast("long")
    homes = F.array_compact(
        F.array(blk, F.when(off >= size - before, blk + 1).otherwise(none), F.when(off < after, blk - 1).otherwise(none))
    )
    df = df.withColumn("_home", F.explode(homes))
    out = df.withColumns(exprs(Window.partitionBy(*keys, "_home").orderBy("_at")))
    return out.where(F.col("_home") == blk).drop("_at", "_home")


#: Rounds in which blocks run side by side before what has not settled is run in order.
FOLD_ROUNDS = 3


def fold(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    columns: Sequence[str],
    step: Callable[[pd.DataFrame, str], tuple[pd.DataFrame, str]],
    init: str,
    schema: str,
    rows: int = 100_000,
    start: DataFrame | None = None,
) -> DataFrame:
    """Run a sequential state machine along each series.

    ``step(block, state) -> (rows, state)`` gets at most ``rows`` ordered rows and the state left by
    the block before (a string). Blocks run side by side from ``init``; a block is run again only
    while the state handed to it differs from the one it used, so state machines that reset settle
    in a round or two. After ``FOLD_ROUNDS`` rounds the rest of every series whose state never
    forgets runs through one sorted stream, from its first unsettled block on and a batch at a time:
    tables and task time stay linear in the blocks, and all results are exact. ``schema`` describes
    the rows ``step`` returns, without the keys. ``start`` (keys, ``_init``) has the states that
    series begin with instead of ``init``.
    """
    keys = list(keys)
    bounded = is_bounded(df, keys, rows)
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    lead = list(dict.fromkeys([*by, *columns]))
    narrow = df.select(*dict.fromkeys([*keys, *lead]))
    if bounded:
        if start is not None:
            narrow = join_on(narrow, start.select(*keys, "_init"), keys, "left")

        def whole(key, pdf):
            at = init
            if "_init" in pdf.columns:
                given = pdf.pop("_init").iat[0]
                at = init if given is None else given
            out, _ = step(pdf.sort_values(list(by)).reset_index(drop=True), at)
            for i, k in enumerate(keys):
                out[k] = key[i]
            return out

        return narrow.groupBy(*keys).applyInPandas(whole, f"{key_ddl}, {schema}")
    blocks = row_index(narrow, keys, by, "_rn", rows, bounded=False)
    blocks = saved(blocks.withColumn("_blk", F.floor(F.col("_rn") / rows)))
    group = [*keys, "_blk"]

    def states(key, pdf):
        at = pdf.pop("_in").iat[0]
        _, state = step(pdf.sort_values("_rn").reset_index(drop=True), at)
        return pd.DataFrame([[*key, state]], columns=[*group, "_out"])

    ids = blocks.select(*group).distinct().withColumn("_in", F.lit(init))
    if start is not None:
        given = F.when(F.col("_blk") == 0, F.coalesce("_init", F.lit(init))).otherwise(F.lit(init))
        ids = join_on(ids, start.select(*keys, "_init"), keys, "left").withColumn("_in", given).drop("_init")
    used = saved(ids)
    n_blocks = used.count()
    out_states, todo = None, used
    along = Window.partitionBy(*keys).orderBy("_blk")
    for _ in range(FOLD_ROUNDS):
        ran = join_on(blocks, small(todo, n_blocks), group).groupBy(*group).applyInPandas(states, f"{key_ddl}, _blk long, _out string")
        if out_states is not None:
            ran = saved(ran)
            ran = ran.unionByName(join_on(out_states, ran, group, "left_anti"))
        out_states = saved(ran)
        # The first block keeps the state it began with.
        handed = join_on(used, out_states, group).withColumn("_new", F.coalesce(F.lag("_out").over(along), F.col("_in")))
        both = saved(handed.select(*group, "_in", "_new"))
        todo = both.where(~F.col("_in").eqNullSafe(F.col("_new"))).select(*group, F.col("_new").alias("_in"))
        if todo.isEmpty():
            break
        used = both.select(*group, F.col("_new").alias("_in"))

    def emit(key, pdf):
        at = pdf.pop("_in").iat[0]
        out, _ = step(pdf.sort_values("_rn").reset_index(drop=True), at)
        for i, k in enumerate(keys):
            out[k] = key[i]
        return out

    ddl = f"{key_ddl}, {schema}"
    # Up to its first unsettled block a series has the right states.
    first = saved(todo.groupBy(*keys).agg(F.min_by(F.struct(F.col("_blk").alias("_first"), F.col("_in").alias("_from")), "_blk").alias("_f")).select(*keys, "_f.*"))
    if first.isEmpty():
        return join_on(blocks, small(used, n_blocks), group).groupBy(*group).applyInPandas(emit, ddl)
    spared = join_on(used, small(first.select(*keys, "_first"), n_blocks), keys, "left").where("_first IS NULL OR _blk < _first").drop("_first")
    done = join_on(blocks, small(spared, n_blocks), group).groupBy(*group).applyInPandas(emit, ddl)
    rest = join_on(blocks, small(first, n_blocks), keys).where("_blk >= _first")
    rest = rest.withColumn("_in", F.when(F.col("_rn") == F.col("_first") * rows, F.col("_from"))).drop("_first", "_from", "_blk")

    def run(batches):
        state = None
        for pdf in batches:
            given = pdf.pop("_in")
            starts = [i for i, x in enumerate(given.notna().tolist()) if x]  # the first row of each series
            for i, j in zip([0, *starts], [*starts, len(pdf)]):
                if i == j:
                    continue
                part = pdf.iloc[i:j].reset_index(drop=True)
                state = given.iat[i] if given.notna().iat[i] else state
                out, state = step(part, state)
                for k in keys:
                    out[k] = part[k].iat[0]
                yield out

    stream = rest.repartition(*keys).sortWithinPartitions(*keys, "_rn")
    return done.unionByName(stream.mapInPandas(run, ddl))
