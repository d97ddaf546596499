"""Segmentation. Every segmenter returns ``Segments``: a row per (key, seg_id, observation)."""

from __future__ import annotations

import json
from dataclasses import replace
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..handle import Segments, Sliding, TS, as_column
from ..plans import fold, frame, join_on
from .joins import within
from .scan import decay_scan


def _segments(ts: TS, df: DataFrame, has_bounds=False) -> Segments:
    bounds = ["seg_start", "seg_end"] if has_bounds else []
    out = df.select(*ts.keys, "seg_id", *bounds, "tick", *ts.ord, "value")
    fits = ts.known_max is not None and ts.known_max <= ts.chunk_rows
    return Segments(out, ts.keys, ts.ord, has_bounds, ts.chunk_rows, ts.trs, fits)


def segment(ts: TS, window: int, step: int = 1, enforce_size: bool = True) -> Segments:
    """Sliding windows of ``window`` rows every ``step`` rows; ``enforce_size`` drops short ones."""
    rn = F.col("_rn")
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((rn - (window - 1)) / step))
    hi = F.floor(rn / step)
    df = ts.row_index("_rn")
    if enforce_size:
        sizes = ts.df.groupBy(*ts.keys).agg(F.count(F.lit(1)).alias("_n"))
        df = join_on(df, sizes, ts.keys)
        last = F.floor((F.col("_n") - window) / step)
        hi = F.least(hi, last)
        df = df.where(F.col("_n") >= window)
    whole = df.withColumns({"_at": rn, "_last": last if enforce_size else F.lit(None).cast("long")})
    df = df.where(lo <= hi).withColumn("seg_id", F.explode(F.sequence(lo, hi)))
    out = _segments(ts, df)
    return replace(out, sliding=Sliding(whole, window, step)) if step < window else out


def segment_by_time(ts: TS, window: int, step: int | None = None) -> Segments:
    """Windows of ``window`` ticks every ``step`` ticks, half-open, from each series' first tick."""
    step = step or window
    ends = ts.df.groupBy(*ts.keys).agg(F.min("tick").alias("_first"))
    df = join_on(ts.df, ends, ts.keys)
    off = F.col("tick") - F.col("_first")
    if step == window:
        df = df.withColumn("seg_id", F.floor(off / step))
    else:
        lo = F.greatest(F.lit(0).cast("long"), F.floor((off - window) / step) + 1)
        df = df.where(lo <= F.floor(off / step)).withColumn("seg_id", F.explode(F.sequence(lo, F.floor(off / step))))
    start = F.col("_first") + F.col("seg_id") * step
    out = _segments(ts, df.withColumn("seg_start", start).withColumn("seg_end", start + (window - 1)), True)
    if step >= window:
        return out
    whole = join_on(ts.df, ends, ts.keys).withColumns({"_at": off, "_last": F.lit(None).cast("long")})
    return replace(out, sliding=Sliding(whole, window, step, "_first"))


def segment_by(ts: TS, expr) -> Segments:
    """One segment per value of ``expr``."""
    return _segments(ts, ts.df.withColumn("seg_id", as_column(expr)))


def keep_share(share: float, *cols) -> Column:
    """A repeatable choice of rows: true for about ``share`` of them, decided by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def segment_by_anchor(ts: TS, pred, left_delta: int, right_delta: int, perc: float = 1.0) -> Segments:
    """``[t - left_delta, t + right_delta]`` around each observation where ``pred`` holds.

    ``perc`` keeps that share of the anchors (chosen by hash). Segment ids are the anchor ticks.
    """
    anchors = ts.df.where(as_column(pred))
    if perc < 1.0:
        anchors = anchors.where(keep_share(perc, *ts.keys, "tick"))
    anchors = anchors.select(*ts.keys, "tick").distinct().withColumn("value", F.lit(None).cast("int"))
    # Tie-breakers travel inside the right value.
    data = ts.df.select(*ts.keys, "tick", F.struct(*ts.ord, "value").alias("value"))
    hits = within(anchors, data, ts.keys, left_delta, right_delta)
    df = hits.select(
        *ts.keys,
        F.col("tick").alias("seg_id"),
        (F.col("tick") - left_delta).alias("seg_start"),
        (F.col("tick") + right_delta).alias("seg_end"),
        F.col("right_tick").alias("tick"),
        "right.*",
    )
    return _segments(ts, df, True)


def _cut(ts: TS, df: DataFrame, flag: Column) -> Segments:
    """Segments that start where ``flag`` is true (and at the first row)."""
    df = df.withColumn("_f", F.when(flag, 1).otherwise(0).cast("long"))
    return _segments(ts, ts.running({"seg_id": ("sum", "_f")}, df))


def segment_by_changepoint(ts: TS, change_point=None) -> Segments:
    """New segment where ``change_point`` (over ``prev`` and ``value``) holds; default: the value changed."""
    df = ts.frame(lambda w: {"prev": F.lag("value").over(w), "_pt": F.lag("tick").over(w)}, before=1)
    changed = ~F.col("prev").eqNullSafe(F.col("value")) if change_point is None else F.coalesce(as_column(change_point), F.lit(False))
    return _cut(ts, df, F.col("_pt").isNotNull() & changed)


def segment_by_marker(
    ts: TS,
    start_mark,
    end_mark,
    start_inclusive: bool = True,
    end_inclusive: bool = True,
    start_on_first: bool = True,
    end_on_first: bool = True,
    requires_start_and_end: bool = True,
) -> Segments:
    """Rows from a start mark to the end mark that follows it.

    ``start_on_first``: of several start marks in a row the first one opens (else the last).
    ``end_on_first``: of several end marks in a row the first one closes (else the last). A row that
    is both counts as a start mark. Without ``requires_start_and_end`` a segment that is still open
    ends at the last tick.
    """
    is_start = F.coalesce(as_column(start_mark), F.lit(False))
    is_end = F.coalesce(as_column(end_mark), F.lit(False)) & ~is_start
    mark = F.when(is_start, F.lit("s")).when(is_end, F.lit("e"))
    df = ts.running({"_before": ("last_before", "_m"), "_after": ("first_after", "_m")}, ts.df.withColumn("_m", mark))
    m, before, after = F.col("_m"), F.col("_before"), F.col("_after")
    opens = (m == "s") & ((before.isNull() | (before == "e")) if start_on_first else (after.isNull() | (after == "e")))
    closes = (m == "e") & ((before == "s") if end_on_first else (after.isNull() | (after == "s")))
    df = df.withColumn("_o", F.when(opens, 1).otherwise(0).cast("long")).withColumn("_c", F.when(closes, 1).otherwise(0).cast("long"))
    df = df.withColumn("_close", F.when(closes, True))
    df = ts.running({"seg_id": ("sum", "_o"), "_closed": ("sum_before", "_c"), "_ahead": ("first", "_close")}, df)
    # An end mark before the first start mark closes nothing.
    df = df.withColumn("_stray", F.when(closes & (F.col("seg_id") == 0), 1).otherwise(0).cast("long"))
    df = ts.running({"_strays": ("sum_before", "_stray")}, df)
    inside = (F.col("seg_id") > 0) & (F.coalesce("_closed", F.lit(0)) - F.coalesce("_strays", F.lit(0)) < F.col("seg_id"))
    if requires_start_and_end:
        inside = inside & F.col("_ahead").isNotNull()
    if not start_inclusive:
        inside = inside & (F.col("_o") == 0)
    if not end_inclusive:
        inside = inside & (F.col("_c") == 0)
    return _segments(ts, df.where(inside))


def static_threshold(ts: TS, threshold: int) -> Segments:
    """Split on silence: a gap between neighbours above ``threshold`` ticks."""
    df = ts.frame(lambda w: {"_gap": F.col("tick") - F.lag("tick").over(w)}, before=1)
    return _cut(ts, df, F.col("_gap") > threshold)


def dynamic_threshold(ts: TS, alpha: float, factor: float, threshold: int) -> Segments:
    """Split on silence relative to recent gaps.

    A gap starts a segment when it exceeds ``threshold`` and ``factor`` times the exponentially
    weighted mean (newest weight ``alpha``) of the gaps before it.
    """
    df = ts.row_index("_rn")
    df = ts.frame(lambda w: {"_gap": F.col("tick") - F.lag("tick").over(w)}, before=1, df=df)
    rn, gap = F.col("_rn"), F.col("_gap")
    # The mean starts at the first gap (row 1), which therefore enters with full weight.
    x = F.when(rn == 0, F.lit(0.0)).when(rn == 1, gap.cast("double")).otherwise(gap * alpha)
    df = decay_scan(df.withColumn("_x", x), ts.keys, "_rn", "_x", 1.0 - alpha, ts.max_rows(), "_mean")
    df = ts.frame(lambda w: {"_prev": F.lag("_mean").over(w)}, before=1, df=df)
    limit = F.when(rn >= 2, F.col("_prev") * factor).otherwise(F.lit(0.0))
    return _cut(ts, df, (gap > threshold) & (gap > limit))


def cusum(ts: TS, threshold: float, rows: int = 100_000) -> Segments:
    """New segment when the sum of deviations from the segment's first value exceeds ``threshold``."""

    def step(pdf, state):
        first, total = json.loads(state)
        new = []
        for v in pdf["value"].tolist():
            cut = False
            if first is None:
                first, total = v, 0.0
            else:
                total += v - first
                if abs(total) > threshold:
                    first, total, cut = v, 0.0, True
            new.append(cut)
        return pdf[[*by]].assign(value=pdf["value"], _new=new), json.dumps([first, total])

    by = ["tick", *ts.ord]
    return _folded(ts, step, json.dumps([None, 0.0]), by, rows)


def _folded(ts: TS, step, init, by, rows) -> Segments:
    kinds = {c: ts.df.schema[c].dataType.simpleString() for c in by}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", value double, _new boolean"
    clean = ts.df.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    # The step only tells where segments start: a count of them in its state would never agree between blocks.
    return _cut(ts, fold(clean, ts.keys, ts.by, [*by, "value"], step, init, schema, min(rows, ts.chunk_rows)), F.col("_new"))


def regression(ts: TS, max_error: float, skip: int = 0, use_relative: bool = False, rows: int = 100_000) -> Segments:
    """Grow a straight line through a segment until a value is off by more than ``max_error``.

    The line is the least-squares fit of the segment so far (at least two points); ``skip`` misses in
    a row are tolerated and left out of the fit, the next one starts a segment. ``use_relative``
    compares the error divided by the size of the value.
    """
    by = ["tick", *ts.ord]

    def step(pdf, state):
        t0, n, sx, sy, sxx, sxy, missed = json.loads(state)
        new = []
        for t, v in zip(pdf["tick"].tolist(), pdf["value"].tolist()):
            if n == 0:
                t0 = t
            x, ok, cut = float(t - t0), True, False
            if n >= 2:
                var = n * sxx - sx * sx
                slope = (n * sxy - sx * sy) / var if var else 0.0
                error = abs(v - ((sy - slope * sx) / n + slope * x))
                if use_relative:
                    error = error / abs(v) if v else error
                ok = error <= max_error
            if ok:
                missed = 0
            else:
                missed += 1
                if missed > skip:
                    cut, t0, n, sx, sy, sxx, sxy, missed, x, ok = True, t, 0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, True
            if ok:
                n, sx, sy, sxx, sxy = n + 1, sx + x, sy + v, sxx + x * x, sxy + x * v
            new.append(cut)
        return pdf[[*by]].assign(value=pdf["value"], _new=new), json.dumps([t0, n, sx, sy, sxx, sxy, missed])

    return _folded(ts, step, json.dumps([0, 0, 0.0, 0.0, 0.0, 0.0, 0]), by, rows)


def statistical_changepoint(ts: TS, min_segment_size: int = 2, threshold: float = 2.0) -> Segments:
    """New segment where the z-normalised value jumps by more than ``threshold``.

    A jump less than ``min_segment_size`` rows after the jump before it (or the start) is ignored,
    so no segment but the last is shorter than that.
    """
    stats = ts.df.groupBy(*ts.keys).agg(F.avg("value").alias("_mu"), F.stddev_samp("value").alias("_sd"))
    df = join_on(ts.row_index("_rn"), stats, ts.keys)
    z = F.try_divide(F.col("value") - F.col("_mu"), F.col("_sd"))
    df = df.withColumn("_z", z)
    df = ts.frame(lambda w: {"_jump": F.abs(F.col("_z") - F.lag("_z").over(w)) > threshold}, before=1, df=df)
    df = df.withColumn("_at", F.when(F.col("_jump") | (F.col("_rn") == 0), F.col("_rn")))
    df = ts.running({"_last": ("last_before", "_at")}, df)
    cut = F.col("_jump") & (F.col("_rn") - F.col("_last") >= min_segment_size)
    return _cut(ts, df, cut)


_SEGMENTERS = {
    "static_threshold": static_threshold,
    "dynamic_threshold": dynamic_threshold,
    "cusum": cusum,
    "regression": regression,
    "statistical_changepoint": statistical_changepoint,
}


def to_segments(ts: TS, segmenter, **arguments) -> Segments:
    """Apply a segmenter given by name (see ``_SEGMENTERS``) or as a function of the series."""
    fn = _SEGMENTERS[segmenter] if isinstance(segmenter, str) else segmenter
    return fn(ts, **arguments)


def flatten(segs: Segments, key_expr=None) -> TS:
    """Each segment becomes a series of its own; its key is (old keys, ``seg_key``)."""
    key = F.col("seg_id") if key_expr is None else as_column(key_expr)
    df = segs.df.select(*segs.keys, key.alias("seg_key"), "tick", *segs.ord, "value")
    return TS(df, (*segs.keys, "seg_key"), segs.ord, segs.trs, segs.chunk_rows)


def _start(segs: Segments) -> Column:
    return F.min("seg_start" if segs.has_bounds else "tick")


def map_segments(segs: Segments, agg) -> TS:
    """Segment to one value by an aggregate expression; the tick is the segment's start."""
    df = segs.df.groupBy(*segs.group).agg(_start(segs).alias("tick"), as_column(agg).alias("value"))
    return TS(df.select(*segs.keys, "tick", "seg_id", "value"), segs.keys, ("seg_id",), segs.trs, segs.chunk_rows)


def flatmap_segments(segs: Segments, agg_array) -> TS:
    """Segment to several values by an aggregate expression that yields an array."""
    df = segs.df.groupBy(*segs.group).agg(_start(segs).alias("tick"), as_column(agg_array).alias("_a"))
    df = df.select(*segs.keys, "tick", "seg_id", F.posexplode("_a").alias("pos", "value"))
    return TS(df, segs.keys, ("seg_id", "pos"), segs.trs, segs.chunk_rows)


def filter_segments(segs: Segments, condition) -> Segments:
    """Keep whole segments by an aggregate condition."""
    keep = segs.df.groupBy(*segs.group).agg(as_column(condition).alias("_keep")).where("_keep").select(*segs.group)
    return segs.with_df(join_on(segs.df, keep, segs.group, "left_semi"))


def transform(segs: Segments, reducer) -> TS:
    """Reduce each segment; the tick of the result is the segment's start."""
    if segs.sliding is not None and reducer.of_panes is not None and isinstance(segs.df.schema["value"].dataType, NumericType):
        df = _by_panes(segs, reducer.of_panes)
        return TS(df, segs.keys, ("seg_id",), segs.trs, segs.chunk_rows)
    groups = segs.df.groupBy(*segs.group)
    if reducer.columns is not None:
        aggs = reducer.columns("value", segs.by)
        out = groups.agg(_start(segs).alias("tick"), *[c.alias(n) for n, c in aggs.items()])
    else:
        values = reducer.apply(segs.df, segs.group, segs.by, segs.rows())
        out = join_on(groups.agg(_start(segs).alias("tick")), values, segs.group)
    fields = [c for c in out.columns if c not in (*segs.group, "tick")]
    value = F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)
    df = out.select(*segs.keys, "tick", "seg_id", value.alias("value"))
    return TS(df, segs.keys, ("seg_id",), segs.trs, segs.chunk_rows)


def _by_panes(segs: Segments, of_panes) -> DataFrame:
    """``of_panes`` of every overlapping window, from partial aggregates: (keys, tick, seg_id, value).

    A pane is as long as the greatest common divisor of window and step, and every row enters one
    pane. Blocks of as many panes as a window has carry running aggregates from their start on and
    from their end back. A window meets one or two blocks, so it is made of the aggregate from its
    first pane back to its block's end and that up to its last pane; the two are found by the panes
    that are first and last in a window. Rows shuffled: rows, then panes and windows.
    """
    keys, src = list(segs.keys), segs.sliding
    g = gcd(src.window, src.step)
    wide, step = src.window // g, src.step // g
    first = [] if src.first is None else [src.first]
    v = F.col("value").cast("double")
    panes = src.df.groupBy(*keys, F.floor(F.col("_at") / g).alias("_p")).agg(
        F.min("tick").alias("_t"), F.count("value").alias("_n"), F.avg(v).alias("_avg"), F.sum("value").alias("_s"),
        F.coalesce(F.var_pop(v), F.lit(0.0)).alias("_var"), F.min("value").alias("_low"), F.max("value").alias("_high"),
        F.max("_last").alias("_last"), *[F.first(c).alias(c) for c in first],
    )
    panes = panes.withColumn("_b", F.floor(F.col("_p") / wide))
    block = Window.partitionBy(*keys, "_b")
    # Squares are summed about a value of the block, so that they stay small.
    finite = F.when(~F.isnan("_avg") & (F.abs("_avg") < float("inf")), F.col("_avg"))
    around = F.first(finite, ignorenulls=True).over(block.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    panes = panes.withColumn("_c", F.coalesce(around, F.lit(0.0)))
    off = F.col("_avg") - F.col("_c")
    panes = panes.withColumns({"_d1": F.col("_n") * off, "_d2": F.col("_n") * (F.col("_var") + off * off)})

    def carried(order, suffix):
        w = block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        sums = {f"{c}{suffix}": F.sum(c).over(w) for c in ("_n", "_s", "_d1", "_d2")}
        return sums | {f"_t{suffix}": F.min("_t").over(w), f"_low{suffix}": F.min("_low").over(w), f"_high{suffix}": F.max("_high").over(w)}

    panes = panes.withColumns(carried(F.asc("_p"), "_up") | carried(F.desc("_p"), "_down"))
    along = Window.partitionBy(*keys).orderBy("_p")
    if segs.rows() is None:
        panes = panes.withColumns({"_before": F.lag("_p").over(along), "_after": F.lead("_p").over(along)})
    else:
        panes = frame(panes, keys, ["_p"], lambda w: {"_before": F.lag("_p").over(w), "_after": F.lead("_p").over(w)}, 1, 1, segs.chunk_rows)
    # Windows that hold a pane, without those that hold the one before (after) it as well.
    zero = F.lit(0).cast("long")
    lo = F.greatest(zero, F.ceil((F.col("_p") - (wide - 1)) / step))
    hi = F.floor(F.col("_p") / step)
    starts = F.when(F.col("_before").isNull(), lo).otherwise(F.greatest(lo, F.floor(F.col("_before") / step) + 1))
    ends = F.when(F.col("_after").isNull(), hi).otherwise(F.least(hi, F.greatest(zero, F.ceil((F.col("_after") - (wide - 1)) / step)) - 1))
    limit = F.least(hi, F.col("_last"))
    parts = ["_n", "_s", "_d1", "_d2", "_t", "_low", "_high"]
    opened = panes.where(starts <= limit).select(
        *keys, F.explode(F.sequence(starts, limit)).alias("seg_id"), F.col("_b").alias("_b1"), F.col("_c").alias("_c1"), *first, *[F.col(f"{c}_down").alias(f"{c}1") for c in parts]
    )
    limit = F.least(ends, F.col("_last"))
    closed = panes.where(lo <= limit).select(
        *keys, F.explode(F.sequence(lo, limit)).alias("seg_id"), F.col("_b").alias("_b2"), F.col("_c").alias("_c2"), *[F.col(f"{c}_up").alias(f"{c}2") for c in parts]
    )
    both = join_on(opened, closed, [*keys, "seg_id"])
    own = F.col("seg_id") * step
    one = F.col("_b1") == F.col("_b2")
    back = one & (F.col("_b1") == F.floor(own / wide)) & (own % wide != 0)  # all in the block the window starts in
    use1, use2 = ~one | back, ~one | ~back

    def part(c, use, empty):
        return F.when(use, F.coalesce(F.col(c), empty)).otherwise(empty)

    n1, n2 = part("_n1", use1, zero), part("_n2", use2, zero)
    n = n1 + n2
    mean1 = F.when(n1 > 0, F.col("_c1") + F.col("_d11") / n1)
    mean2 = F.when(n2 > 0, F.col("_c2") + F.col("_d12") / n2)
    m1 = F.when(n1 > 0, F.greatest(F.col("_d21") - F.col("_d11") * F.col("_d11") / n1, F.lit(0.0))).otherwise(0.0)
    m2 = F.when(n2 > 0, F.greatest(F.col("_d22") - F.col("_d12") * F.col("_d12") / n2, F.lit(0.0))).otherwise(0.0)
    between = F.when((n1 > 0) & (n2 > 0), (mean1 - mean2) * (mean1 - mean2) * n1 * n2 / n).otherwise(0.0)
    facts = {
        "n": n, "sum": F.when(n > 0, part("_s1", use1, F.lit(0)) + part("_s2", use2, F.lit(0))), "squares": m1 + m2 + between,
        "min": F.least(F.when(use1, F.col("_low1")), F.when(use2, F.col("_low2"))), "max": F.greatest(F.when(use1, F.col("_high1")), F.when(use2, F.col("_high2"))),
    }
    tick = F.least(F.when(use1, F.col("_t1")), F.when(use2, F.col("_t2"))) if not first else F.col(src.first) + F.col("seg_id") * src.step
    return both.select(*keys, tick.alias("tick"), "seg_id", of_panes(facts).alias("value"))
