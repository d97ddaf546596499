"""Series in motion: the operators of the batch handle on a streaming DataFrame.

A stream has the key columns, ``tick`` (milliseconds), ``time`` (the same instant as a timestamp, with
the watermark on it), tie-breakers and ``value``. Late rows, by more than ``delay``, are dropped by Spark;
their number is in the progress of the running query (``late_rows``). Order-based operators keep the rows
the watermark has not passed yet, in columns of their own kind, and what the step needs; with ``idle`` set
the state of a key that had no row for so long (of event time) is given up.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import interpolators as ip
from ..functions.interpolators import Interpolator
from ..handle import as_column
from ..trs import TRS, epoch_ms


@dataclass(frozen=True)
class StreamTS:
    df: DataFrame
    keys: tuple[str, ...]
    delay: str = "1 hour"
    ord: tuple[str, ...] = ()
    #: Milliseconds after which a key without rows is forgotten; None: never.
    idle: int | None = None
    #: Time between two polls of the source; None: take what is there and end.
    polling_interval: str | None = None

    def with_df(self, df: DataFrame) -> StreamTS:
        return replace(self, df=df)

    # Element-wise: stateless

    def map(self, expr) -> StreamTS:
        """Replace every value (the keys are in reach of the expression)."""
        return self.with_df(self.df.withColumn("value", as_column(expr)))

    map_with_key = map

    def filter(self, pred) -> StreamTS:
        return self.with_df(self.df.where(as_column(pred)))

    def flatmap(self, array_expr) -> StreamTS:
        """One value to many values at the same tick."""
        return self.with_df(self.df.withColumn("value", F.explode(as_column(array_expr))))

    def with_trs(self, trs: TRS) -> StreamTS:
        """Ticks of another time reference system; the event time stays."""
        return self.with_df(self.df.withColumn("tick", trs.to_index(F.unix_millis("time"))))

    def partition(self, num_partitions: int, polling_interval: str | None = None) -> StreamTS:
        """Spread the keys over ``num_partitions`` tasks; ``polling_interval`` is the time between two polls of the source."""
        out = self.with_df(self.df.repartition(num_partitions, *self.keys))
        return replace(out, polling_interval=polling_interval or self.polling_interval)

    def to_parquet(self, path: str, checkpoint: str | None = None):
        """Start writing the observations: once through what is there, or on and on at the polling interval."""
        from .io import to_parquet

        return to_parquet(self.df.drop("time"), path, checkpoint, self.polling_interval)

    def through(self, path: str, checkpoint: str | None = None, delay: str | None = None) -> StreamTS:
        """The same series read back from files at ``path``, as a stream with a watermark of its own.

        The order-based operators release observations when others have come after them, so their
        ticks may lie far behind the watermark; through files any windows, joins and further
        operators can follow. Without a polling interval what is there is written first; with one
        the first query goes on writing.
        """
        columns = [*self.keys, "tick", *self.ord, "value"]
        narrow = self.with_df(self.df.select(*columns, "time"))
        query = narrow.to_parquet(path, checkpoint)
        if self.polling_interval is None:
            query.awaitTermination()
        delay = delay or self.delay
        back = self.df.sparkSession.readStream.schema(narrow.df.select(*columns).schema).parquet(path)
        return replace(self, df=back.withColumn("time", F.timestamp_millis("tick")).withWatermark("time", delay), delay=delay)

    # Segments

    def segment_by_time(self, window: str, step: str | None = None) -> SegmentStream:
        """Tumbling or sliding windows of event time, closed by the watermark."""
        return SegmentStream(self, F.window("time", window, step) if step else F.window("time", window))

    def segment_by_silence(self, gap: str) -> SegmentStream:
        """Sessions that end after ``gap`` without an observation."""
        return SegmentStream(self, F.session_window("time", gap))

    def segment(self, window: int, step: int = 1) -> DataFrame:
        """Windows of ``window`` observations every ``step``, in tick order, released by the watermark.

        Rows (keys, seg_id, seg_start, seg_end, ticks, values).
        """

        def run(block: pd.DataFrame, state: str):
            held = json.loads(state)
            n, tail, out = held["n"], held["tail"], []
            for t, v in zip(block["tick"].tolist(), block["value"].tolist()):
                tail.append([t, v])
                n += 1
                if n >= window and (n - window) % step == 0:
                    out.append([(n - window) // step, tail[0][0], t, [a for a, _ in tail], [b for _, b in tail]])
                if len(tail) >= window:
                    tail.pop(0)
            return pd.DataFrame(out, columns=["seg_id", "seg_start", "seg_end", "ticks", "values"]), json.dumps({"n": n, "tail": tail})

        kind = self.df.schema["value"].dataType.simpleString()
        schema = f"seg_id long, seg_start long, seg_end long, ticks array<bigint>, values array<{kind}>"
        return self.fold(run, json.dumps({"n": 0, "tail": []}), schema)

    def segment_by_anchor(self, pred, left: str, right: str) -> DataFrame:
        """Observations from ``left`` before to ``right`` after each anchor: rows (keys, anchor, tick, value)."""
        anchors = self.filter(pred)
        out = anchors.interval_join(self, left, right)
        return out.select(*self.keys, F.col("tick").alias("anchor"), F.col("right_tick").alias("tick"), F.col("right").alias("value"))

    # Order-based: rows wait for the watermark, then run through a resumable step

    def fold(self, step: Callable, init: str, schema: str, start: DataFrame | None = None) -> DataFrame:
        """Resumable step ``(rows, state) -> (rows, state)`` along each series in tick order.

        The same steps as the batch ``fold`` take. A row is handed over once the watermark has passed
        its tick, in the order of tick and tie-breakers, so the state holds only the rows of the last
        ``delay`` and what the step keeps. ``start`` (keys, ``_init``, ``last_time``) has the states
        that series begin with; rows up to ``last_time`` and keys without one are left out.
        """
        keys, held = list(self.keys), ["tick", *self.ord, "value"]
        rows = self.df.select(*keys, "time", *held)
        if start is not None:
            rows = rows.join(start.select(*keys, "_init", "last_time"), keys).where(F.col("tick") > F.col("last_time")).drop("last_time")
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        ddl = ", ".join(f"`{k}` {kind(self.df, k)}" for k in keys)
        names = [p.strip().split(" ")[0].strip("`") for p in _split(schema)]
        by, idle = [*range(1 + len(self.ord))], self.idle
        state_ddl = ", ".join([*(f"`w_{c}` array<{kind(rows, c)}>" for c in held), "inner string", "newest long"])

        def run(key, batches, state):
            waiting, inner, newest = [], init, 0
            if state.exists:
                *columns, inner, newest = state.get
                waiting = list(zip(*columns))
            elif state.hasTimedOut:
                return
            fresh = not state.exists
            for pdf in batches:
                waiting.extend(zip(*[_listed(pdf[c]) for c in held]))
                if fresh and "_init" in pdf.columns:
                    inner, fresh = pdf["_init"].iat[0], False
            mark = state.getCurrentWatermarkMs()
            newest = max([newest, *(w[0] for w in waiting)])
            ready = sorted((w for w in waiting if w[0] < mark), key=lambda w: [(w[i] is not None, w[i]) for i in by])
            waiting = [w for w in waiting if w[0] >= mark]
            out = None
            if ready:
                out, inner = step(pd.DataFrame({c: list(v) for c, v in zip(held, zip(*ready))}), inner)
            if waiting:
                state.setTimeoutTimestamp(max(min(w[0] for w in waiting) + 1, mark + 1))
            elif idle is not None and mark >= newest + idle:
                if state.exists:
                    state.remove()
                newest = None
            elif idle is not None:
                state.setTimeoutTimestamp(max(newest + idle, mark + 1))
            if newest is not None:
                state.update((*([list(c) for c in zip(*waiting)] if waiting else [[] for _ in held]), inner, newest))
            if out is not None and len(out):
                for k, v in zip(keys, key):
                    out[k] = v
                yield out[[*keys, *names]]

        return rows.groupBy(*keys).applyInPandasWithState(run, f"{ddl}, {schema}", state_ddl, "append", "EventTimeTimeout")

    def fillna(self, interp: str | Interpolator = "prev", default=None) -> StreamTS:
        """Replace missing values by an interpolator's: any of the batch ones, or the name of one of the plain kinds.

        A missing value waits until as many observations after it have come as the interpolator
        looks ahead; the state keeps as many before it as it looks back.
        """
        interp = _interpolator(interp, default)
        back, ahead = interp.history_size, interp.future_size

        def step(block, state):
            past, gaps = json.loads(state)  # gaps: [ticks, points before, points after], the oldest first
            out = []
            for t, v in zip(block["tick"].tolist(), block["value"].tolist()):
                if v is None or v != v:
                    if not ahead:
                        out.append([t, None, past, []])
                        continue
                    if gaps and not gaps[-1][2]:
                        gaps[-1][0].append(t)
                    else:
                        gaps.append([[t], past, []])
                    continue
                for gap in gaps:
                    gap[2].append([t, v])
                while gaps and len(gaps[0][2]) == ahead:
                    ticks, before, after = gaps.pop(0)
                    out.extend([g, None, before, after] for g in ticks)
                past = [*past, [t, v]][-back:] if back else []
                out.append([t, v, None, None])
            return _seen(out), json.dumps([past, gaps])

        return self._interpolated(step, json.dumps([[], []]), interp)

    def resample(self, period: int, interp: str | Interpolator = "prev", default=None) -> StreamTS:
        """Regular ticks from each series' first one, every ``period`` milliseconds, up to the last released tick.

        A tick without an observation of its own waits as in ``fillna``.
        """
        interp = _interpolator(interp, default)
        back, ahead = interp.history_size, interp.future_size

        def step(block, state):
            past, gaps, grid = json.loads(state)
            out = []
            for t, v in zip(block["tick"].tolist(), block["value"].tolist()):
                grid = t if grid is None else grid
                ticks = list(range(grid, t, period))
                grid += len(ticks) * period
                if ticks and ahead:
                    gaps.append([ticks, past, []])
                else:
                    out.extend([g, None, past, []] for g in ticks)
                if grid == t:
                    out.append([t, v, None, None])
                    grid += period
                for gap in gaps:
                    gap[2].append([t, v])
                while gaps and len(gaps[0][2]) == ahead:
                    ticks, before, after = gaps.pop(0)
                    out.extend([g, None, before, after] for g in ticks)
                past = [*past, [t, v]][-back:] if back else []
            return _seen(out), json.dumps([past, gaps, grid])

        return self._interpolated(step, json.dumps([[], [], None]), interp)

    def _interpolated(self, step, init: str, interp: Interpolator) -> StreamTS:
        """Runs a step that tells the neighbours of missing values, then the interpolator's expression."""
        doubles = self.with_df(self.df.withColumn("value", F.col("value").cast("double")))
        near = "array<struct<tick:bigint,value:double>>"
        rows = doubles.fold(step, init, f"tick long, value double, past {near}, after {near}")
        value = F.when(F.col("past").isNull(), F.col("value")).otherwise(interp.expr(F.col("tick"), F.col("past"), F.col("after")).cast("double"))
        out = rows.select(*self.keys, "tick", value.alias("value"))
        return replace(self.with_df(out.withColumn("time", F.timestamp_millis("tick"))), ord=())

    def forecast(self, model: float | DataFrame = 0.3, confidence: float = 0.95) -> DataFrame:
        """Online model: rows (keys, tick, value, forecast, lower, upper, is_anomaly); each row updates the model after its test.

        ``model``: a table of trained models of any kind (joined to the stream by key; rows up to a
        model's last tick and keys without a model are left out), or the smoothing weight of an
        exponential average that starts with the stream.
        """
        from ..functions.special import normal_quantile

        z = normal_quantile(0.5 + confidence / 2)
        if isinstance(model, DataFrame):
            from ..operators.forecast import online_state
            from ..operators.online import tested

            def follow(block, state):
                out, state = tested(block, state, z)
                return pd.concat([block[["tick", "value"]].reset_index(drop=True), out], axis=1), state

            start = online_state(model, self.keys).join(model.select(*self.keys, "last_time"), list(self.keys))
            fields = "tick long, value double, forecast double, lower double, upper double, is_anomaly boolean"
            return self.fold(follow, "{}", fields, start)
        smoothing = model

        def step(block, state):
            level, sse, n = json.loads(state)
            out = []
            for t, v in zip(block["tick"].tolist(), block["value"].tolist()):
                width = z * (sse / n) ** 0.5 if n else None
                lo, hi = (level - width, level + width) if width is not None and level is not None else (None, None)
                bad = v is None or v != v or (n >= 2 and lo is not None and not lo <= v <= hi)
                out.append([t, v, level, lo, hi, bool(bad)])
                if v is None or v != v:
                    continue
                if level is None:
                    level = v
                else:
                    sse, n, level = sse + (v - level) ** 2, n + 1, smoothing * v + (1 - smoothing) * level
            return pd.DataFrame(out, columns=["tick", "value", "forecast", "lower", "upper", "is_anomaly"]), json.dumps([level, sse, n])

        return self.fold(step, json.dumps([None, 0.0, 0]), "tick long, value double, forecast double, lower double, upper double, is_anomaly boolean")

    # Joins: both sides carry a watermark, equal times meet

    def _sides(self, other: StreamTS):
        left = self.df.select(*self.keys, "tick", "time", F.col("value").alias("left"))
        names = {k: f"_r_{k}" for k in self.keys}
        right = other.df.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("tick").alias("right_tick"), F.col("time").alias("right_time"), F.col("value").alias("right"))
        same = F.lit(True)
        for k, n in names.items():
            same = same & (F.col(k) == F.col(n))
        return left, right, same, names

    def join(self, other: StreamTS, how: str = "inner") -> DataFrame:
        """Observations of equal key and tick: inner, left, right, full, left_outer or right_outer (unmatched part only).

        Rows (keys, tick, left, right). Unmatched rows come out once the watermark has passed them.
        """
        left, right, same, names = self._sides(other)
        kind = {"inner": "inner", "left": "leftOuter", "left_outer": "leftOuter", "right": "rightOuter", "right_outer": "rightOuter", "full": "fullOuter"}[how]
        both = left.join(right, same & (F.col("time") == F.col("right_time")), kind)
        if how == "left_outer":
            both = both.where(F.col("right_tick").isNull())
        elif how == "right_outer":
            both = both.where(F.col("tick").isNull())
        keys = [F.coalesce(F.col(k), F.col(n)).alias(k) for k, n in names.items()]
        return both.select(*keys, F.coalesce("tick", "right_tick").alias("tick"), "left", "right")

    def inner_join(self, other):
        return self.join(other, "inner")

    def left_join(self, other):
        return self.join(other, "left")

    def right_join(self, other):
        return self.join(other, "right")

    def full_join(self, other):
        return self.join(other, "full")

    def left_outer_join(self, other):
        return self.join(other, "left_outer")

    def right_outer_join(self, other):
        return self.join(other, "right_outer")

    def interval_join(self, other: StreamTS, left_delta: str, right_delta: str) -> DataFrame:
        """Every right observation from ``left_delta`` before to ``right_delta`` after a left one."""
        left, right, same, _ = self._sides(other)
        near = F.expr(f"right_time >= time - INTERVAL {left_delta} AND right_time <= time + INTERVAL {right_delta}")
        return left.join(right, same & near).select(*self.keys, "tick", "left", "right_tick", "right")

    def to_multi_observation_stream(self, window: str, keys) -> DataFrame:
        """One row per window of event time with the last value of every series in ``keys`` (null: none).

        The keys must be given, so a row has a fixed width: ``tick`` and one column per key.
        """
        (key,) = self.keys
        last = [F.max_by("value", F.when(F.col(key) == F.lit(k), F.col("tick"))).alias(str(k)) for k in keys]
        out = self.df.groupBy(F.window("time", window).alias("w")).agg(*last)
        return out.select(F.unix_millis("w.start").alias("tick"), *[str(k) for k in keys])


def to_observation_stream(df: DataFrame, keys, name: str = "key") -> StreamTS:
    """A stream of multi-observations (``tick`` and a column per key) as single ones again; nulls are no observations."""
    each = F.explode(F.array(*[F.struct(F.lit(str(k)).alias(name), F.col(f"`{k}`").alias("value")) for k in keys])).alias("_o")
    out = df.select("tick", each).select(f"_o.{name}", "tick", "_o.value").where("value IS NOT NULL")
    return StreamTS(out.withColumn("time", F.timestamp_millis("tick")), (name,))


@dataclass(frozen=True)
class SegmentStream:
    """Windows of a stream; ``transform`` reduces each closed one."""

    stream: StreamTS
    window: Column
    condition: object = None

    def filter(self, condition) -> SegmentStream:
        """Keep windows by an aggregate condition."""
        return replace(self, condition=condition)

    def transform(self, **aggs) -> DataFrame:
        """Rows (keys, seg_start, seg_end, <aggregates>), in milliseconds, once a window is closed."""
        cols = [as_column(a).alias(n) for n, a in aggs.items()]
        keep = [as_column(self.condition).alias("_keep")] if self.condition is not None else []
        out = self.stream.df.groupBy(*self.stream.keys, self.window.alias("w")).agg(*cols, *keep)
        if keep:
            out = out.where("_keep").drop("_keep")
        return out.select(*self.stream.keys, F.unix_millis("w.start").alias("seg_start"), F.unix_millis("w.end").alias("seg_end"), *aggs)

    def transform_segments(self, array_agg, name: str = "value") -> DataFrame:
        """Segment to segment: an aggregate that yields an array, one row per item."""
        return self.transform(**{name: array_agg}).withColumn(name, F.explode(name))


def _split(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def _listed(column: pd.Series) -> list:
    """Python values; NaN in a column of numbers stands for null there."""
    return [None if v is None or v is pd.NaT or v != v else v for v in column.tolist()]


def _seen(rows: list) -> pd.DataFrame:
    near = lambda points: None if points is None else [{"tick": t, "value": v} for t, v in points]
    return pd.DataFrame([[t, v, near(a), near(b)] for t, v, a, b in rows], columns=["tick", "value", "past", "after"])


def _interpolator(interp: str | Interpolator, default) -> Interpolator:
    plain = {"prev": ip.prev, "next": ip.next, "nearest": ip.nearest, "linear": ip.linear, "cubic": ip.cubic}
    return plain[interp](default) if isinstance(interp, str) else interp


def stream_series(df: DataFrame, ts_column: str, key_column, value_column, delay: str = "1 hour", ord=(), idle: int | None = None) -> StreamTS:
    """Streaming table -> streaming series with a watermark of ``delay``.

    ``ord``: tie-breaker columns; ``idle``: milliseconds after which a key without rows is forgotten.
    """
    ord = (ord,) if isinstance(ord, str) else tuple(ord)
    keys = (key_column,) if isinstance(key_column, str) else tuple(key_column)
    tick = epoch_ms(F.col(ts_column), df.schema[ts_column].dataType.simpleString())
    out = df.select(*keys, tick.alias("tick"), *ord, as_column(value_column).alias("value"))
    out = out.withColumn("time", F.timestamp_millis("tick")).withWatermark("time", delay)
    return StreamTS(out, keys, delay, ord, idle)
