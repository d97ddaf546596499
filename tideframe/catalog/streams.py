"""Streaming twins: the event table is read as a stream, run to its end, and the closed part compared."""

from pyspark.sql import functions as F

from ..sources import readers
from ..streaming import add_sink, polling_source, run, stream_series, to_observation_stream
from ..operators import forecast
from .base import DAY, E, HOUR, HOUR as H, events, query, r, rounded, table
from .learning import _hws_sql, order_days
from .relational import scratch
from .series import HOURLY, KINDS, START

# The watermark ends up one hour behind the newest event; only what lies before it is released.
MARK = f"w AS (SELECT max(tick) - {H} AS w FROM e)"


def raw(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def stream(spark, sf, value="value", where=None):
    df = raw(spark, sf)
    return stream_series(df.where(where) if where else df, "ts", "user_id", value)


def out(ts):
    return run(ts.df.select(*ts.keys, "tick", "value"))


@query("stream_map", f"WITH {E} SELECT user_id, tick, value * 2 + user_id AS value FROM e")
def _(spark, sf):
    return out(stream(spark, sf).map_with_key("value * 2 + user_id"))


@query("stream_filter", f"WITH {E} SELECT user_id, tick, value FROM e WHERE value > 100")
def _(spark, sf):
    return out(stream(spark, sf).filter("value > 100"))


@query("stream_flatmap", f"WITH {E} SELECT user_id, tick, unnest([value, -value]) AS value FROM e")
def _(spark, sf):
    return out(stream(spark, sf).flatmap("array(value, -value)"))


@query("stream_with_trs", f"WITH {E} SELECT user_id, CAST((tick - {START}) // {HOUR} AS BIGINT) AS tick, value FROM e")
def _(spark, sf):
    return out(stream(spark, sf).with_trs(HOURLY))


@query(
    "stream_segment_by_time",
    f"WITH {E}, {MARK} SELECT user_id, CAST(tick // {DAY} * {DAY} AS BIGINT) AS seg_start, CAST((tick // {DAY} + 1) * {DAY} AS BIGINT) AS seg_end, count(*) AS n, round(sum(value), 6) AS total FROM e, w GROUP BY 1, 2, 3 HAVING seg_end <= any_value(w)",
)
def _(spark, sf):
    return rounded(run(stream(spark, sf).segment_by_time("1 day").transform(n="count(*)", total="sum(value)")), "total")


@query(
    "stream_segment_by_time_sliding",
    f"WITH {E}, {MARK}, s AS (SELECT *, unnest([tick // {DAY}, tick // {DAY} - 1]) * {DAY} AS a FROM e) SELECT user_id, CAST(a AS BIGINT) AS seg_start, CAST(a + {2 * DAY} AS BIGINT) AS seg_end, max(value) AS top FROM s, w GROUP BY 1, 2, 3 HAVING seg_end <= any_value(w) AND count(*) > 3",
)
def _(spark, sf):
    return run(stream(spark, sf).segment_by_time("2 days", "1 day").filter("count(*) > 3").transform(top="max(value)"))


@query(
    "stream_segment_flatmap",
    f"WITH {E}, {MARK}, s AS (SELECT user_id, CAST(tick // {DAY} * {DAY} AS BIGINT) AS seg_start, CAST((tick // {DAY} + 1) * {DAY} AS BIGINT) AS seg_end, min(value) AS lo, max(value) AS hi, any_value(w) AS w FROM e, w GROUP BY 1, 2, 3) SELECT user_id, seg_start, seg_end, unnest([lo, hi]) AS value FROM s WHERE seg_end <= w",
)
def _(spark, sf):
    return run(stream(spark, sf).segment_by_time("1 day").transform_segments("array(min(value), max(value))"))


@query(
    "stream_silence",
    f"""WITH {E}, {MARK}, f AS (SELECT *, CASE WHEN tick - lag(tick) OVER w >= {12 * H} THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, min(tick) AS seg_start, CAST(max(tick) + {12 * H} AS BIGINT) AS seg_end, count(*) AS n FROM s, w GROUP BY user_id, g HAVING max(tick) + {12 * H} <= any_value(w)""",
)
def _(spark, sf):
    return run(stream(spark, sf).segment_by_silence("12 hours").transform(n="count(*)"))


RELEASED = f"{E}, {MARK}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) - 1 AS rn FROM e, w WHERE tick < w)"


@query(
    "stream_segment",
    f"WITH {RELEASED}, s AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((rn - 4) / 2.0) AS BIGINT)), rn // 2)) AS seg_id FROM k) SELECT user_id, seg_id, min(tick) AS seg_start, max(tick) AS seg_end, round(sum(value), 6) AS total FROM s GROUP BY 1, 2 HAVING count(*) = 5",
)
def _(spark, sf):
    segs = run(stream(spark, sf).segment(5, 2))
    return segs.select("user_id", "seg_id", "seg_start", "seg_end", r(F.aggregate("values", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query(
    "stream_segment_by_anchor",
    f"WITH {E} SELECT a.user_id, a.tick AS anchor, e.tick, e.value FROM e a JOIN e ON e.user_id = a.user_id AND e.tick BETWEEN a.tick - {6 * H} AND a.tick + {H} WHERE a.value > 150",
)
def _(spark, sf):
    return run(stream(spark, sf).segment_by_anchor("value > 150", "6 HOURS", "1 HOUR"))


@query(
    "stream_fillna",
    f"WITH {RELEASED} "
    "SELECT user_id, tick, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS value FROM "
    "(SELECT user_id, tick, rn, CASE WHEN value > 30 THEN value END AS value FROM k)",
)
def _(spark, sf):
    return out(stream(spark, sf).map("if(value > 30, value, NULL)").fillna("prev", 0.0))


# A missing value is released with the observations after it that its interpolator asks for.
_GAPS = f"""{RELEASED}, n AS (SELECT user_id, tick, rn, CASE WHEN value > 30 THEN value END AS value FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS i FROM n WHERE value IS NOT NULL),
c AS (SELECT n.*, coalesce((SELECT max(i) FROM o WHERE o.user_id = n.user_id AND o.rn < n.rn), 0) AS i FROM n WHERE value IS NULL),
g AS (SELECT c.user_id, c.tick, c.i, p2.tick AS tp2, p2.value AS vp2, p.tick AS tp, p.value AS vp, q.tick AS tq, q.value AS vq, q2.tick AS tq2, q2.value AS vq2 FROM c
  LEFT JOIN o p2 ON p2.user_id = c.user_id AND p2.i = c.i - 1 LEFT JOIN o p ON p.user_id = c.user_id AND p.i = c.i
  LEFT JOIN o q ON q.user_id = c.user_id AND q.i = c.i + 1 LEFT JOIN o q2 ON q2.user_id = c.user_id AND q2.i = c.i + 2)"""
_LINE = "vp + (vq - vp) / (tq - tp) * (tick - tp)"
_CUBIC = "[x FOR x IN [{'t': tp2, 'v': vp2}, {'t': tp, 'v': vp}, {'t': tq, 'v': vq}, {'t': tq2, 'v': vq2}] IF x.t IS NOT NULL]"
_FILLS = {
    "next": ("vq", "vq IS NOT NULL"),
    "nearest": ("CASE WHEN vp IS NOT NULL AND tick - tp <= tq - tick THEN vp ELSE vq END", "vq IS NOT NULL"),
    "linear": (f"CASE WHEN vp IS NOT NULL THEN {_LINE} END", "vq IS NOT NULL"),
    "cubic": (
        f"CASE WHEN vp IS NOT NULL THEN list_sum([p.v * list_product([(tick - q.t)::DOUBLE / (p.t - q.t) FOR q IN {_CUBIC} IF q.t <> p.t]) FOR p IN {_CUBIC}]) END",
        "vq2 IS NOT NULL",
    ),
}

for _kind, (_value, _there) in _FILLS.items():

    def _run(spark, sf, kind=_kind):
        return rounded(out(stream(spark, sf).map("if(value > 30, value, NULL)").fillna(kind)), "value")

    query(f"stream_fillna_{_kind}", f"WITH {_GAPS} SELECT user_id, tick, round({_value}, 6) AS value FROM g WHERE {_there} UNION ALL SELECT user_id, tick, round(value, 6) FROM o")(_run)


@query(
    "stream_resample_linear",
    f"""WITH {RELEASED}, s AS (SELECT user_id, min(tick) AS a, max(tick) AS z FROM k GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(a, z, {DAY})) AS tick FROM s),
x AS (SELECT g.user_id, g.tick, p.tick AS tp, p.value AS vp FROM g ASOF JOIN k p ON p.user_id = g.user_id AND p.tick <= g.tick),
y AS (SELECT x.*, n.tick AS tq, n.value AS vq FROM x ASOF JOIN k n ON n.user_id = x.user_id AND n.tick >= x.tick)
SELECT user_id, tick, round(CASE WHEN tq = tp THEN vp ELSE vp + (vq - vp) / (tq - tp) * (tick - tp) END, 6) AS value FROM y""",
)
def _(spark, sf):
    return rounded(out(stream(spark, sf).resample(DAY, "linear")), "value")


@query(
    "stream_resample_window",
    f"""WITH {RELEASED}, s AS (SELECT user_id, min(tick) AS a, max(tick) AS z FROM k GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(a, z, {DAY})) AS tick FROM s),
f AS (SELECT g.user_id, g.tick, p.value FROM g ASOF LEFT JOIN k p ON p.user_id = g.user_id AND p.tick <= g.tick), m AS (SELECT max(tick) - {H} AS m FROM f)
SELECT user_id, CAST(tick // {7 * DAY} * {7 * DAY} AS BIGINT) AS seg_start, count(*) AS n, round(avg(value), 6) AS mean FROM f, m GROUP BY 1, 2 HAVING seg_start + {7 * DAY} <= any_value(m)""",
)
def _(spark, sf):
    """Windows over a resampled stream."""
    daily = stream(spark, sf).resample(DAY, "prev").through(scratch(spark, "daily"))
    return rounded(run(daily.segment_by_time("7 days").transform(n="count(*)", mean="avg(value)")).drop("seg_end"), "mean")


@query(
    "stream_late_rows",
    f"""WITH {E}, {MARK}, kept AS (SELECT e.*, w FROM e, w WHERE NOT (event_id % 10 = 0 AND tick < w - {5 * DAY}))
SELECT user_id, CAST(tick // {DAY} * {DAY} AS BIGINT) AS seg_start, count(*) AS n FROM kept GROUP BY 1, 2 HAVING seg_start + {DAY} <= any_value(w)""",
)
def _(spark, sf):
    """A tenth of the older events comes after the watermark has passed them and is dropped."""
    path, at, done = scratch(spark, "late"), scratch(spark, "late-checkpoint"), scratch(spark, "late-windows")
    every = table(spark, sf, "events")
    edge = F.lit(every.agg((F.unix_millis(F.max("ts").cast("timestamp")) - HOUR - 5 * DAY).alias("m")).first().m)
    late = (F.col("event_id") % 10 == 0) & (F.unix_millis(F.col("ts").cast("timestamp")) < edge)
    for part in (~late, late):
        every.where(part).coalesce(1).write.mode("append").parquet(path)
        ts = stream_series(spark.readStream.schema(every.schema).parquet(path), "ts", "user_id", "value")
        closed = ts.segment_by_time("1 day").transform(n="count(*)")
        add_sink(closed, lambda batch, id: batch.write.mode("overwrite").parquet(f"{done}/batch={id}"), at).awaitTermination()
    return spark.read.parquet(done).select("user_id", "seg_start", "n")


@query("stream_source", "SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(spark, sf):
    """The events through a pull reader that drops some messages."""
    import pyarrow.dataset as ds

    path = f"{sf}/events.parquet"
    last = table(spark, sf, "events").agg(F.max("event_id")).first()[0]

    def poll(start, end):
        at = ds.field("event_id")
        table = ds.dataset(path, format="parquet", partitioning="hive")
        # A batch at a time, pages as they are needed: what a task holds must not grow with the table or its row groups.
        pages = ds.ParquetFragmentScanOptions(use_buffered_stream=True, pre_buffer=False)
        some = (at >= start) & (at < end)
        for batch in table.to_batches(columns=["event_id", "event_type"], filter=some, batch_size=8_192, batch_readahead=1, fragment_readahead=1, fragment_scan_options=pages):
            yield from batch.to_pylist()

    def parse(m):
        return (m["event_id"], m["event_type"]) if m["event_type"] != "error" else None

    got = run(polling_source(spark, "events_poll", "event_id long, event_type string", lambda: last + 1, poll, parse))
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query(
    "stream_observation",
    f"WITH {E}, {MARK}, x AS (SELECT event_type AS key, CAST(tick // {H} * {H} AS BIGINT) AS tick, arg_max(value, tick) AS value, any_value(w) AS w FROM e, w GROUP BY 1, 2) SELECT key, tick, value FROM x WHERE tick + {H} <= w",
)
def _(spark, sf):
    """Hourly multi-observations taken apart again."""
    ts = stream_series(raw(spark, sf), "ts", "event_type", "value")
    return out(to_observation_stream(ts.to_multi_observation_stream("1 hour", KINDS), KINDS))


@query(
    "stream_resample",
    f"WITH {RELEASED}, s AS (SELECT user_id, min(tick) AS a, max(tick) AS z FROM k GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(a, z, {DAY})) AS tick FROM s) "
    "SELECT g.user_id, g.tick, p.value FROM g ASOF LEFT JOIN k p ON p.user_id = g.user_id AND p.tick <= g.tick",
)
def _(spark, sf):
    return out(stream(spark, sf).resample(DAY, "prev"))


@query(
    "stream_inner_join",
    f"WITH {E}, a AS (SELECT * FROM e WHERE value > 20), b AS (SELECT * FROM e WHERE value < 60) SELECT user_id, tick, a.value AS \"left\", b.value * 2 AS \"right\" FROM a JOIN b USING (user_id, tick)",
)
def _(spark, sf):
    return run(stream(spark, sf, where="value > 20").inner_join(stream(spark, sf, "value * 2", where="value < 60")))


# Unmatched rows come out once both sides' watermark has passed them.
SIDES = (
    f"{E}, a AS (SELECT user_id, tick, value AS l FROM e WHERE value > 20), b AS (SELECT user_id, tick, value * 2 AS r FROM e WHERE value < 60), "
    f"m AS (SELECT least((SELECT max(tick) FROM a), (SELECT max(tick) FROM b)) - {H} AS m), "
    "i AS (SELECT user_id, tick, l, r FROM a JOIN b USING (user_id, tick)), "
    "x AS (SELECT user_id, tick, l, CAST(NULL AS DOUBLE) AS r FROM a ANTI JOIN b USING (user_id, tick) WHERE tick < (SELECT m FROM m)), "
    "y AS (SELECT user_id, tick, CAST(NULL AS DOUBLE) AS l, r FROM b ANTI JOIN a USING (user_id, tick) WHERE tick < (SELECT m FROM m))"
)
_PARTS = {"left": "ix", "right": "iy", "full": "ixy", "left_outer": "x", "right_outer": "y"}

for _how, _parts in _PARTS.items():

    def _run(spark, sf, how=_how):
        return run(stream(spark, sf, where="value > 20").join(stream(spark, sf, "value * 2", where="value < 60"), how))

    query(
        f"stream_{_how}_join",
        f"WITH {SIDES} SELECT user_id, tick, l AS \"left\", r AS \"right\" FROM (" + " UNION ALL ".join(f"SELECT * FROM {p}" for p in _parts) + ")",
    )(_run)


@query(
    "stream_interval_join",
    f"WITH {E} SELECT a.user_id, a.tick, a.value AS \"left\", b.tick AS right_tick, b.value AS \"right\" FROM e a JOIN e b ON b.user_id = a.user_id AND b.tick BETWEEN a.tick - {6 * H} AND a.tick + {H} WHERE a.event_type = 'purchase' AND b.event_type = 'view'",
)
def _(spark, sf):
    buys = stream(spark, sf, where="event_type = 'purchase'")
    return run(buys.interval_join(stream(spark, sf, where="event_type = 'view'"), "6 HOURS", "1 HOUR"))


@query("stream_partition", f"WITH {E} SELECT user_id, tick, value FROM e")
def _(spark, sf):
    return out(stream(spark, sf).partition(4))


@query(
    "stream_multi_observation",
    f"WITH {E}, {MARK} SELECT CAST(tick // {H} * {H} AS BIGINT) AS tick, "
    + ", ".join(f"arg_max(value, tick) FILTER (event_type = '{k}') AS {k}" for k in KINDS)
    + f" FROM e, w GROUP BY 1 HAVING any_value((tick // {H} + 1) * {H}) <= any_value(w)",
)
def _(spark, sf):
    ts = stream_series(raw(spark, sf), "ts", "event_type", "value")
    return run(ts.to_multi_observation_stream("1 hour", KINDS))


@query(
    "stream_forecast",
    f"""WITH {RELEASED}, m AS (SELECT *, sum(CASE WHEN rn = 0 THEN value ELSE 0.3 * value END / pow(0.7, rn)) OVER w * pow(0.7, rn) AS ema FROM k WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
f AS (SELECT *, lag(ema) OVER (PARTITION BY user_id ORDER BY rn) AS forecast FROM m),
s AS (SELECT *, sum((value - forecast) ** 2) OVER pr AS s, count(forecast) OVER pr AS n FROM f WINDOW pr AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, tick, value, round(forecast, 10) AS forecast, coalesce(n >= 2 AND abs(value - forecast) > 1.959963984540054 * sqrt(s / n), false) AS is_anomaly FROM s""",
)
def _(spark, sf):
    return rounded(run(stream(spark, sf).forecast(0.3, 0.95)), "forecast", digits=10).select("user_id", "tick", "value", "forecast", "is_anomaly")


@query(
    "stream_forecast_hws",
    _hws_sql(keep="tick <= cut") + """, p AS (SELECT best.*, r.v AS rv, r.t AS rt FROM best JOIN (SELECT o_orderpriority, list(value ORDER BY tick) AS v, list(tick ORDER BY tick) AS t FROM days, (SELECT max(tick) - 60 AS cut, max(tick) AS top FROM days) WHERE tick > cut AND tick < top - 1 GROUP BY 1) r USING (o_orderpriority)),
f AS (SELECT *, list_reduce(list_prepend({'l': q.l, 't': q.t, 's': q.s, 'x': 0.0::DOUBLE, 'f': []::DOUBLE[]},
  [{'l': 0.0::DOUBLE, 't': 0.0::DOUBLE, 's': []::DOUBLE[], 'x': x, 'f': []::DOUBLE[]} FOR x IN rv]), lambda a, c: {
  'l': wa * (c.x - a.s[1]) + (1 - wa) * (a.l + a.t), 't': wb * (wa * (c.x - a.s[1]) + (1 - wa) * (a.l + a.t) - a.l) + (1 - wb) * a.t,
  's': list_append(a.s[2:], wg * (c.x - (wa * (c.x - a.s[1]) + (1 - wa) * (a.l + a.t))) + (1 - wg) * a.s[1]), 'x': c.x, 'f': list_append(a.f, a.l + a.t + a.s[1])}) AS k FROM p)
SELECT o_orderpriority, unnest(rt) AS tick, round(unnest(rv), 2) AS value, round(unnest(k.f), 2) AS forecast FROM f""",
)
def _(spark, sf):
    """The last 60 days as a stream, each day forecast by the Holt-Winters model that all days before it made."""
    ts, path = order_days(spark, sf), scratch(spark, "days")
    cut = ts.df.agg(F.max("tick")).first()[0] - 60
    model = forecast.hws(ts.filter(F.col("tick") <= cut), 7)
    days = ts.df.where(F.col("tick") > cut).withColumn("day", F.timestamp_millis(F.col("tick") * DAY))
    days.write.parquet(path)
    model = model.withColumn("last_time", F.col("last_time") * DAY)
    live = stream_series(spark.readStream.schema(days.schema).parquet(path), "day", "o_orderpriority", "value", "1 day")
    got = run(live.forecast(model)).withColumn("tick", F.floor(F.col("tick") / DAY))
    return rounded(got.select("o_orderpriority", "tick", "value", "forecast"), "value", "forecast", digits=2)


@query("stream_json_to_parquet", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def _(spark, sf):
    df = raw(spark, sf).select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("value"))
    return run(readers.json_project(df, "event_id BIGINT, k BIGINT").where("event_id IS NOT NULL AND k IS NOT NULL AND k > 50"))


@query("stream_sink", f"WITH {E} SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "dump")

    def dump(batch, batch_id):
        # Overwriting the folder of the batch id makes a repeated batch harmless.
        batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    add_sink(stream(spark, sf).df, dump).awaitTermination()
    every = spark.read.parquet(path).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return rounded(every, "total")


@query("stream_text_map", f"WITH {E} SELECT tick, value FROM e WHERE event_type <> 'error'")
def _(spark, sf):
    path = scratch(spark, "lines")
    df = events(spark, sf, F.struct("event_type", "value")).df
    df.select(F.concat_ws(";", F.col("tick").cast("string"), "value.event_type", F.col("value.value").cast("string"))).write.text(path)
    parts = F.split("value", ";")
    parse = F.when(parts[1] != "error", F.struct(parts[0].cast("long").alias("tick"), parts[2].cast("double").alias("value")))
    return run(readers.read_text_map(spark.readStream.text(path), parse))
