"""Segmentation."""

from pyspark.sql import functions as F

from ..operators import reducers
from .base import DAY, E, HOUR, events, query, r, rounded

W = "WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)"
# One row per segment: size, sum and ends; ids become ranks where they are arbitrary.
SUM = "count(*) AS n, round(sum(value), 6) AS total, min(tick) AS first, max(tick) AS last"


def summary(segs, *extra):
    out = segs.df.groupBy(*segs.group, *extra).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"), F.min("tick").alias("first"), F.max("tick").alias("last")
    )
    return out


@query(
    "segment",
    f"""WITH {E}, k AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM e {W}),
s AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((rn - 4) / 2.0) AS BIGINT)), least(rn // 2, (c - 5) // 2))) AS seg_id FROM k WHERE c >= 5)
SELECT user_id, seg_id, {SUM} FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    return summary(events(spark, sf).segment(5, 2))


@query(
    "segment_short_kept",
    f"""WITH {E}, k AS (SELECT *, row_number() OVER w - 1 AS rn FROM e {W}) SELECT user_id, rn // 10 AS seg_id, {SUM} FROM k GROUP BY 1, 2""",
)
def _(spark, sf):
    return summary(events(spark, sf).segment(10, 10, enforce_size=False))


@query(
    "segment_by_time",
    f"""WITH {E}, k AS (SELECT *, tick - min(tick) OVER (PARTITION BY user_id) AS o, min(tick) OVER (PARTITION BY user_id) AS a FROM e)
SELECT user_id, CAST(o // {2 * DAY} AS BIGINT) AS seg_id, CAST(any_value(a) + (o // {2 * DAY}) * {2 * DAY} AS BIGINT) AS seg_start, {SUM} FROM k GROUP BY user_id, o // {2 * DAY}""",
)
def _(spark, sf):
    return summary(events(spark, sf).segment_by_time(2 * DAY), "seg_start")


@query(
    "segment_by_time_sliding",
    f"""WITH {E}, k AS (SELECT *, tick - min(tick) OVER (PARTITION BY user_id) AS o FROM e),
s AS (SELECT *, unnest(generate_series(greatest(0, CAST(floor((o - {3 * DAY}) / {float(DAY)}) AS BIGINT) + 1), o // {DAY})) AS seg_id FROM k)
SELECT user_id, seg_id, {SUM} FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    return summary(events(spark, sf).segment_by_time(3 * DAY, DAY))


# Aggregates of overlapping windows, from panes.


@query(
    "segment_panes",
    f"""WITH {E}, k AS (SELECT user_id, tick, row_number() OVER w - 1 AS seg_id, avg(value) OVER f AS value, count(*) OVER f AS c FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id), f AS (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
SELECT user_id, tick, seg_id, round(value, 6) AS value FROM k WHERE c = 12""",
)
def _(spark, sf):
    return rounded(events(spark, sf).segment(12, 1).transform(reducers.average()).df, "value")


@query(
    "segment_panes_short_kept",
    f"""WITH {E}, k AS (SELECT user_id, tick, value, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) - 1 AS rn FROM e),
s AS (SELECT a.user_id, a.rn // 6 AS seg_id, a.tick, max(b.value) AS value FROM k a JOIN k b ON b.user_id = a.user_id AND b.rn BETWEEN a.rn AND a.rn + 19 WHERE a.rn % 6 = 0 GROUP BY ALL)
SELECT user_id, tick, seg_id, value FROM s""",
)
def _(spark, sf):
    return events(spark, sf).segment(20, 6, enforce_size=False).transform(reducers.max()).df


@query(
    "segment_panes_by_time",
    f"""WITH {E}, k AS (SELECT *, min(tick) OVER (PARTITION BY user_id) AS a, tick - min(tick) OVER (PARTITION BY user_id) AS o FROM e),
s AS (SELECT *, unnest(generate_series(greatest(0, CAST(floor((o - {3 * DAY}) / {float(10 * HOUR)}) AS BIGINT) + 1), o // {10 * HOUR})) AS seg_id FROM k)
SELECT user_id, CAST(any_value(a) + seg_id * {10 * HOUR} AS BIGINT) AS tick, seg_id, round(stddev_samp(value), 6) AS value FROM s GROUP BY user_id, seg_id""",
)
def _(spark, sf):
    return rounded(events(spark, sf).segment_by_time(3 * DAY, 10 * HOUR).transform(reducers.standard_deviation()).df, "value")


@query("segment_by", f"WITH {E} SELECT user_id, CAST(value AS BIGINT) % 2 = 0 AS seg_id, {SUM} FROM (SELECT * REPLACE (floor(value) AS value) FROM e) GROUP BY ALL")
def _(spark, sf):
    return summary(events(spark, sf).map("floor(value)").segment_by("value % 2 = 0"))


@query(
    "segment_by_anchor",
    f"""WITH {E} SELECT a.user_id, a.tick AS seg_id, CAST(a.tick - {6 * HOUR} AS BIGINT) AS seg_start, CAST(a.tick + {12 * HOUR} AS BIGINT) AS seg_end,
count(*) AS n, round(sum(e.value), 6) AS total FROM e a JOIN e ON e.user_id = a.user_id AND e.tick BETWEEN a.tick - {6 * HOUR} AND a.tick + {12 * HOUR} WHERE a.value > 100 GROUP BY ALL""",
)
def _(spark, sf):
    segs = events(spark, sf).segment_by_anchor("value > 100", 6 * HOUR, 12 * HOUR)
    return segs.df.groupBy(*segs.group, "seg_start", "seg_end").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))


@query(
    "segment_by_changepoint",
    f"""WITH {E}, f AS (SELECT *, CASE WHEN lag(tick) OVER w IS NOT NULL AND event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS f FROM e {W}),
s AS (SELECT *, CAST(sum(f) OVER w AS BIGINT) AS seg_id FROM f {W}) SELECT user_id, seg_id, any_value(event_type) AS kind, count(*) AS n, min(tick) AS first FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    segs = events(spark, sf, "event_type").segment_by_changepoint()
    return segs.df.groupBy(*segs.group).agg(F.min("value").alias("kind"), F.count(F.lit(1)).alias("n"), F.min("tick").alias("first"))


@query(
    "segment_by_changepoint_custom",
    f"""WITH {E}, f AS (SELECT *, CASE WHEN abs(value - lag(value) OVER w) > 50 THEN 1 ELSE 0 END AS f FROM e {W}),
s AS (SELECT *, CAST(sum(f) OVER w AS BIGINT) AS seg_id FROM f {W}) SELECT user_id, seg_id, {SUM} FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    return summary(events(spark, sf).segment_by_changepoint("abs(value - prev) > 50"))


MARKS = f"""{E}, m AS (SELECT *, CASE WHEN event_type = 'signup' THEN 's' WHEN event_type = 'purchase' THEN 'e' END AS m FROM e),
k AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
 first_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM m)"""


@query(
    "segment_by_marker",
    f"""WITH {MARKS}, o AS (SELECT user_id, tick AS t0, row_number() OVER (PARTITION BY user_id ORDER BY tick) AS seg_id FROM k WHERE m = 's' AND (b IS NULL OR b = 'e')),
c AS (SELECT user_id, tick AS t1, row_number() OVER (PARTITION BY user_id ORDER BY tick) AS seg_id FROM k WHERE m = 'e' AND b = 's')
SELECT user_id, seg_id, {SUM} FROM o JOIN c USING (user_id, seg_id) JOIN e USING (user_id) WHERE tick BETWEEN t0 AND t1 GROUP BY 1, 2""",
)
def _(spark, sf):
    ts = events(spark, sf, F.struct("event_type", "value"))
    segs = ts.segment_by_marker("value.event_type = 'signup'", "value.event_type = 'purchase'")
    return summary(segs.with_df(segs.df.withColumn("value", F.col("value.value"))))


@query(
    "segment_by_marker_last_open",
    f"""WITH {MARKS}, o AS (SELECT user_id, tick AS t0, row_number() OVER (PARTITION BY user_id ORDER BY tick) AS seg_id FROM k WHERE m = 's' AND (a IS NULL OR a = 'e')),
c AS (SELECT user_id, tick AS t1, row_number() OVER (PARTITION BY user_id ORDER BY tick) AS seg_id FROM k WHERE m = 'e' AND (a IS NULL OR a = 's') AND user_id || '' IN (SELECT user_id || '' FROM o WHERE o.user_id = k.user_id AND o.t0 < k.tick))
SELECT user_id, seg_id, {SUM} FROM o LEFT JOIN c USING (user_id, seg_id) JOIN e USING (user_id) WHERE tick > t0 AND (t1 IS NULL OR tick < t1) GROUP BY 1, 2""",
)
def _(spark, sf):
    ts = events(spark, sf, F.struct("event_type", "value"))
    segs = ts.segment_by_marker(
        "value.event_type = 'signup'", "value.event_type = 'purchase'", start_inclusive=False, end_inclusive=False,
        start_on_first=False, end_on_first=False, requires_start_and_end=False,
    )
    return summary(segs.with_df(segs.df.withColumn("value", F.col("value.value"))))


@query(
    "static_threshold",
    f"""WITH {E}, f AS (SELECT *, CASE WHEN tick - lag(tick) OVER w > {12 * HOUR} THEN 1 ELSE 0 END AS f FROM e {W}),
s AS (SELECT *, CAST(sum(f) OVER w AS BIGINT) AS seg_id FROM f {W}) SELECT user_id, seg_id, {SUM} FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    return summary(events(spark, sf).to_segments("static_threshold", threshold=12 * HOUR))


@query(
    "dynamic_threshold",
    f"""WITH {E}, g AS (SELECT *, row_number() OVER w - 1 AS rn, tick - lag(tick) OVER w AS gap FROM e {W}),
x AS (SELECT *, CASE WHEN rn = 0 THEN 0.0 WHEN rn = 1 THEN CAST(gap AS DOUBLE) ELSE gap * 0.3 END / pow(0.7, rn) AS x FROM g),
m AS (SELECT *, sum(x) OVER w * pow(0.7, rn) AS mean FROM x {W}),
f AS (SELECT *, CASE WHEN gap > {6 * HOUR} AND gap > CASE WHEN rn >= 2 THEN 1.5 * lag(mean) OVER w ELSE 0 END THEN 1 ELSE 0 END AS f FROM m {W}),
s AS (SELECT *, CAST(sum(f) OVER w AS BIGINT) AS seg_id FROM f {W}) SELECT user_id, seg_id, {SUM} FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    return summary(events(spark, sf).to_segments("dynamic_threshold", alpha=0.3, factor=1.5, threshold=6 * HOUR))


@query(
    "cusum",
    f"""WITH RECURSIVE {E}, k AS (SELECT *, row_number() OVER w AS rn FROM e {W}),
c AS (SELECT user_id, rn, tick, value, value AS base, 0.0::DOUBLE AS total, 0::BIGINT AS seg_id FROM k WHERE rn = 1
 UNION ALL SELECT k.user_id, k.rn, k.tick, k.value,
  CASE WHEN abs(c.total + k.value - c.base) > 200 THEN k.value ELSE c.base END,
  CASE WHEN abs(c.total + k.value - c.base) > 200 THEN 0.0 ELSE c.total + (k.value - c.base) END,
  CASE WHEN abs(c.total + k.value - c.base) > 200 THEN c.seg_id + 1 ELSE c.seg_id END
 FROM c JOIN k ON k.user_id = c.user_id AND k.rn = c.rn + 1)
SELECT user_id, seg_id, {SUM} FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return summary(events(spark, sf).to_segments("cusum", threshold=200.0))


@query(
    "regression",
    f"""WITH RECURSIVE {E}, k AS (SELECT *, row_number() OVER w AS rn FROM e {W}),
c AS (SELECT user_id, rn, tick, value, 0::BIGINT AS seg_id, tick AS t0, 1::BIGINT AS n, 0.0::DOUBLE AS sx, value AS sy, 0.0::DOUBLE AS sxx, 0.0::DOUBLE AS sxy, 0::BIGINT AS missed FROM k WHERE rn = 1
 UNION ALL SELECT user_id, rn, tick, value, CASE WHEN cut THEN seg_id + 1 ELSE seg_id END, CASE WHEN cut THEN tick ELSE t0 END,
  CASE WHEN cut THEN 1 WHEN ok THEN n + 1 ELSE n END, CASE WHEN cut THEN 0.0 WHEN ok THEN sx + x ELSE sx END, CASE WHEN cut THEN value WHEN ok THEN sy + value ELSE sy END,
  CASE WHEN cut THEN 0.0 WHEN ok THEN sxx + x * x ELSE sxx END, CASE WHEN cut THEN 0.0 WHEN ok THEN sxy + x * value ELSE sxy END, CASE WHEN cut OR ok THEN 0 ELSE missed + 1 END
 FROM (SELECT *, NOT ok AND missed + 1 > 1 AS cut FROM (SELECT *, n < 2 OR abs(value - ((sy - slope * sx) / n + slope * x)) <= 40.0 AS ok FROM (
  SELECT k.user_id, k.rn, k.tick, k.value, c.seg_id, c.t0, c.n, c.sx, c.sy, c.sxx, c.sxy, c.missed, CAST(k.tick - c.t0 AS DOUBLE) AS x,
   CASE WHEN c.n * c.sxx - c.sx * c.sx <> 0 THEN (c.n * c.sxy - c.sx * c.sy) / (c.n * c.sxx - c.sx * c.sx) ELSE 0.0 END AS slope
  FROM c JOIN k ON k.user_id = c.user_id AND k.rn = c.rn + 1))))
SELECT user_id, seg_id, {SUM} FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return summary(events(spark, sf).to_segments("regression", max_error=40.0, skip=1))


@query(
    "statistical_changepoint",
    f"""WITH {E}, z AS (SELECT *, row_number() OVER w - 1 AS rn, (value - avg(value) OVER (PARTITION BY user_id)) / stddev_samp(value) OVER (PARTITION BY user_id) AS z FROM e {W}),
j AS (SELECT *, abs(z - lag(z) OVER w) > 1.5 AS jump FROM z {W}),
l AS (SELECT *, last_value(CASE WHEN jump OR rn = 0 THEN rn END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM j),
f AS (SELECT *, CASE WHEN jump AND rn - last >= 2 THEN 1 ELSE 0 END AS f FROM l),
s AS (SELECT *, CAST(sum(f) OVER w AS BIGINT) AS seg_id FROM f {W}) SELECT user_id, seg_id, {SUM} FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    return summary(events(spark, sf).to_segments("statistical_changepoint", min_segment_size=2, threshold=1.5))


TIMED = f"k AS (SELECT *, CAST((tick - min(tick) OVER (PARTITION BY user_id)) // {7 * DAY} AS BIGINT) AS seg_id, min(tick) OVER (PARTITION BY user_id) AS a FROM e)"
START = f"CAST(any_value(a) + seg_id * {7 * DAY} AS BIGINT) AS tick"


@query("segment_flatten", f"WITH {E}, {TIMED} SELECT user_id, 'w' || seg_id AS seg_key, count(*) AS count FROM k GROUP BY ALL")
def _(spark, sf):
    return events(spark, sf).segment_by_time(7 * DAY).flatten("concat('w', seg_id)").count()


@query("segment_map", f"WITH {E}, {TIMED} SELECT user_id, seg_id, {START}, round(max(value) - min(value), 6) AS value FROM k GROUP BY user_id, seg_id")
def _(spark, sf):
    out = events(spark, sf).segment_by_time(7 * DAY).map("max(value) - min(value)")
    return rounded(out.df, "value")


@query(
    "segment_flatmap",
    f"WITH {E}, {TIMED} SELECT user_id, seg_id, tick, unnest([lo, hi]) AS value FROM (SELECT user_id, seg_id, {START}, min(value) AS lo, max(value) AS hi FROM k GROUP BY user_id, seg_id)",
)
def _(spark, sf):
    return events(spark, sf).segment_by_time(7 * DAY).flatmap("array(min(value), max(value))").df.select("user_id", "seg_id", "tick", "value")


@query("segment_filter", f"WITH {E}, {TIMED} SELECT user_id, seg_id, {SUM} FROM k GROUP BY 1, 2 HAVING count(*) > 12")
def _(spark, sf):
    return summary(events(spark, sf).segment_by_time(7 * DAY).filter("count(*) > 12"))


@query("segment_transform", f"WITH {E}, {TIMED} SELECT user_id, {START}, round(avg(value), 9) AS value FROM k GROUP BY user_id, seg_id")
def _(spark, sf):
    return rounded(events(spark, sf).segment_by_time(7 * DAY).transform(reducers.average()).to_df_observations(), "value", digits=9)


@query(
    "segment_transform_percentile",
    f"WITH {E}, {TIMED} SELECT user_id, {START}, round(quantile_cont(value, 0.9), 6) AS value FROM k GROUP BY user_id, seg_id",
)
def _(spark, sf):
    return rounded(events(spark, sf).segment_by_time(7 * DAY).transform(reducers.percentile(0.9)).to_df_observations(), "value")


@query(
    "segment_bounds",
    f"WITH {E}, k AS (SELECT *, row_number() OVER w - 1 AS rn FROM e {W}) SELECT user_id, rn // 8 AS seg_id, min(tick) AS seg_start, max(tick) AS seg_end, count(*) AS n FROM k GROUP BY 1, 2",
)
def _(spark, sf):
    return events(spark, sf).segment(8, 8, enforce_size=False).bounds()
