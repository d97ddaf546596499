"""Creation, element-wise and whole-series operators."""

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from ..operators import create, cross, elements
from ..trs import TRS
from .base import D, DAY, E, HOUR, daily, events, query, r, rounded, table

HOURLY = TRS(timedelta(hours=1), datetime(2024, 1, 1, tzinfo=timezone.utc))
START = 1704067200000  # 2024-01-01 in milliseconds


@query("time_series", "SELECT CAST(epoch_us(ts) // 1000 AS BIGINT) AS tick, value FROM events")
def _(spark, sf):
    return create.time_series(table(spark, sf, "events"), "ts", "value").df.select("tick", "value")


@query(
    "time_series_trs",
    f"SELECT CAST((epoch_ms(ts) - {START}) // {HOUR} AS BIGINT) AS tick, value, "
    f"epoch_ms({START} + ((epoch_ms(ts) - {START}) // {HOUR}) * {HOUR}) AS timestamp FROM events",
)
def _(spark, sf):
    ts = create.time_series(table(spark, sf, "events"), "ts", "value", HOURLY.granularity, HOURLY.start_time)
    out = create.to_df(ts).drop("series")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("multi_time_series", f"WITH {E} SELECT user_id, tick, value FROM e")
def _(spark, sf):
    return events(spark, sf).df.select("user_id", "tick", "value")


@query(
    "multi_time_series_instants",
    "SELECT key, CAST(o_orderkey AS BIGINT) AS tick, value FROM (SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS cust FROM orders) "
    "UNPIVOT (value FOR key IN (o_totalprice, cust))",
)
def _(spark, sf):
    wide = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("cust"))
    return create.multi_time_series(wide, "o_orderkey", instants=["o_totalprice", "cust"]).df


@query(
    "multi_time_series_dict",
    f"WITH {E} SELECT event_type AS key, tick, value FROM e WHERE event_type IN ('view', 'purchase')",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    pick = lambda kind: create.time_series(ev.where(F.col("event_type") == kind), "ts", "value", ord="event_id")
    return create.to_df_observations(create.multi_from_dict({k: pick(k) for k in ("view", "purchase")}))


@query("to_df_observations", f"WITH {E} SELECT user_id, tick, value FROM e")
def _(spark, sf):
    return events(spark, sf).to_df_observations()


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "to_df_instants",
    "SELECT epoch_ms(ts) // 3600000 AS tick, "
    + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN value END) AS {k}" for k in KINDS)
    + " FROM events GROUP BY 1",
)
def _(spark, sf):
    ts = create.multi_time_series(table(spark, sf, "events"), "ts", "event_type", "value", granularity=timedelta(hours=1))
    best = ts.transform(lambda t: t.with_df(t.df.groupBy("event_type", "tick").agg(F.max("value").alias("value"))))
    return best.to_df_instants(KINDS)


@query("map", f"WITH {E} SELECT user_id, tick, value * 2 + 1 AS value FROM e")
def _(spark, sf):
    return events(spark, sf).map("value * 2 + 1").to_df_observations()


@query(
    "map_with_index",
    f"WITH {E} SELECT user_id, tick, value + row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) - 1 AS value FROM e",
)
def _(spark, sf):
    return events(spark, sf).map_with_index("value + rn").to_df_observations()


@query("flatmap", f"WITH {E} SELECT user_id, tick, unnest([value, -value, value * 10]) AS value FROM e")
def _(spark, sf):
    return events(spark, sf).flatmap("array(value, -value, value * 10)").to_df_observations()


@query("filter", f"WITH {E} SELECT user_id, tick, value FROM e WHERE value > 50")
def _(spark, sf):
    return events(spark, sf).filter("value > 50").to_df_observations()


@query(
    "filter_series",
    f"WITH {E} SELECT user_id, tick, value FROM e WHERE user_id IN (SELECT user_id FROM e GROUP BY 1 HAVING avg(value) > 50)",
)
def _(spark, sf):
    return events(spark, sf).filter_series("avg(value) > 50").to_df_observations()


@query("filter_series_key", f"WITH {E} SELECT user_id, tick, value FROM e WHERE user_id % 3 = 0")
def _(spark, sf):
    return events(spark, sf).filter_series_key("user_id % 3 = 0").to_df_observations()


def _scaled(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf["value"] = pdf["value"] / pdf["value"].max()
    return pdf


@query("map_series", f"WITH {E} SELECT user_id, tick, round(value / max(value) OVER (PARTITION BY user_id), 6) AS value FROM e")
def _(spark, sf):
    return rounded(events(spark, sf).map_series(_scaled).to_df_observations(), "value")


def _keyed(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf["value"] = pdf["value"] + key[0]
    return pdf


@query("map_series_with_key", f"WITH {E} SELECT user_id, tick, round(value + user_id, 6) AS value FROM e")
def _(spark, sf):
    return rounded(events(spark, sf).map_series_with_key(_keyed).to_df_observations(), "value")


def _capped_sum(pdf: pd.DataFrame, state: str):
    """Running sum that starts over once it passes 500."""
    total, out = float(state), []
    for v in pdf["value"]:
        total = v if total > 500 else total + v
        out.append(total)
    return pdf[["tick", "event_id"]].assign(value=out), repr(total)


@query(
    "fold_series",
    f"""WITH RECURSIVE {E}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS rn FROM e),
c AS (SELECT user_id, rn, tick, value AS total FROM k WHERE rn = 1 UNION ALL
 SELECT k.user_id, k.rn, k.tick, CASE WHEN c.total > 500 THEN k.value ELSE c.total + k.value END FROM c JOIN k ON k.user_id = c.user_id AND k.rn = c.rn + 1)
SELECT user_id, tick, round(total, 6) AS value FROM c""",
)
def _(spark, sf):
    return rounded(events(spark, sf).fold_series(_capped_sum, "0.0").to_df_observations(), "value")


@query("map_series_key", f"WITH {E} SELECT 'u' || user_id AS key, tick, value FROM e")
def _(spark, sf):
    return events(spark, sf).map_series_key("concat('u', user_id)").to_df_observations()


@query("keys", "SELECT DISTINCT user_id FROM events")
def _(spark, sf):
    return events(spark, sf).series_keys()


@query("get_time_series", f"WITH {E} SELECT user_id, tick, value FROM e WHERE user_id = 7")
def _(spark, sf):
    return events(spark, sf).get_time_series(7).to_df_observations()


LO, HI = START + 5 * DAY, START + 12 * DAY


@query("get_values", f"WITH {E} SELECT user_id, tick, value FROM e WHERE tick BETWEEN {LO} AND {HI}")
def _(spark, sf):
    return events(spark, sf).get_values(LO, HI).to_df_observations()


@query(
    "range_reader",
    f"WITH {E}, b AS (SELECT user_id, coalesce(max(CASE WHEN tick <= {LO} THEN tick END), {LO}) AS a, "
    f"coalesce(min(CASE WHEN tick >= {HI} THEN tick END), {HI}) AS z FROM e GROUP BY 1) "
    "SELECT e.user_id, tick, value FROM e JOIN b USING (user_id) WHERE tick BETWEEN a AND z",
)
def _(spark, sf):
    return events(spark, sf).get_values(LO, HI, inclusive=True).to_df_observations()


@query(
    "collect_series",
    f"WITH {E} SELECT user_id, CAST(0 AS BIGINT) AS chunk, len(list(tick)) AS n, string_agg(CAST(round(value * 100) AS BIGINT), ',' ORDER BY tick, event_id) AS vals FROM e GROUP BY 1",
)
def _(spark, sf):
    out = events(spark, sf).collect_series()
    cents = F.transform("observations", lambda o: F.round(o["value"] * 100).cast("bigint").cast("string"))
    return out.select("user_id", "chunk", F.size("observations").cast("bigint").alias("n"), F.array_join(cents, ",").alias("vals"))


@query("to_time_series", f"WITH {E} SELECT user_id, tick, value FROM e")
def _(spark, sf):
    return elements.unpack(events(spark, sf).collect_series(), ["user_id"]).to_df_observations()


@query("count", f"WITH {E} SELECT user_id, count(*) AS count FROM e GROUP BY 1")
def _(spark, sf):
    return events(spark, sf).count()


MID = START + 15 * DAY


@query("concat", f"WITH {E} SELECT user_id, tick, value FROM e WHERE tick <> {MID}")
def _(spark, sf):
    ts = events(spark, sf)
    return ts.filter(f"tick < {MID}").concat(ts.filter(f"tick > {MID}")).to_df_observations()


@query(
    "lag",
    f"WITH {E} SELECT user_id, tick, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS k FROM e) WHERE k > 3",
)
def _(spark, sf):
    return events(spark, sf).lag(3).to_df_observations()


@query(
    "shift",
    f"WITH {E} SELECT user_id, tick, lag(value, 2) OVER w AS value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)",
)
def _(spark, sf):
    return events(spark, sf).shift(2).to_df_observations()


@query(
    "shift_back_default",
    f"WITH {E} SELECT user_id, tick, lead(value, 1, -1.0) OVER w AS value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)",
)
def _(spark, sf):
    return events(spark, sf).shift(-1, -1.0).to_df_observations()


@query("with_trs", f"WITH {E} SELECT user_id, CAST((tick - {START}) // {HOUR} AS BIGINT) AS tick, value FROM e")
def _(spark, sf):
    return events(spark, sf).with_trs(HOURLY.granularity, HOURLY.start_time).to_df_observations()


@query(
    "trs_projection",
    f"WITH {E}, i AS (SELECT user_id, tick AS ms, (tick - {START}) // {HOUR} AS idx FROM e) "
    f"SELECT user_id, ms, CAST(idx AS BIGINT) AS idx, CAST({START} + idx * {HOUR} AS BIGINT) AS lower, CAST({START} + (idx + 1) * {HOUR} - 1 AS BIGINT) AS upper FROM i",
)
def _(spark, sf):
    df = events(spark, sf).df.select("user_id", F.col("tick").alias("ms"))
    df = df.withColumn("idx", HOURLY.to_index(F.col("ms")))
    return df.withColumn("lower", HOURLY.to_long_lower(F.col("idx"))).withColumn("upper", HOURLY.to_long_upper(F.col("idx")))


_DESCRIBE = f"""
WITH {E}, g AS (SELECT *, tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS gap FROM e),
b AS (SELECT user_id, count(*) AS count, arg_min(value, tick) AS first, arg_max(value, tick) AS last,
  min(gap) AS min_inter_arrival_time, max(gap) AS max_inter_arrival_time,
  round((max(tick) - min(tick)) / nullif(count(*) - 1, 0), 4) AS mean_inter_arrival_time,
  round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
  round(quantile_cont(value, 0.25), 6) AS "25%", round(quantile_cont(value, 0.5), 6) AS "50%", round(quantile_cont(value, 0.75), 6) AS "75%"
  FROM g GROUP BY 1),
c AS (SELECT user_id, value, count(*) AS k FROM e GROUP BY ALL),
t AS (SELECT user_id, max(k) AS frequency, count(*) AS "unique", arg_min(value, ({{'k': -k, 'v': value}})) AS top FROM c GROUP BY 1)
SELECT b.*, t.frequency, t."unique", t.top FROM b JOIN t USING (user_id)
"""


@query("describe", _DESCRIBE)
def _(spark, sf):
    out = events(spark, sf).describe()
    return rounded(rounded(out, "mean", "std", "25%", "50%", "75%"), "mean_inter_arrival_time", digits=4)


@query(
    "stats_categorical",
    f"""WITH {E}, c AS (SELECT user_id, event_type AS v, count(*) AS k FROM e GROUP BY ALL)
SELECT user_id, n AS count, frequency, "unique", top FROM (SELECT user_id, count(*) AS n FROM e GROUP BY 1)
JOIN (SELECT user_id, max(k) AS frequency, count(*) AS "unique", arg_min(v, ({{'k': -k, 'v': v}})) AS top FROM c GROUP BY 1) USING (user_id)""",
)
def _(spark, sf):
    return events(spark, sf, "event_type").describe().select("user_id", "count", "frequency", "unique", "top")


# Cross-series aggregation


@query("aggregate", "SELECT round(sum(value * value), 4) AS value FROM events")
def _(spark, sf):
    return rounded(events(spark, sf).aggregate("sum(value * value)"), "value", digits=4)


@query("aggregate_fold", "SELECT round(sum(value), 4) AS value FROM events")
def _(spark, sf):
    out = cross.aggregate_fold(events(spark, sf), 0.0, lambda acc, v: acc + float(v.sum()), lambda a, b: a + b)
    return rounded(out, "value", digits=4)


@query("aggregate_series", f"WITH {D} SELECT tick, round(avg(value), 9) AS value FROM d GROUP BY 1")
def _(spark, sf):
    return rounded(daily(spark, sf).aggregate_series("avg(value)").df.select("tick", "value"), "value", digits=9)


@query(
    "aggregate_series_with_key",
    f"WITH {D} SELECT tick, arg_max(l_suppkey, {{'v': value, 'k': l_suppkey}}) AS best, round(sum(value) FILTER (l_suppkey % 2 = 0), 2) AS even FROM d GROUP BY 1",
)
def _(spark, sf):
    both = "struct(max_by(l_suppkey, struct(value, l_suppkey)) AS best, round(sum(value) FILTER (WHERE l_suppkey % 2 = 0), 2) AS even)"
    return daily(spark, sf).aggregate_series_with_key(both).df.select("tick", "value.*")


@query(
    "pair_wise_transform",
    f"WITH {D} SELECT a.l_suppkey AS left_l_suppkey, b.l_suppkey AS right_l_suppkey, round(corr(a.value, b.value), 6) AS value, count(*) AS n "
    "FROM d a JOIN d b ON a.tick = b.tick AND b.l_suppkey = a.l_suppkey + 1 GROUP BY 1, 2 HAVING count(*) > 2",
)
def _(spark, sf):
    ts = daily(spark, sf)
    keys = ts.series_keys()
    pairs = keys.select(F.col("l_suppkey").alias("left_l_suppkey"), (F.col("l_suppkey") + 1).alias("right_l_suppkey"))
    both = F.struct(F.corr("left", "right").alias("c"), F.count(F.lit(1)).alias("n"))
    out = ts.pair_wise_transform(both, pairs).where("value.n > 2")
    return out.select("left_l_suppkey", "right_l_suppkey", r("value.c").alias("value"), F.col("value.n").alias("n"))
