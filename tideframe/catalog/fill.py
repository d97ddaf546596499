"""Interpolation, resampling, navigation, temporal joins."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions import interpolators as ip
from ..operators import fill
from ..operators.create import multi_time_series
from .base import D, DAY, E, HOUR, daily, events, query, rounded, spread, table

# A third of the values is taken out, so that there is something to fill.
GAP = "g AS (SELECT user_id, tick, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM e)"
W = "WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)"
NEIGHBOURS = f"""n AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN {{'t': tick, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
  first_value(CASE WHEN value IS NOT NULL THEN {{'t': tick, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM g)"""


def gappy(spark, sf):
    return events(spark, sf).map(F.when(F.col("event_id") % 3 != 0, F.col("value")))


def _fill_sql(expr):
    return f"WITH {E}, {GAP}, {NEIGHBOURS} SELECT user_id, tick, round(coalesce(value, {expr}), 9) AS value FROM n"


LINEAR = "p.v + (x.v - p.v) / (x.t - p.t) * (tick - p.t)"
NEAREST = "CASE WHEN p IS NOT NULL AND (x IS NULL OR tick - p.t <= x.t - tick) THEN p.v ELSE x.v END"

for _name, _interp, _expr in [
    ("fillna_fill", ip.fill(0.5), "0.5"),
    ("fillna_nullify", ip.nullify(), "NULL"),
    ("fillna_prev", ip.prev(-1.0), "coalesce(p.v, -1.0)"),
    ("fillna_next", ip.next(-1.0), "coalesce(x.v, -1.0)"),
    ("fillna_nearest", ip.nearest(), NEAREST),
    ("fillna_linear", ip.linear(0.0), f"coalesce({LINEAR}, 0.0)"),
]:

    def _run(spark, sf, interp=_interp):
        return rounded(gappy(spark, sf).fillna(interp).to_df_observations(), "value", digits=9)

    query(_name, _fill_sql(_expr))(_run)


@query(
    "fillna_null_value",
    f"WITH {E}, g AS (SELECT user_id, tick, event_id, nullif(event_type, 'error') AS value FROM e) "
    f"SELECT user_id, tick, coalesce(value, last_value(value IGNORE NULLS) OVER w) AS value FROM g {W}",
)
def _(spark, sf):
    return events(spark, sf, "event_type").fillna(ip.prev(), null_value="error").to_df_observations()


# The two observations before and after each gap, from observed rows only.
CUBIC = f"""
WITH {E}, {GAP},
o AS (SELECT *, lag(tick) OVER w AS t0, lag(value) OVER w AS v0, lead(tick) OVER w AS t3, lead(value) OVER w AS v3 FROM g WHERE value IS NOT NULL {W}),
a AS (SELECT g.user_id, g.tick, g.event_id, g.value, o.tick AS pt, o.value AS pv, o.t0, o.v0, o.t3, o.v3 FROM g LEFT JOIN o USING (user_id, event_id)),
n AS (SELECT user_id, tick, event_id, value,
 last_value(CASE WHEN pt IS NOT NULL THEN {{'t1': pt, 'v1': pv, 't0': t0, 'v0': v0}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
 first_value(CASE WHEN pt IS NOT NULL THEN {{'t2': pt, 'v2': pv, 't3': t3, 'v3': v3}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM a),
k AS (SELECT user_id, tick, value, p IS NOT NULL AND x IS NOT NULL AS ok,
 [z FOR z IN [{{'t': p.t0, 'v': p.v0}}, {{'t': p.t1, 'v': p.v1}}, {{'t': x.t2, 'v': x.v2}}, {{'t': x.t3, 'v': x.v3}}] IF z.t IS NOT NULL] AS pts FROM n),
s AS (SELECT user_id, tick, sum(poly) AS poly FROM (
  SELECT user_id, tick, i, any_value(pv) * product(CASE WHEN i = j THEN 1.0 ELSE (tick - qt) / CAST(pt - qt AS DOUBLE) END) AS poly FROM (
    SELECT user_id, tick, i, j, pts[i].t AS pt, pts[i].v AS pv, pts[j].t AS qt FROM (
      SELECT user_id, tick, pts, i, unnest(range(1, len(pts) + 1)) AS j FROM (
        SELECT user_id, tick, pts, unnest(range(1, len(pts) + 1)) AS i FROM k WHERE value IS NULL AND ok)))
  GROUP BY user_id, tick, i) GROUP BY ALL)
SELECT k.user_id, k.tick, round(coalesce(value, poly, 0.0), 6) AS value FROM k LEFT JOIN s USING (user_id, tick)
"""


@query("fillna_cubic", CUBIC)
def _(spark, sf):
    return rounded(gappy(spark, sf).fillna(ip.cubic(0.0)).to_df_observations(), "value")


@query(
    "fillna_linear_wide",
    f"""WITH {E}, {GAP},
o AS (SELECT *, row_number() OVER w AS k FROM g WHERE value IS NOT NULL {W}),
n AS (SELECT g.user_id, g.tick, g.event_id, g.value, last_value(o.k IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.tick, g.event_id) AS pk FROM g LEFT JOIN o USING (user_id, event_id)),
c AS (SELECT user_id, max(k) AS m FROM o GROUP BY 1),
f AS (SELECT n.user_id, n.event_id, regr_intercept(o.value, o.tick - n.tick) AS v, max(c.m) AS m, any_value(n.pk) AS pk
  FROM n JOIN c USING (user_id) JOIN o ON o.user_id = n.user_id AND o.k BETWEEN n.pk - 1 AND n.pk + 2 WHERE n.value IS NULL GROUP BY 1, 2)
SELECT n.user_id, n.tick, round(coalesce(n.value, CASE WHEN f.pk < f.m THEN f.v END, 0.0), 5) AS value FROM n LEFT JOIN f USING (user_id, event_id)""",
)
def _(spark, sf):
    return rounded(gappy(spark, sf).fillna(ip.linear(0.0, 2, 2)).to_df_observations(), "value", digits=5)


def _weighted(tick: pd.Series, history: pd.Series, future: pd.Series) -> pd.Series:
    """Mean of the nearby observations."""
    return pd.Series([float(sum(p[1] for p in [*h, *f]) / max(1, len(h) + len(f))) for h, f in zip(history, future)])


@query("fillna_custom", _fill_sql("(coalesce(p.v, 0) + coalesce(x.v, 0)) / greatest(1, (p IS NOT NULL)::INT + (x IS NOT NULL)::INT)"))
def _(spark, sf):
    return rounded(gappy(spark, sf).fillna(ip.custom(_weighted)).to_df_observations(), "value", digits=9)


GRID = f"""grid AS (SELECT user_id, unnest(generate_series(a, z, {DAY})) AS tick FROM (SELECT user_id, min(tick) AS a, max(tick) AS z FROM e GROUP BY 1))"""
ASOF = """ASOF LEFT JOIN e p ON p.user_id = grid.user_id AND p.tick <= grid.tick"""
ASOF2 = """ASOF LEFT JOIN e x ON x.user_id = grid.user_id AND x.tick >= grid.tick"""


def _grid_sql(expr):
    return f"WITH {E}, {GRID} SELECT grid.user_id, grid.tick, round({expr}, 9) AS value FROM grid {ASOF} {ASOF2}"


for _name, _interp, _expr in [
    ("resample_prev", ip.prev(), "p.value"),
    ("resample_next", ip.next(), "x.value"),
    ("resample_nearest", ip.nearest(), "CASE WHEN grid.tick - p.tick <= x.tick - grid.tick THEN p.value ELSE x.value END"),
    ("resample_linear", ip.linear(), "p.value + coalesce((x.value - p.value) / nullif(x.tick - p.tick, 0) * (grid.tick - p.tick), 0)"),
    ("resample_fill", ip.fill(0.0), "CASE WHEN p.tick = grid.tick THEN p.value ELSE 0.0 END"),
]:

    def _run(spark, sf, interp=_interp):
        return rounded(events(spark, sf).resample(DAY, interp).to_df_observations(), "value", digits=9)

    query(_name, _grid_sql(_expr))(_run)


@query(
    "resample_weekly_mean",
    f"WITH {E}, {GRID}, p AS (SELECT grid.user_id, grid.tick, p.value, min(grid.tick) OVER (PARTITION BY grid.user_id) AS a FROM grid {ASOF}) "
    f"SELECT user_id, CAST(a + ((tick - a) // {7 * DAY}) * {7 * DAY} AS BIGINT) AS tick, round(avg(value), 9) AS value FROM p GROUP BY 1, 2",
)
def resample_weekly_mean(spark, sf):
    from ..operators import reducers

    weekly = events(spark, sf).resample(DAY, ip.prev()).segment_by_time(7 * DAY).transform(reducers.average())
    return rounded(weekly.to_df_observations(), "value", digits=9)


# Navigation: every purchase asks the user's views.
SIDES = f"{E}, v AS (SELECT * FROM e WHERE event_type = 'view'), b AS (SELECT * FROM e WHERE event_type = 'purchase')"


def views(spark, sf):
    return events(spark, sf, where="event_type = 'view'")


def buys(spark, sf):
    return events(spark, sf, where="event_type = 'purchase'")


for _name, _op in [("floor", "<="), ("lower", "<"), ("ceiling", ">="), ("higher", ">")]:

    def _run(spark, sf, name=_name):
        # Probes sit on view ticks, so that the strict and the inclusive lookups differ.
        probes = views(spark, sf).df.select("user_id", F.col("tick").alias("t"))
        return getattr(fill, name)(views(spark, sf), probes)

    query(
        f"navigate_{_name}",
        f"WITH {SIDES} SELECT a.user_id, a.tick AS t, v.tick, v.value FROM v a ASOF LEFT JOIN v ON v.user_id = a.user_id AND a.tick {'>=' if _op == '<=' else '>' if _op == '<' else '<=' if _op == '>=' else '<'} v.tick",
    )(_run)


@query("first", f"WITH {E} SELECT user_id, min(tick) AS tick, arg_min(value, tick) AS value FROM e GROUP BY 1")
def _(spark, sf):
    return events(spark, sf).first()


@query("last", f"WITH {E} SELECT user_id, max(tick) AS tick, arg_max(value, tick) AS value FROM e GROUP BY 1")
def _(spark, sf):
    return events(spark, sf).last()


@query(
    "contains",
    f"WITH {D}, o AS (SELECT DISTINCT l_suppkey, tick + 1 AS t FROM d) SELECT o.l_suppkey, o.t, d.tick IS NOT NULL AS found FROM o LEFT JOIN d ON d.l_suppkey = o.l_suppkey AND d.tick = o.t",
)
def _(spark, sf):
    ts = daily(spark, sf)
    return fill.contains(ts, ts.df.select("l_suppkey", (F.col("tick") + 1).alias("t")).distinct())


@query(
    "size",
    f"WITH {SIDES} SELECT k.user_id, count(b.tick) AS size, count(b.tick) = 0 AS is_empty FROM (SELECT DISTINCT user_id FROM e) k LEFT JOIN (SELECT * FROM b WHERE value > 100) b USING (user_id) GROUP BY 1",
)
def _(spark, sf):
    return fill.size(buys(spark, sf).filter("value > 100"), table(spark, sf, "events"))


# Joins of two daily series of one supplier: sales of returned and of other items.


def _halves(spark, sf):
    from datetime import datetime, timedelta, timezone

    li = table(spark, sf, "lineitem")
    rows = li.count()
    out = []
    for flag in ("l_returnflag = 'R'", "l_returnflag = 'A'"):
        ts = multi_time_series(li.where(flag), "l_shipdate", "l_suppkey", "l_extendedprice", granularity=timedelta(days=1), start_time=datetime(1970, 1, 1, tzinfo=timezone.utc))
        dealt = spread(ts.df.select("l_suppkey", "tick", "value"), rows, "l_suppkey", "tick")
        out.append(ts.with_df(dealt.groupBy("l_suppkey", "tick").agg(F.round(F.sum("value"), 2).alias("value"))))
    return out


def _half(name, flag):
    return (
        f"{name} AS (SELECT l_suppkey, CAST(epoch_ms(l_shipdate) // 86400000 AS BIGINT) AS tick, round(sum(l_extendedprice), 2) AS value "
        f"FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY ALL)"
    )


HALVES = f"{_half('a', 'R')}, {_half('b', 'A')}"
PAIR = "l_suppkey, tick, a.value AS \"left\", b.value AS \"right\""


def _unpaired(ts):
    return ts.df.select("l_suppkey", "tick", "value.left", "value.right")


for _name, _sql in [
    ("inner", f"SELECT {PAIR} FROM a JOIN b USING (l_suppkey, tick)"),
    ("full", f"SELECT {PAIR} FROM a FULL JOIN b USING (l_suppkey, tick)"),
    ("left", f"SELECT {PAIR} FROM a LEFT JOIN b USING (l_suppkey, tick)"),
    ("right", f"SELECT {PAIR} FROM a RIGHT JOIN b USING (l_suppkey, tick)"),
    ("left_outer", "SELECT l_suppkey, tick, a.value AS \"left\", CAST(NULL AS DOUBLE) AS \"right\" FROM a ANTI JOIN b USING (l_suppkey, tick)"),
    ("right_outer", "SELECT l_suppkey, tick, CAST(NULL AS DOUBLE) AS \"left\", b.value AS \"right\" FROM b ANTI JOIN a USING (l_suppkey, tick)"),
]:

    def _run(spark, sf, name=_name):
        a, b = _halves(spark, sf)
        return _unpaired(getattr(a, f"{name}_join")(b))

    query(f"{_name}_join", f"WITH {HALVES} {_sql}")(_run)

    def _run2(spark, sf, name=_name):
        a, b = _halves(spark, sf)
        x, y = getattr(a, f"{name}_align")(b)
        tag = lambda t, s: t.df.select(F.lit(s).alias("side"), "l_suppkey", "tick", "value")
        return tag(x, "left").unionByName(tag(y, "right"))

    query(
        f"{_name}_align",
        f"WITH {HALVES}, j AS ({_sql}) SELECT 'left' AS side, l_suppkey, tick, \"left\" AS value FROM j UNION ALL SELECT 'right', l_suppkey, tick, \"right\" FROM j",
    )(_run2)


@query(
    "join_func",
    f"WITH {HALVES} SELECT l_suppkey, tick, round(a.value - b.value, 2) AS value FROM a JOIN b USING (l_suppkey, tick)",
)
def _(spark, sf):
    a, b = _halves(spark, sf)
    return rounded(a.inner_join(b, lambda x, y: x - y).to_df_observations(), "value", digits=2)


@query(
    "as_of_join",
    f"WITH {SIDES} SELECT b.user_id, b.tick, b.value AS \"left\", v.value AS \"right\" FROM b ASOF LEFT JOIN v ON v.user_id = b.user_id AND b.tick >= v.tick",
)
def as_of_join(spark, sf):
    return buys(spark, sf).left_join(views(spark, sf), right_interp_func=ip.prev()).df.select("user_id", "tick", "value.left", "value.right")


@query(
    "left_join_nearest",
    f"WITH {SIDES}, j AS (SELECT b.user_id, b.tick, b.value AS l, p.tick AS pt, p.value AS pv, x.tick AS xt, x.value AS xv FROM b "
    "ASOF LEFT JOIN v p ON p.user_id = b.user_id AND b.tick >= p.tick ASOF LEFT JOIN v x ON x.user_id = b.user_id AND b.tick <= x.tick) "
    "SELECT user_id, tick, l AS \"left\", CASE WHEN pt IS NOT NULL AND (xt IS NULL OR tick - pt <= xt - tick) THEN pv ELSE xv END AS \"right\" FROM j",
)
def _(spark, sf):
    return buys(spark, sf).left_join(views(spark, sf), right_interp_func=ip.nearest()).df.select("user_id", "tick", "value.left", "value.right")


@query(
    "right_join_next",
    f"WITH {SIDES} SELECT b.user_id, b.tick, v.value AS \"left\", b.value AS \"right\" FROM b ASOF LEFT JOIN v ON v.user_id = b.user_id AND b.tick <= v.tick",
)
def _(spark, sf):
    return views(spark, sf).right_join(buys(spark, sf), left_interp_func=ip.next()).df.select("user_id", "tick", "value.left", "value.right")


@query(
    "full_join_linear",
    f"""WITH {HALVES}, j AS (SELECT l_suppkey, tick, a.value AS l, b.value AS r FROM a FULL JOIN b USING (l_suppkey, tick)),
k AS (SELECT j.l_suppkey, j.tick, l, r, p.tick AS pt, p.value AS pv, x.tick AS xt, x.value AS xv, q.tick AS qt, q.value AS qv, y.tick AS yt, y.value AS yv FROM j
 ASOF LEFT JOIN a p ON p.l_suppkey = j.l_suppkey AND j.tick >= p.tick ASOF LEFT JOIN a x ON x.l_suppkey = j.l_suppkey AND j.tick <= x.tick
 ASOF LEFT JOIN b q ON q.l_suppkey = j.l_suppkey AND j.tick >= q.tick ASOF LEFT JOIN b y ON y.l_suppkey = j.l_suppkey AND j.tick <= y.tick)
SELECT l_suppkey, tick, round(coalesce(l, pv + (xv - pv) / (xt - pt) * (tick - pt)), 6) AS "left", round(coalesce(r, qv + (yv - qv) / (yt - qt) * (tick - qt)), 6) AS "right" FROM k""",
)
def _(spark, sf):
    a, b = _halves(spark, sf)
    out = a.full_join(b, left_interp_func=ip.linear(), right_interp_func=ip.linear())
    return rounded(_unpaired(out), "left", "right")


@query(
    "join_single_series",
    f"WITH {D}, t AS (SELECT tick, round(sum(value), 2) AS total FROM d GROUP BY 1) SELECT l_suppkey, tick, round(value / total, 9) AS value FROM d JOIN t USING (tick)",
)
def _(spark, sf):
    ts = daily(spark, sf)
    total = ts.aggregate_series("round(sum(value), 2)")
    return rounded(ts.inner_join(total, lambda x, y: x / y).to_df_observations(), "value", digits=9)


@query(
    "join_single_as_of",
    "WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS tick, value, event_type FROM events), "
    "s AS (SELECT tick, value FROM e WHERE event_type = 'signup') "
    "SELECT b.user_id, b.tick, b.value AS \"left\", s.value AS \"right\" FROM (SELECT * FROM e WHERE event_type = 'error') b ASOF LEFT JOIN s ON b.tick >= s.tick",
)
def _(spark, sf):
    from ..operators.create import time_series

    signups = time_series(table(spark, sf, "events").where("event_type = 'signup'"), "ts", "value", ord="event_id")
    errors = events(spark, sf, where="event_type = 'error'")
    return errors.left_join(signups, right_interp_func=ip.prev()).df.select("user_id", "tick", "value.left", "value.right")


@query(
    "align",
    f"""WITH {D}, k AS (SELECT DISTINCT tick FROM d WHERE l_suppkey = 3), s AS (SELECT l_suppkey, min(tick) AS a, max(tick) AS z FROM d GROUP BY 1),
w AS (SELECT l_suppkey, tick FROM s JOIN k ON k.tick BETWEEN a AND z)
SELECT w.l_suppkey, w.tick, d.value FROM w ASOF LEFT JOIN d ON d.l_suppkey = w.l_suppkey AND w.tick >= d.tick""",
)
def _(spark, sf):
    return daily(spark, sf).align(ip.prev(), key=3).to_df_observations()


@query(
    "interval_join",
    f"WITH {SIDES} SELECT b.user_id, b.tick, b.value AS \"left\", v.tick AS right_tick, v.value AS \"right\" FROM b JOIN v ON v.user_id = b.user_id AND v.tick BETWEEN b.tick - {6 * HOUR} AND b.tick + {HOUR}",
)
def _(spark, sf):
    out = buys(spark, sf).interval_join(views(spark, sf), 6 * HOUR, HOUR)
    return out.df.select("user_id", "tick", "value.*")
