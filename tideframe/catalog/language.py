"""Expression functions, matchers and the user-function surface."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import udf
from ..operators import matchers
from .base import DAY, E, events, query, r, rounded


def _per_value(spark, sf, columns):
    """One row per event with each expression as a column."""
    df = events(spark, sf).df
    return df.select("user_id", "tick", *[c.alias(n) for n, c in columns.items()])


@query(
    "expressions_arithmetic",
    f"WITH {E} SELECT user_id, tick, value AS id, value + 2 AS add, value - 2 AS sub, value * 2 AS mul, round(value / nullif(floor(value), 0), 9) AS div, abs(value - 100) AS abs, CAST(floor(value) AS BIGINT) % 3 = 0 AS divisible_by FROM e",
)
def _(spark, sf):
    v, whole = ex.id(), F.floor(ex.id())
    return _per_value(spark, sf, {
        "id": v, "add": ex.add(v, 2), "sub": ex.sub(v, 2), "mul": ex.mul(v, 2), "div": r(ex.div(v, whole), 9),
        "abs": ex.abs(ex.sub(v, 100)), "divisible_by": ex.divisible_by(whole, 3),
    })


_MATH = ["sqrt", "exp", "log", "log10", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh"]


@query(
    "expressions_math",
    f"WITH {E} SELECT user_id, tick, " + ", ".join(f"round({'ln' if f == 'log' else f}(value / 500), 6) AS {f}" for f in _MATH) + " FROM e",
)
def _(spark, sf):
    x = ex.div(ex.id(), 500.0)
    return _per_value(spark, sf, {f: r(getattr(ex, f)(x)) for f in _MATH})


@query(
    "expressions_logic",
    f"""WITH {E} SELECT user_id, tick, value = 10 AS eq, value > 50 AS gt, value >= 50 AS gte, value < 50 AS lt, value <= 50 AS lte, NOT value > 50 AS logical_not,
value > 20 AND value < 60 AS logical_and, value < 20 OR value > 60 AS logical_or, CASE WHEN value > 50 THEN 1 END AS if_then, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS if_then_else,
CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS match_case FROM e""",
)
def _(spark, sf):
    ts = events(spark, sf, F.struct("value", "event_type"))
    val, kind = ex.with_attr("value"), ex.with_attr("event_type")
    cols = {
        "eq": ex.eq(val, 10), "gt": ex.gt(val, 50), "gte": ex.gte(val, 50), "lt": ex.lt(val, 50), "lte": ex.lte(val, 50),
        "logical_not": ex.logical_not(ex.gt(val, 50)), "logical_and": ex.logical_and(ex.gt(val, 20), ex.lt(val, 60)),
        "logical_or": ex.logical_or(ex.lt(val, 20), ex.gt(val, 60)), "if_then": ex.if_then(ex.gt(val, 50), 1),
        "if_then_else": ex.if_then_else(ex.gt(val, 50), "hi", "lo"), "match_case": ex.match_case(kind, [("view", 1), ("click", 2)], 0),
    }
    return ts.df.select("user_id", "tick", *[c.alias(n) for n, c in cols.items()])


@query(
    "expressions_text",
    f"WITH {E} SELECT user_id, tick, event_type || '-' || user_id AS concat, contains(event_type, 'i') AS contains, starts_with(event_type, 'p') AS starts_with, ends_with(event_type, 'w') AS ends_with, regexp_full_match(event_type, '[a-s]+') AS matches FROM e",
)
def _(spark, sf):
    df, v = events(spark, sf, "event_type").df, ex.id()
    cols = {
        "concat": ex.concat(v, "-", F.col("user_id")), "contains": ex.contains(v, "i"), "starts_with": ex.starts_with(v, "p"),
        "ends_with": ex.ends_with(v, "w"), "matches": ex.matches(v, "[a-s]+"),
    }
    return df.select("user_id", "tick", *[c.alias(n) for n, c in cols.items()])


@query(
    "expressions_aggregate",
    f"WITH {E}, k AS (SELECT *, CAST((tick - min(tick) OVER (PARTITION BY user_id)) // {7 * DAY} AS BIGINT) AS seg_id FROM e) SELECT user_id, seg_id, round(avg(value), 9) AS avg, count(*) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS stdev, round(var_samp(value), 6) AS var FROM k GROUP BY 1, 2",
)
def _(spark, sf):
    aggs = F.struct(
        r(ex.avg(), 9).alias("avg"), ex.count().alias("count"), r(ex.sum()).alias("sum"), ex.min().alias("min"), ex.max().alias("max"),
        r(ex.stdev()).alias("stdev"), r(ex.var()).alias("var"),
    )
    return events(spark, sf).segment_by_time(7 * DAY).map(aggs).df.select("user_id", "seg_id", "value.*")


# Matchers: the event types of each user against a pattern.
N = "n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1)"
K = "k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) - 1 AS rn FROM e)"
OUT = "user_id, s IS NOT NULL AS matched, s.t AS match_start, z.t AS match_end"


def _match(ts, matcher, pattern):
    return rounded(matcher.matches(ts, pattern), "coverage", digits=9)


@query(
    "matcher_seq",
    f"WITH {E}, f AS (SELECT user_id, event_type, min({{'t': tick, 'i': event_id}}) AS p FROM e GROUP BY ALL), "
    "a AS (SELECT user_id, count(*) AS n, list(event_type ORDER BY p) = ['view', 'purchase', 'signup', 'click', 'error'] AS m, min(p.t) AS t0, max(p.t) AS t1 FROM f GROUP BY 1) "
    "SELECT user_id, m AS matched, CASE WHEN m THEN t0 END AS match_start, CASE WHEN m THEN t1 END AS match_end, CASE WHEN m THEN 5.0 / n END AS coverage FROM a",
)
def _(spark, sf):
    """The order in which each user's event types come up first, over all events."""
    ts = events(spark, sf, "event_type")
    firsts = ts.df.groupBy("user_id", "value").agg(F.min(F.struct("tick", "event_id")).alias("p")).select("user_id", "p.*", "value")
    return _match(ts.with_df(firsts), matchers.seq(), ["view", "purchase", "signup", "click", "error"])


@query(
    "matcher_sublist",
    f"WITH {E}, {N}, {K}, w AS (SELECT *, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(tick, 2) OVER w AS t2 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY rn)), "
    "h AS (SELECT user_id, arg_min({'a': tick, 'z': t2}, rn) AS h FROM w WHERE event_type = 'view' AND b = 'click' AND c = 'purchase' GROUP BY 1) "
    "SELECT user_id, h IS NOT NULL AS matched, h.a AS match_start, h.z AS match_end, CASE WHEN h IS NOT NULL THEN round(3.0 / n, 9) END AS coverage FROM n LEFT JOIN h USING (user_id)",
)
def _(spark, sf):
    return _match(events(spark, sf, "event_type"), matchers.sublist(), ["view", "click", "purchase"])


SUBSEQ = f"""{E}, {N}, {K}, a AS (SELECT user_id, min(rn) AS r1 FROM k WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT user_id, any_value(r1) AS r1, min(rn) AS r2 FROM k JOIN a USING (user_id) WHERE event_type = 'purchase' AND rn > r1 GROUP BY 1),
c AS (SELECT user_id, any_value(r1) AS r1, min(rn) AS r3 FROM k JOIN b USING (user_id) WHERE event_type = 'error' AND rn > r2 GROUP BY 1),
h AS (SELECT c.user_id, r1, r3, x.tick AS t1, y.tick AS t3 FROM c JOIN k x ON x.user_id = c.user_id AND x.rn = r1 JOIN k y ON y.user_id = c.user_id AND y.rn = r3)"""


@query(
    "matcher_subseq",
    f"WITH {SUBSEQ} SELECT n.user_id, r1 IS NOT NULL AS matched, t1 AS match_start, t3 AS match_end, round(3.0 / n, 9) + CASE WHEN r1 IS NULL THEN NULL ELSE 0 END AS coverage FROM n LEFT JOIN h USING (user_id)",
)
def _(spark, sf):
    return _match(events(spark, sf, "event_type"), matchers.subseq(), ["signup", "purchase", "error"])


@query(
    "matcher_subseq_pm",
    f"WITH {SUBSEQ}, g AS (SELECT *, 3.0 / (r3 - r1 + 1) AS c FROM h WHERE 3.0 / (r3 - r1 + 1) >= 0.25) SELECT n.user_id, r1 IS NOT NULL AS matched, t1 AS match_start, t3 AS match_end, round(c, 9) AS coverage FROM n LEFT JOIN g USING (user_id)",
)
def _(spark, sf):
    return _match(events(spark, sf, "event_type"), matchers.subseq(0.25, "PM"), ["signup", "purchase", "error"])


@query(
    "matcher_subset",
    f"""WITH {E}, {N}, {K}, f AS (SELECT user_id, event_type, min(rn) AS r, min(tick) AS t FROM k WHERE event_type IN ('signup', 'error') GROUP BY 1, 2),
h AS (SELECT user_id, min(r) AS r1, max(r) AS r2, min(t) AS t1, max(t) AS t2 FROM f GROUP BY 1 HAVING count(*) = 2)
SELECT n.user_id, coalesce((r2 - r1 + 1) / n >= 0.1, false) AS matched, CASE WHEN (r2 - r1 + 1) / n >= 0.1 THEN t1 END AS match_start, CASE WHEN (r2 - r1 + 1) / n >= 0.1 THEN t2 END AS match_end, CASE WHEN (r2 - r1 + 1) / n >= 0.1 THEN round((r2 - r1 + 1) / n, 9) END AS coverage FROM n LEFT JOIN h USING (user_id)""",
)
def _(spark, sf):
    return _match(events(spark, sf, "event_type"), matchers.subset(0.1, "MS"), ["error", "signup"])


@query(
    "itemset_matcher",
    f"WITH {E}, f AS (SELECT user_id, event_type AS item, min(tick) AS tick FROM e WHERE event_type IN ('signup', 'error') GROUP BY 1, 2) SELECT * FROM f WHERE user_id IN (SELECT user_id FROM f GROUP BY 1 HAVING count(*) = 2)",
)
def _(spark, sf):
    return matchers.itemset_matches(events(spark, sf, "event_type"), ["signup", "error"])


@query(
    "sequence_matcher",
    f"""WITH {E}, d AS (SELECT user_id, tick // {DAY} AS day, list(DISTINCT event_type) AS items FROM e GROUP BY 1, 2),
a AS (SELECT user_id, min(day) AS d1 FROM d WHERE list_has_all(items, ['click', 'view']) GROUP BY 1),
b AS (SELECT user_id, any_value(d1) AS d1, min(day) AS d2 FROM d JOIN a USING (user_id) WHERE day > d1 AND list_contains(items, 'error') GROUP BY 1)
SELECT k.user_id, d2 IS NOT NULL AS matched, CASE WHEN d2 IS NOT NULL THEN d1 || ',' || d2 END AS ticks FROM (SELECT DISTINCT user_id FROM d) k LEFT JOIN b USING (user_id)""",
)
def _(spark, sf):
    ts = events(spark, sf, "event_type")
    per_day = ts.df.groupBy("user_id", F.floor(F.col("tick") / DAY).alias("tick")).agg(F.sort_array(F.collect_set("value")).alias("value"))
    out = matchers.sequence_matches(ts.with_df(per_day, ord=()), [["click", "view"], ["error"]])
    return out.withColumn("ticks", F.array_join(F.transform("ticks", lambda t: t.cast("string")), ","))


# User functions, one entry per shape.


@query("udf_value", f"WITH {E} SELECT user_id, tick, round(value * 1.5, 6) AS value FROM e")
def _(spark, sf):
    return rounded(udf.map_values(events(spark, sf), lambda v: v * 1.5, "double").to_df_observations(), "value")


@query("udf_predicate", f"WITH {E} SELECT user_id, tick, value FROM e WHERE value > 100")
def _(spark, sf):
    return udf.filter_values(events(spark, sf), lambda v: v > 100).to_df_observations()


@query("udf_flat", f"WITH {E} SELECT user_id, tick, round(unnest([value, value / 2]), 6) AS value FROM e")
def _(spark, sf):
    return rounded(udf.flatmap(events(spark, sf), lambda v: v.map(lambda x: [x, x / 2]), "double").to_df_observations(), "value")


@query("udf_binary", f"WITH {E} SELECT user_id, tick, round(value * value + event_id, 4) AS value FROM e")
def _(spark, sf):
    return rounded(udf.combine(events(spark, sf), ["value", "event_id"], lambda a, b: a * a + b, "double").to_df_observations(), "value", digits=4)


@query("udf_aggregate", f"WITH {E} SELECT user_id, round(max(value) - min(value), 6) AS value FROM e GROUP BY 1")
def _(spark, sf):
    out = udf.fold_values(events(spark, sf), lambda v: [v.min(), v.max()], lambda p: [p["lo"].min(), p["hi"].max()], lambda x: x[1] - x[0], ["lo", "hi"])
    return rounded(out, "value")


@query(
    "udf_segment",
    f"WITH {E}, k AS (SELECT *, CAST((tick - min(tick) OVER (PARTITION BY user_id)) // {7 * DAY} AS BIGINT) AS seg_id FROM e) SELECT user_id, seg_id, round(quantile_cont(value, 0.5), 6) AS value FROM k GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(udf.map_segments(events(spark, sf).segment_by_time(7 * DAY), lambda pdf: float(pdf["value"].median())), "value")


@query(
    "udf_two_series",
    f"WITH {E} SELECT user_id, count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'click') AS value FROM e WHERE event_type IN ('view', 'click') GROUP BY 1",
)
def _(spark, sf):
    a, b = (events(spark, sf, where=f"event_type = '{k}'") for k in ("view", "click"))
    return udf.cogroup(a, b, lambda key, x, y: pd.DataFrame({"value": [len(x) - len(y)]}), "value long")


@query("udf_key", f"WITH {E} SELECT event_id % 4 AS key, count(*) AS count FROM e GROUP BY 1")
def _(spark, sf):
    return events(spark, sf).segment_by("event_id % 4").df.groupBy(F.col("seg_id").alias("key")).count()


@query("udf_list", f"WITH {E} SELECT user_id, tick, event_id, round(value + event_id % 10, 6) AS value FROM e")
def _(spark, sf):
    ts = events(spark, sf)
    both = ts.with_value(F.array("value", (F.col("event_id") % 10).cast("double")))
    return rounded(udf.map_values(both, lambda v: v.map(lambda xs: float(sum(xs))), "double").df.select("user_id", "tick", "event_id", "value"), "value")


@query("udf_optional", f"WITH {E} SELECT user_id, tick, round(sqrt(value - 50), 6) AS value FROM e WHERE value >= 50")
def _(spark, sf):
    def root(v):
        return (v - 50).where(v >= 50) ** 0.5

    return rounded(udf.map_optional(events(spark, sf), root, "double").to_df_observations(), "value")


@query("udf_value_and_series", f"WITH {E} SELECT user_id, tick, round(value / sum(value) OVER (PARTITION BY user_id), 9) AS value FROM e")
def _(spark, sf):
    return rounded(udf.map_with_series(events(spark, sf), "sum(value)", lambda v, total: v / total, "double").to_df_observations(), "value", digits=9)
