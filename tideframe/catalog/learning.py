"""Mining, feature vectors, clustering, forecasting."""

from pyspark.sql import functions as F

from ..operators import cluster, features, forecast, mining
from .base import DAY, E, HOUR, events, query, r, rounded, table
from .relational import scratch

# Items: the event type and one of twelve channels. Levels of the check SQL go on where patterns end.
LEVELS = 7
BIG = f"WITH {E}, b AS (SELECT * EXCLUDE event_type, event_type || '-' || (event_id % 12) AS event_type FROM e)"
LEFT = "user_id % 2 = 0"


def item_events(spark, sf, cond="true"):
    return events(spark, sf, "concat(event_type, '-', event_id % 12)", where=cond)


def _sets(support, side="true"):
    """First tick and count per user and item, and level by level the sets that enough users of one side hold."""
    few = f"{support} * (SELECT count(DISTINCT user_id) FILTER ({side}) FROM b)"
    out = [
        "i AS MATERIALIZED (SELECT user_id, event_type AS item, min(tick) AS t, count(*) AS c FROM b GROUP BY 1, 2)", "n AS (SELECT count(DISTINCT user_id) AS n FROM b)",
        "z AS (SELECT user_id, min(tick) AS a, max(tick) AS z FROM b GROUP BY 1)", "m1 AS MATERIALIZED (SELECT user_id, item AS s, item AS l, t AS t0, t AS t1, c FROM i)",
    ]
    for k in range(1, LEVELS + 1):
        out.append(f"g{k} AS MATERIALIZED (SELECT s FROM m{k} WHERE {side} GROUP BY s HAVING count(*) >= {few})")
        out.append(
            f"m{k + 1} AS MATERIALIZED (SELECT x.user_id, x.s || ',' || y.item AS s, y.item AS l, least(x.t0, y.t) AS t0, greatest(x.t1, y.t) AS t1, least(x.c, y.c) AS c "
            f"FROM m{k} x JOIN g{k} ON g{k}.s = x.s JOIN i y ON y.user_id = x.user_id AND y.item > x.l)"
        )
    return ", ".join([*out, "m AS (" + " UNION ALL ".join(f"SELECT m{k}.* FROM m{k} JOIN g{k} USING (s)" for k in range(1, LEVELS + 1)) + ")"])


SETS = _sets(0.5)


@query(
    "frequent_item_sets",
    f"""{BIG}, {SETS} SELECT s AS item_set, count(*) AS coverage, any_value(n) AS original_size, round(count(*) / any_value(n), 9) AS binary_match_norm_frequency,
round(sum(c) / any_value(n), 9) AS multi_match_norm_frequency FROM m, n GROUP BY s HAVING count(*) >= 0.5 * any_value(n)""",
)
def _(spark, sf):
    out = mining.frequent_item_sets(item_events(spark, sf), 0.5)
    out = out.select(F.array_join("item_set", ",").alias("item_set"), "coverage", "original_size", "binary_match_norm_frequency", "multi_match_norm_frequency")
    return rounded(out, "binary_match_norm_frequency", "multi_match_norm_frequency", digits=9)


def _facts(col, suffix):
    return ", ".join(f"CAST(round({f}({col}), 2) AS DOUBLE) AS {n}{suffix}" for n, f in [("average", "avg"), ("max", "max"), ("min", "min"), ("sd", "stddev_samp"), ("sum", "sum")])


@query(
    "duration_statistics",
    f"""{BIG}, {SETS} SELECT s AS item_set, count(*) AS count, {_facts('t1 - t0', '')}, {_facts('t0 - a', '_lead_time')}, {_facts('z - t1', '_end_time')}
FROM m JOIN z USING (user_id), n GROUP BY s HAVING count(*) >= 0.5 * any_value(n)""",
)
def _(spark, sf):
    out = mining.frequent_item_sets(item_events(spark, sf), 0.5)
    names = [f"{n}{s}" for s in ("", "_lead_time", "_end_time") for n in ("average", "max", "min", "sd", "sum")]
    out = out.select(F.array_join("item_set", ",").alias("item_set"), "duration_statistics.count", *[F.col(f"duration_statistics.{n}").cast("double").alias(n) for n in names])
    return rounded(out, *names, digits=2)


@query(
    "item_set_score",
    f"{BIG}, {SETS} SELECT s AS item_set, user_id, t0 AS first, t1 AS last, c AS matches FROM m",
)
def _(spark, sf):
    ts = item_events(spark, sf)
    model = mining.frequent_item_sets(ts, 0.5)
    out = mining.item_set_matches(ts, model).join(model.select("item_set_id", "item_set"), "item_set_id")
    return out.select(F.array_join("item_set", ",").alias("item_set"), "user_id", "first", "last", "matches")


@query(
    "discriminatory_item_sets",
    f"""{BIG}, {_sets(0.5, LEFT)}, l AS (SELECT s, count(*) AS k FROM m WHERE user_id % 2 = 0 GROUP BY 1), q AS (SELECT s, count(*) AS k FROM m WHERE user_id % 2 = 1 GROUP BY 1),
t AS (SELECT count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS nl, count(DISTINCT user_id) FILTER (user_id % 2 = 1) AS nr FROM b)
SELECT l.s AS item_set, l.k AS coverage_left, coalesce(q.k, 0) AS coverage_right, nl AS original_size_left, nr AS original_size_right,
round(l.k / nl, 9) AS binary_match_norm_frequency_left, round(coalesce(q.k, 0) / nr, 9) AS binary_match_norm_frequency_right, round((l.k / nl) / nullif(q.k / nr, 0), 9) AS lift
FROM l LEFT JOIN q USING (s), t WHERE l.k >= 0.5 * nl""",
)
def _(spark, sf):
    out = mining.discriminatory_item_sets(item_events(spark, sf, LEFT), item_events(spark, sf, "user_id % 2 = 1"), 0.5)
    out = out.drop("item_set_id", "duration_statistics").withColumn("item_set", F.array_join("item_set", ","))
    return rounded(out, "binary_match_norm_frequency_left", "binary_match_norm_frequency_right", "lift", digits=9)


def _seqs(support, side="true"):
    """Earliest in-order matches, level by level of the patterns that enough users of one side hold."""
    few = f"{support} * (SELECT count(DISTINCT user_id) FILTER ({side}) FROM b)"
    out = [
        "k AS (SELECT user_id, event_type AS item, tick, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS rn FROM b)",
        "n AS (SELECT count(DISTINCT user_id) AS n FROM b)", "s1 AS (SELECT user_id, item AS s, min(rn) AS pos, [arg_min(tick, rn)] AS ts FROM k GROUP BY 1, 2)",
    ]
    for j in range(1, LEVELS + 1):
        out.append(f"f{j} AS (SELECT s, count(*) AS k FROM s{j} WHERE {side} GROUP BY s HAVING count(*) >= {few})")
        out.append(
            f"s{j + 1} AS (SELECT x.user_id, x.s || ',' || k.item AS s, min(rn) AS pos, list_append(any_value(ts), arg_min(tick, rn)) AS ts "
            f"FROM s{j} x JOIN f{j} ON f{j}.s = x.s JOIN k ON k.user_id = x.user_id AND rn > pos GROUP BY x.user_id, x.s, k.item)"
        )
    levels = range(1, LEVELS + 1)
    out.append("m AS (" + " UNION ALL ".join(f"SELECT s{j}.* FROM s{j} JOIN f{j} USING (s)" for j in levels) + ")")
    return ", ".join([*out, "f AS (" + " UNION ALL ".join(f"SELECT * FROM f{j}" for j in levels) + ")"])


SEQS = _seqs(0.35)


@query(
    "frequent_sub_sequences",
    f"""{BIG}, {SEQS}, g AS (SELECT s, unnest([ts[i + 1] - ts[i] FOR i IN range(1, len(ts))]) AS g FROM m)
SELECT f.s AS sequence, f.k AS coverage, n AS original_size, round(f.k / n, 9) AS binary_match_normalized_frequency,
(SELECT round(avg(g), 2) FROM g WHERE g.s = f.s) AS average, (SELECT max(g) FROM g WHERE g.s = f.s) AS max, (SELECT min(g) FROM g WHERE g.s = f.s) AS min,
(SELECT round(stddev_samp(g), 2) FROM g WHERE g.s = f.s) AS sd FROM f, n""",
)
def _(spark, sf):
    out = mining.frequent_sub_sequences(item_events(spark, sf), 0.35)
    i = "inter_arrival_statistics"
    out = out.select(F.array_join("sequence", ",").alias("sequence"), "coverage", "original_size", "binary_match_normalized_frequency", f"{i}.average", f"{i}.max", f"{i}.min", f"{i}.sd")
    return rounded(rounded(out, "binary_match_normalized_frequency", digits=9), "average", "sd", digits=2)


@query("sub_sequence_score", f"{BIG}, {SEQS} SELECT user_id, m.s AS sequence, array_to_string(ts, ',') AS ticks FROM m WHERE m.s IN (SELECT f.s FROM f)")
def _(spark, sf):
    ts = item_events(spark, sf)
    out = mining.sub_sequence_matches(ts, mining.frequent_sub_sequences(ts, 0.35))
    return out.select("user_id", F.array_join("sequence", ",").alias("sequence"), F.array_join(F.transform("ticks", lambda t: t.cast("string")), ",").alias("ticks"))


@query(
    "discriminatory_sub_sequences",
    f"""{BIG}, {_seqs(0.35, LEFT)}, t AS (SELECT count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS nl, count(DISTINCT user_id) FILTER (user_id % 2 = 1) AS nr FROM b),
c AS (SELECT s, count(*) FILTER (user_id % 2 = 0) AS l, count(*) FILTER (user_id % 2 = 1) AS q FROM m GROUP BY 1)
SELECT s AS sequence, l AS coverage_left, q AS coverage_right, nl AS original_size_left, nr AS original_size_right, round(l / nl, 9) AS binary_match_normalized_frequency_left,
round(q / nr, 9) AS binary_match_normalized_frequency_right, round((l / nl) / nullif(q / nr, 0), 9) AS lift FROM c, t WHERE l >= 0.35 * nl""",
)
def _(spark, sf):
    out = mining.discriminatory_sub_sequences(item_events(spark, sf, LEFT), item_events(spark, sf, "user_id % 2 = 1"), 0.35)
    out = out.drop("sequence_id", "inter_arrival_statistics").withColumn("sequence", F.array_join("sequence", ","))
    return rounded(out, "binary_match_normalized_frequency_left", "binary_match_normalized_frequency_right", "lift", digits=9)


def _labelled(spark, sf):
    data = events(spark, sf)
    return data, events(spark, sf, "event_type", where="event_type IN ('purchase', 'error')")


VEC = f"string_agg(CAST(round(d.value * 100) AS BIGINT), ',' ORDER BY d.tick, d.event_id)"


def _shown(df):
    cents = F.transform("feature", lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return df.withColumn("feature", F.array_join(cents, ","))


@query(
    "feature_vectors",
    f"WITH {E}, a AS (SELECT * FROM e WHERE event_type IN ('purchase', 'error')) SELECT a.user_id, a.tick, CASE WHEN any_value(a.event_type) = 'purchase' THEN 1 ELSE 0 END AS label, {VEC} AS feature FROM a JOIN e d ON d.user_id = a.user_id AND d.tick BETWEEN a.tick - {DAY} AND a.tick + {HOUR} GROUP BY 1, 2",
)
def _(spark, sf):
    data, label = _labelled(spark, sf)
    return _shown(features.prepare(data, label, "value = 'purchase'", DAY, HOUR, 1.0, 1.0, with_replacement=True))


@query(
    "feature_vectors_apart",
    f"""WITH RECURSIVE {E}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick) AS i FROM e WHERE event_type IN ('purchase', 'error')),
w AS (SELECT user_id, i, tick, event_type, tick AS last, true AS keep FROM a WHERE i = 1
 UNION ALL SELECT a.user_id, a.i, a.tick, a.event_type, CASE WHEN a.tick - w.last > {DAY + HOUR} THEN a.tick ELSE w.last END, a.tick - w.last > {DAY + HOUR} FROM w JOIN a ON a.user_id = w.user_id AND a.i = w.i + 1)
SELECT w.user_id, w.tick, CASE WHEN any_value(w.event_type) = 'purchase' THEN 1 ELSE 0 END AS label, {VEC} AS feature FROM w JOIN e d ON d.user_id = w.user_id AND d.tick BETWEEN w.tick - {DAY} AND w.tick WHERE keep GROUP BY 1, 2""",
)
def _(spark, sf):
    data, label = _labelled(spark, sf)
    return _shown(features.prepare(data, label, "value = 'purchase'", DAY, HOUR, 1.0, 1.0, feature_range=(0, DAY)))


@query(
    "feature_vectors_predictions",
    f"WITH {E} SELECT a.user_id, a.tick, {VEC} AS feature FROM e a JOIN e d ON d.user_id = a.user_id AND d.tick BETWEEN a.tick - {DAY} AND a.tick GROUP BY 1, 2",
)
def _(spark, sf):
    return _shown(features.prepare_predictions(events(spark, sf), DAY, 0))


@query(
    "labeled_points",
    f"WITH {E}, a AS (SELECT * FROM e WHERE event_type IN ('purchase', 'error')), g AS (SELECT any_value(a.event_type) = 'purchase' AS p, count(*) AS n FROM a JOIN e d ON d.user_id = a.user_id AND d.tick BETWEEN a.tick - {DAY} AND a.tick + {HOUR} GROUP BY a.user_id, a.tick) "
    "SELECT CAST(p AS INT)::DOUBLE AS label, CAST(n AS INT) AS size FROM g",
)
def _(spark, sf):
    data, label = _labelled(spark, sf)
    prepared = features.prepare(data, label, "value = 'purchase'", DAY, HOUR, 1.0, 1.0, with_replacement=True)
    from pyspark.ml.functions import vector_to_array

    return features.labeled_points(prepared).select("label", F.size(vector_to_array("features")).alias("size"))


def _shapes(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))


@query("kshape_fit")
def _(spark, sf):
    model = cluster.fit(_shapes(spark, sf), 3, 1, keys=["vec_id"])
    return model.table(spark).select("cluster", "size", r("intra_cluster_distance", 4).alias("distance"), r("sum_squares", 3).alias("sum_squares"))


@query("kshape_score")
def _(spark, sf):
    shapes = _shapes(spark, sf)
    model = cluster.fit(shapes, 2, 1, init_strategy="random", keys=["vec_id"])
    return rounded(model.score(shapes, True), "distance", "silhouette", digits=5)


@query("kshape_explore", "SELECT k, k AS clusters, (SELECT count(*) FROM embeddings) AS series FROM (VALUES (2), (3)) t(k)")
def _(spark, sf):
    """The best model of every k; each holds every series once."""
    rows = [(m.centroids.shape[0], len(m.sizes), int(sum(m.sizes.values()))) for m in cluster.explore(_shapes(spark, sf), 1, 3, keys=["vec_id"], max_iterations=5)]
    return spark.createDataFrame(rows, "k int, clusters int, series long")


@query("kshape_save_load", "SELECT count(*) AS series, count(*) AS same FROM embeddings")
def _(spark, sf):
    """A model read back scores every series as before."""
    shapes, path = _shapes(spark, sf), scratch(spark, "kshape")
    model = cluster.fit(shapes, 2, 1, keys=["vec_id"], max_iterations=3)
    model.save(spark, path)
    again = cluster.load_model(spark, path, ["vec_id"])
    both = model.score(shapes).join(again.score(shapes).withColumnsRenamed({"cluster": "c2", "distance": "d2"}), "vec_id")
    return both.agg(F.count("*").alias("series"), F.count_if((F.col("cluster") == F.col("c2")) & (F.abs(F.col("distance") - F.col("d2")) < 1e-9)).alias("same"))


# Forecasting: daily order value per priority, a weekly season.


def order_days(spark, sf):
    from datetime import datetime, timedelta, timezone

    from ..operators.create import multi_time_series

    ts = multi_time_series(table(spark, sf, "orders"), "o_orderdate", "o_orderpriority", "o_totalprice", granularity=timedelta(days=1), start_time=datetime(1970, 1, 1, tzinfo=timezone.utc))
    return ts.with_df(ts.df.groupBy("o_orderpriority", "tick").agg(F.round(F.sum("value"), 2).alias("value")))


def _hws_sql(multiplicative: bool = False, keep: str = "true") -> str:
    """Holt-Winters of the days that ``keep`` lets through: all weight triples, the one of least squared error as ``best``."""
    of, back, shape = ("*", "/", "/") if multiplicative else ("+", "-", "-")
    w = "CASE WHEN a.s[1] = 0 THEN NULL ELSE a.s[1] END" if multiplicative else "a.s[1]"
    return f"""WITH days AS (SELECT o_orderpriority, CAST(epoch_ms(o_orderdate) // 86400000 AS BIGINT) AS tick, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL),
d AS (SELECT days.* FROM days, (SELECT max(tick) - 60 AS cut FROM days) WHERE {keep}),
v AS (SELECT o_orderpriority, list(value ORDER BY tick) AS v, max(tick) AS last, min(tick) AS first, (max(tick) - min(tick)) / (count(*) - 1) AS step FROM d GROUP BY 1),
m AS (SELECT *, list_avg(v[1:7]) AS m1, list_avg(v[8:14]) AS m2 FROM v WHERE len(v) > 14),
b AS (SELECT *, m1 + (m2 - m1) / 7 * 10 AS l0, (m2 - m1) / 7 AS t0, [(v[i] {shape} m1 + v[i + 7] {shape} m2) / 2 FOR i IN range(1, 8)] AS s0 FROM m),
g AS (SELECT x.w AS wa, y.w AS wb, z.w AS wg FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS w) x, (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS w) y, (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS w) z),
z AS (SELECT b.*, CAST(wa AS DOUBLE) AS wa, CAST(wb AS DOUBLE) AS wb, CAST(wg AS DOUBLE) AS wg, list_reduce(list_prepend({{'l': l0, 't': t0, 's': s0, 'e': 0.0::DOUBLE, 'x': 0.0::DOUBLE}},
  [{{'l': 0.0::DOUBLE, 't': 0.0::DOUBLE, 's': []::DOUBLE[], 'e': 0.0::DOUBLE, 'x': x}} FOR x IN v[15:]]), lambda a, c: {{
  'l': wa * (c.x {back} {w}) + (1 - wa) * (a.l + a.t), 't': wb * (wa * (c.x {back} {w}) + (1 - wa) * (a.l + a.t) - a.l) + (1 - wb) * a.t,
  's': list_append(a.s[2:], wg * (c.x {back} (wa * (c.x {back} {w}) + (1 - wa) * (a.l + a.t))) + (1 - wg) * a.s[1]),
  'e': a.e + (c.x - ((a.l + a.t) {of} a.s[1])) ** 2, 'x': c.x}}) AS q FROM b, g),
o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY q.e, wa, wb, wg) AS o FROM z),
best AS (SELECT *, sqrt(q.e / (len(v) - 14)) AS sd, len(v) - 14 AS n FROM o WHERE o = 1)"""


def _hws_forecast_sql(multiplicative: bool, z: float) -> str:
    of = "*" if multiplicative else "+"
    return f"""{_hws_sql(multiplicative)},
h AS (SELECT *, unnest(range(1, 8)) AS step_no FROM best),
f AS (SELECT *, (q.l + step_no * q.t) {of} q.s[step_no] AS f, sd * sqrt(1 + coalesce(list_sum([(wa * (1 + j * wb) + wg * (1 - wa) * CASE WHEN j % 7 = 0 THEN 1 ELSE 0 END) ** 2 FOR j IN range(1, step_no)]), 0)) AS e FROM h)
SELECT o_orderpriority, CAST(last + round_even(step_no * step, 0) AS BIGINT) AS tick, step_no AS step, round(f, 1) AS value, round(f - {z} * e, 1) AS lower, round(f + {z} * e, 1) AS upper, round(e, 1) AS error FROM f"""


@query("forecast_hws", _hws_forecast_sql(False, 1.6448536269514715))
def _(spark, sf):
    out = order_days(spark, sf).forecast(7, "hws", 0.9, samples_per_season=7)
    return rounded(out, "value", "lower", "upper", "error", digits=1)


for _name, _args in [("arma", {}), ("arima", {}), ("auto", {"samples_per_season": 7})]:

    def _run(spark, sf, name=_name, args=_args):
        out = order_days(spark, sf).forecast(7, name, 0.9, **args)
        return rounded(out, "value", "lower", "upper", "error", digits=1)

    query(f"forecast_{_name}")(_run)


@query("forecast_hws_multiplicative", _hws_forecast_sql(True, 1.959963984540054))
def _(spark, sf):
    return rounded(order_days(spark, sf).forecast(7, "hws", samples_per_season=7, multiplicative=True), "value", "lower", "upper", "error", digits=1)


def _exp_sql(keep: str) -> str:
    """Exponential smoothing of the days that ``keep`` lets through (``cut``: 60 days before the end)."""
    return """WITH a AS (SELECT o_orderpriority, CAST(epoch_ms(o_orderdate) // 86400000 AS BIGINT) AS tick, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL),
d AS (SELECT a.* FROM a, (SELECT max(tick) - 60 AS cut FROM a) WHERE """ + keep + """),
k AS (SELECT *, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY tick)),
s AS (SELECT o_orderpriority, list(value ORDER BY rn) AS v, max(tick) AS last, (max(tick) - min(tick)) / (count(*) - 1) AS step FROM k GROUP BY 1),
f AS (SELECT *, list_reduce([{'l': x, 'e': 0.0} FOR x IN v], lambda a, b: {'l': a.l * 0.7 + b.l * 0.3, 'e': a.e + (b.l - a.l) ** 2}) AS z FROM s),
g AS (SELECT *, sqrt(z.e / (len(v) - 1)) AS sd FROM f), h AS (SELECT unnest(range(1, 6)) AS step_no)"""


_EXP = _exp_sql("true")


@query(
    "forecast_exponential",
    f"{_EXP} SELECT o_orderpriority, CAST(last + round_even(step_no * step, 0) AS BIGINT) AS tick, step_no AS step, round(z.l, 2) AS value, round(sd * sqrt(1 + (step_no - 1) * 0.09), 2) AS error FROM g, h",
)
def _(spark, sf):
    out = order_days(spark, sf).forecast(5, "exponential").select("o_orderpriority", "tick", "step", "value", "error")
    return rounded(out, "value", "error", digits=2)


@query(
    "model_facts",
    f"{_EXP} SELECT o_orderpriority, round(z.l, 2) AS level, round(sd, 2) AS sd, len(v) - 1 AS error_history_length, round(step, 9) AS average_interval, last AS last_time, true AS is_initialized FROM g",
)
def _(spark, sf):
    m = forecast.exponential(order_days(spark, sf))
    m = m.select("o_orderpriority", r(F.col("state")[0], 2).alias("level"), r("sd", 2).alias("sd"), "error_history_length", r("average_interval", 9).alias("average_interval"), "last_time", "is_initialized")
    return m


@query(
    "forecast_at",
    f"{_EXP} SELECT o_orderpriority, CAST(last + t AS BIGINT) AS t, round(z.l, 2) AS forecast, round(sd * sqrt(1 + (round_even(t / step, 0) - 1) * 0.09), 2) AS error FROM g, (SELECT unnest([3, 9, 20]) AS t)",
)
def _(spark, sf):
    ts = order_days(spark, sf)
    m = forecast.exponential(ts)
    probes = ts.last().select("o_orderpriority", F.explode(F.array(*[(F.col("tick") + k) for k in (3, 9, 20)])).alias("t"))
    return rounded(forecast.forecast_at(m, ts.keys, probes).select("o_orderpriority", "t", "forecast", "error"), "forecast", "error", digits=2)


@query(
    "anomaly_detector",
    _exp_sql("tick <= cut") + ", q AS (SELECT g.*, a.tick AS t, a.value AS obs FROM g JOIN a USING (o_orderpriority), (SELECT max(tick) - 60 AS cut FROM a) WHERE a.tick > cut), "
    "x AS (SELECT *, round_even((t - last) / step, 0) AS hh FROM q), "
    "b AS (SELECT *, CASE WHEN hh >= 1 THEN z.l END AS f, CASE WHEN hh >= 1 THEN sd * sqrt(1 + (hh - 1) * 0.09) END AS e FROM x) "
    "SELECT o_orderpriority, t, obs AS value, round(f, 2) AS forecast, round(f - 1.6448536269514715 * e, 2) AS lower, round(f + 1.6448536269514715 * e, 2) AS upper, round(e, 2) AS error, abs(obs - f) > 1.6448536269514715 * e AS is_anomaly FROM b",
)
def _(spark, sf):
    ts = order_days(spark, sf)
    cut = ts.df.agg(F.max("tick")).first()[0] - 60
    m = forecast.exponential(ts.filter(F.col("tick") <= cut))
    probes = ts.df.where(F.col("tick") > cut).select("o_orderpriority", F.col("tick").alias("t"), "value")
    return rounded(forecast.is_anomaly(m, ts.keys, probes, 0.9), "forecast", "lower", "upper", "error", digits=2)


@query(
    "update_model",
    _exp_sql("tick <= cut OR o_orderpriority IN ('1-URGENT', '2-HIGH')") + " SELECT o_orderpriority, last AS last_time, round(z.l, 2) AS level FROM g",
)
def _(spark, sf):
    ts = order_days(spark, sf)
    cut = ts.df.agg(F.max("tick")).first()[0] - 60
    m = forecast.exponential(ts.filter(F.col("tick") <= cut))
    # Two of the series have moved on since.
    new = forecast.update_model(m, ts.filter((F.col("tick") <= cut) | F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), forecast.exponential)
    return new.select("o_orderpriority", "last_time", r(F.col("state")[0], 2).alias("level"))


@query(
    "update_model_online",
    _exp_sql("true") + " SELECT o_orderpriority, last AS last_time, round(z.l, 2) AS level, round(sd, 2) AS sd, len(v) - 1 AS error_history_length, round(step, 9) AS average_interval FROM g",
)
def _(spark, sf):
    ts = order_days(spark, sf)
    cut = ts.df.agg(F.max("tick")).first()[0] - 60
    m = forecast.exponential(ts.filter(F.col("tick") <= cut))
    new = forecast.update_model(m, ts.filter(F.col("tick") > cut), forecast.exponential)  # only what is new
    return new.select("o_orderpriority", "last_time", r(F.col("state")[0], 2).alias("level"), r("sd", 2).alias("sd"), "error_history_length", r("average_interval", 9).alias("average_interval"))



_HWS_FACTS = "SELECT o_orderpriority, last AS last_time, round(q.l, 2) AS level, round(q.t, 4) AS trend, round(sd, 2) AS sd, n AS error_history_length, round(step, 9) AS average_interval FROM best"


def _grown(spark, sf, fit):
    """A model of all but the last 60 days, then trained on those alone."""
    ts = order_days(spark, sf)
    cut = ts.df.agg(F.max("tick")).first()[0] - 60
    return forecast.update_model(fit(ts.filter(F.col("tick") <= cut)), ts.filter(F.col("tick") > cut))


@query("update_model_hws", f"{_hws_sql()} {_HWS_FACTS}")
def _(spark, sf):
    m = _grown(spark, sf, lambda t: forecast.hws(t, 7))
    facts = m.select("o_orderpriority", "last_time", F.col("state")[0].alias("level"), F.col("state")[1].alias("trend"), "sd", "error_history_length", "average_interval")
    return rounded(rounded(rounded(facts, "level", "sd", digits=2), "trend", digits=4), "average_interval", digits=9)


for _name, _fit in [("arma", forecast.arma), ("arima", forecast.arima), ("auto", lambda t: forecast.auto(t, 7))]:

    def _twin(spark, sf, fit=_fit):
        """Keys, and those whose model is the one that training on all days at once gives."""
        whole = fit(order_days(spark, sf)).select("o_orderpriority", "kind", "params", "state", "sd", "last_time", "error_history_length")
        more = _grown(spark, sf, fit).select(*[F.col(c).alias(f"_{c}") for c in whole.columns])
        close = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-6 * (F.abs(y) + 1)), lambda x: F.coalesce(x, F.lit(False)))
        same = (F.col("kind") == F.col("_kind")) & (F.col("last_time") == F.col("_last_time")) & (F.col("error_history_length") == F.col("_error_history_length"))
        same = same & close(F.col("_params"), F.col("params")) & close(F.col("_state"), F.col("state")) & (F.abs(F.col("sd") - F.col("_sd")) <= 1e-6 * F.col("sd"))
        both = whole.join(more, F.col("o_orderpriority") == F.col("_o_orderpriority"))
        return both.select("o_orderpriority", same.alias("same"))

    query(f"update_model_{_name}", "SELECT DISTINCT o_orderpriority, true AS same FROM orders")(_twin)


@query(
    "detect_anomalies_model",
    _hws_sql(keep="tick <= cut") + """, p AS (SELECT best.*, r.v AS rv, r.t AS rt FROM best JOIN (SELECT o_orderpriority, list(value ORDER BY tick) AS v, list(tick ORDER BY tick) AS t FROM days, (SELECT max(tick) - 60 AS cut FROM days) WHERE tick > cut GROUP BY 1) r USING (o_orderpriority)),
f AS (SELECT *, list_reduce(list_prepend({'l': q.l, 't': q.t, 's': q.s, 'e': q.e, 'x': 0.0::DOUBLE, 'f': []::DOUBLE[], 'w': []::DOUBLE[]},
  [{'l': 0.0::DOUBLE, 't': 0.0::DOUBLE, 's': []::DOUBLE[], 'e': 0.0::DOUBLE, 'x': x, 'f': []::DOUBLE[], 'w': []::DOUBLE[]} FOR x IN rv]), lambda a, c: {
  'l': wa * (c.x - a.s[1]) + (1 - wa) * (a.l + a.t), 't': wb * (wa * (c.x - a.s[1]) + (1 - wa) * (a.l + a.t) - a.l) + (1 - wb) * a.t,
  's': list_append(a.s[2:], wg * (c.x - (wa * (c.x - a.s[1]) + (1 - wa) * (a.l + a.t))) + (1 - wg) * a.s[1]), 'e': a.e + (c.x - (a.l + a.t + a.s[1])) ** 2, 'x': c.x,
  'f': list_append(a.f, a.l + a.t + a.s[1]), 'w': list_append(a.w, sqrt(a.e / (n + len(a.f))))}) AS k FROM p),
r AS (SELECT o_orderpriority, unnest(rt) AS tick, unnest(rv) AS value, unnest(k.f) AS forecast, unnest(k.w) * 1.2815515655446004 AS w FROM f)
SELECT o_orderpriority, tick, value, round(forecast, 2) AS forecast, round(forecast - w, 2) AS lower, round(forecast + w, 2) AS upper FROM r WHERE value NOT BETWEEN forecast - w AND forecast + w""",
)
def _(spark, sf):
    """Days outside the 80 % bounds of a Holt-Winters model trained before them, which follows them."""
    from ..operators.transforms import detect_anomalies

    ts = order_days(spark, sf)
    cut = ts.df.agg(F.max("tick")).first()[0] - 60
    out = detect_anomalies(ts, forecast.hws(ts.filter(F.col("tick") <= cut), 7), 0.8, info=True)
    return rounded(out.df.select("o_orderpriority", "tick", "value.*"), "forecast", "lower", "upper", digits=2)


@query(
    "model_save_load",
    f"{_EXP}, y AS (SELECT *, sd * sqrt(1 + (step_no - 1) * 0.09) AS e FROM g, h WHERE step_no <= 3) SELECT o_orderpriority, CAST(last + round_even(step_no * step, 0) AS BIGINT) AS tick, step_no AS step, "
    "round(z.l, 2) AS value, round(z.l - 1.959963984540054 * e, 2) AS lower, round(z.l + 1.959963984540054 * e, 2) AS upper, round(e, 2) AS error FROM y",
)
def _(spark, sf):
    path = scratch(spark, "model")
    ts = order_days(spark, sf)
    forecast.save_model(forecast.exponential(ts), path)
    return rounded(forecast.predict(forecast.load_model(spark, path), ts.keys, 3), "value", "lower", "upper", "error", digits=2)


@query("reset_model", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'")
def _(spark, sf):
    ts = order_days(spark, sf)
    gone = ts.series_keys().where("o_orderpriority = '5-LOW'")
    return forecast.reset_model(forecast.exponential(ts), gone).select("o_orderpriority")
