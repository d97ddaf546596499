"""Reducers, pair reducers, transformers."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import pairs, reducers, spectrum, transforms, warp
from .base import D, E, daily, events, query, r, rounded, table
from .segments import W

for _name, _agg in [
    ("average", "avg(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"),
    ("standard_deviation", "stddev_samp(value)"), ("kurtosis", "kurtosis_pop(value)"),
    ("skewness", "(avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / pow(avg(value ** 2) - avg(value) ** 2, 1.5)"),
]:

    def _run(spark, sf, name=_name):
        return rounded(events(spark, sf).reduce(getattr(reducers, name)()), name)

    query(f"reduce_{_name}", f"WITH {E} SELECT user_id, round({_agg}, 6) AS {_name} FROM e GROUP BY 1")(_run)


@query("reduce_percentile", f"WITH {E} SELECT user_id, round(quantile_cont(value, 0.9), 6) AS percentile FROM e GROUP BY 1")
def _(spark, sf):
    return rounded(events(spark, sf).reduce(reducers.percentile(0.9)), "percentile")


@query("reduce_range", f"WITH {E} SELECT user_id, round(avg(value), 9) AS average FROM e WHERE tick BETWEEN 1704499200000 AND 1705104000000 GROUP BY 1")
def _(spark, sf):
    return rounded(events(spark, sf).reduce_range(reducers.average(), 1704499200000, 1705104000000), "average", digits=9)


@query("count_by_value", f"WITH {E} SELECT user_id, event_type AS value, count(*) AS count FROM e GROUP BY 1, 2")
def _(spark, sf):
    return events(spark, sf, "event_type").reduce(reducers.count_by_value())


@query(
    "histogram",
    f"WITH {E} SELECT user_id, CAST(least(9, floor(value / 20)) AS INT) AS bin, count(*) AS count, least(9, floor(value / 20)) * 20.0 AS bin_start FROM e WHERE value BETWEEN 0 AND 200 GROUP BY ALL",
)
def _(spark, sf):
    return events(spark, sf).reduce(reducers.histogram(0.0, 200.0, 10))


@query(
    "histogram_normalized",
    f"WITH {E}, h AS (SELECT user_id, CAST(least(4, floor(value / 40)) AS INT) AS bin, count(*) AS c FROM e WHERE value BETWEEN 0 AND 200 GROUP BY ALL) "
    "SELECT user_id, bin, CAST(bin * 40.0 AS DOUBLE) AS bin_start, round(c / sum(c) OVER (PARTITION BY user_id), 9) AS count FROM h",
)
def _(spark, sf):
    return rounded(events(spark, sf).reduce(reducers.histogram(0.0, 200.0, 5, True)), "count", digits=9)


@query(
    "entropy",
    f"WITH {E}, c AS (SELECT user_id, event_type, count(*) AS c FROM e GROUP BY ALL), p AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1",
)
def _(spark, sf):
    return rounded(events(spark, sf, "event_type").reduce(reducers.entropy()), "entropy")


CENTRED = f"c AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS d, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e {W})"


@query(
    "auto_correlation",
    f"WITH {E}, {CENTRED}, l AS (SELECT user_id, d, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM c {W}) "
    "SELECT user_id, round(sum(d * d1) / sum(d * d), 6) AS lag1, round(sum(d * d2) / sum(d * d), 6) AS lag2 FROM l GROUP BY 1",
)
def _(spark, sf):
    out = events(spark, sf).reduce(reducers.auto_correlation(2))
    return out.select("user_id", r(F.col("auto_correlation")[0]).alias("lag1"), r(F.col("auto_correlation")[1]).alias("lag2"))


@query(
    "fft",
    f"""WITH {E}, {CENTRED}, k AS (SELECT user_id, unnest(range(0, n // 2 + 1)) AS k, n FROM (SELECT DISTINCT user_id, n FROM c))
SELECT c.user_id, k.k, round(sum(d * cos(2 * pi() * ((k.k * rn) % k.n) / k.n)), 5) + 0.0 AS re, round(-sum(d * sin(2 * pi() * ((k.k * rn) % k.n) / k.n)), 5) + 0.0 AS im
FROM c JOIN k USING (user_id) WHERE k.k > 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    out = events(spark, sf).reduce(reducers.fft()).where("k > 0")
    return out.select("user_id", "k", (r("re", 5) + 0.0).alias("re"), (r("im", 5) + 0.0).alias("im"))


POWER = f"""{E}, {CENTRED}, k AS (SELECT user_id, unnest(range(2, n // 2 + 1)) AS k, n FROM (SELECT DISTINCT user_id, n FROM c)),
z AS (SELECT c.user_id, k.k, any_value(k.n) AS n, sum(d * cos(2 * pi() * ((k.k * rn) % k.n) / k.n)) AS re, sum(d * sin(2 * pi() * ((k.k * rn) % k.n) / k.n)) AS im FROM c JOIN k USING (user_id) GROUP BY 1, 2),
p AS (SELECT user_id, k, CAST(round(n / k) AS BIGINT) AS season, re * re + im * im AS power FROM z)"""


@query("season_selector", f"WITH {POWER} SELECT user_id, arg_max(season, power) AS season_length FROM p GROUP BY 1")
def _(spark, sf):
    return spectrum.season_length(events(spark, sf))


@query(
    "multi_season_length",
    f"WITH {POWER}, s AS (SELECT user_id, season AS season_length, max(power) AS power FROM p GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY power DESC) AS rank FROM s) SELECT user_id, CAST(rank AS INT) AS rank, season_length, round(power, 6) AS power FROM rk WHERE rank <= 3",
)
def _(spark, sf):
    return rounded(spectrum.multi_season_length(events(spark, sf), 3), "power")


@query(
    "adf",
    f"""WITH {E}, m AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS v FROM e),
l AS (SELECT user_id, v - lag(v) OVER w AS d0, lag(v) OVER w AS x, lag(v) OVER w - lag(v, 2) OVER w AS d1 FROM m {W}),
f AS (SELECT * FROM l WHERE d1 IS NOT NULL),
g AS (SELECT user_id, regr_slope(d0, d1) AS a1, regr_intercept(d0, d1) AS a0, regr_slope(x, d1) AS b1, regr_intercept(x, d1) AS b0, count(*) AS n FROM f GROUP BY 1),
q AS (SELECT user_id, n, d0 - a0 - a1 * d1 AS y, x - b0 - b1 * d1 AS x FROM f JOIN g USING (user_id)),
s AS (SELECT user_id, any_value(n) AS n, sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, sum(y * y) - sum(x * y) ** 2 / sum(x * x) AS sse FROM q GROUP BY 1)
SELECT user_id, round(b / sqrt(sse / (n - 3) / xx), 5) AS statistic FROM s""",
)
def _(spark, sf):
    return rounded(events(spark, sf).reduce(reducers.adf(1)), "statistic", digits=5).select("user_id", "statistic")


@query("adf_decision")
def _(spark, sf):
    return rounded(events(spark, sf).reduce(reducers.adf(2, 0.01)), "statistic", "critical_value")


LB = "sum(d * d1) / sum(d * d) AS r1, sum(d * d2) / sum(d * d) AS r2"


@query(
    "ljung_box_reduce",
    f"WITH {E}, {CENTRED}, l AS (SELECT user_id, d, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM c {W}), s AS (SELECT user_id, count(*) AS n, {LB} FROM l GROUP BY 1), "
    "q AS (SELECT user_id, n * (n + 2.0) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)) AS q FROM s) SELECT user_id, round(q, 6) AS q, round(exp(-q / 2), 6) AS p_value FROM q",
)
def _(spark, sf):
    return rounded(events(spark, sf).reduce(reducers.ljung_box(2)), "q", "p_value")


@query(
    "ljung_box",
    f"""WITH {E}, k AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM e {W}),
s AS (SELECT *, rn // 20 AS seg FROM k WHERE rn // 20 < c // 20), m AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id, seg) AS d FROM s),
l AS (SELECT *, lag(d) OVER (PARTITION BY user_id, seg ORDER BY rn) AS d1, lag(d, 2) OVER (PARTITION BY user_id, seg ORDER BY rn) AS d2 FROM m),
g AS (SELECT user_id, seg, min(tick) AS tick, sum(d * d1) / sum(d * d) AS r1, sum(d * d2) / sum(d * d) AS r2 FROM l GROUP BY 1, 2),
q AS (SELECT user_id, tick, 440.0 * (r1 * r1 / 19 + r2 * r2 / 18) AS q FROM g) SELECT user_id, tick, round(q, 6) AS q, round(exp(-q / 2), 6) AS p_value FROM q""",
)
def _(spark, sf):
    out = transforms.ljung_box(events(spark, sf), 2, 20).df.select("user_id", "tick", "value.*")
    return rounded(out, "q", "p_value")


# Two series: price per day of neighbouring suppliers would rarely meet; a series and a function of it do.
TWO = f"{D}, t AS (SELECT tick, round(sum(value), 2) AS total FROM d GROUP BY 1), j AS (SELECT l_suppkey, tick, value AS x, total AS y FROM d JOIN t USING (tick))"


def two(spark, sf):
    """Sales of each supplier, and everyone's sales on the same days."""
    ts = daily(spark, sf)
    total = ts.aggregate_series("round(sum(value), 2)")
    return ts, ts.inner_join(total, lambda x, y: y)


@query("correlation", f"WITH {TWO} SELECT l_suppkey, round(corr(x, y), 6) AS correlation FROM j GROUP BY 1")
def _(spark, sf):
    a, b = two(spark, sf)
    return rounded(a.reduce(b, pairs.correlation()), "correlation")


@query("manhattan", f"WITH {TWO} SELECT l_suppkey, round(sum(abs(x - y)), 2) AS manhattan FROM j GROUP BY 1")
def _(spark, sf):
    a, b = two(spark, sf)
    return rounded(a.reduce(b, pairs.manhattan()), "manhattan", digits=2)


@query("reduce_two_series", f"WITH {TWO} SELECT l_suppkey, round(max(y - x), 2) AS gap FROM j GROUP BY 1")
def _(spark, sf):
    a, b = two(spark, sf)
    return rounded(a.reduce(b, pairs.binary_expression("gap", "max(right - left)")), "gap", digits=2)


@query(
    "cross_correlation",
    f"WITH {TWO}, k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY tick) AS i FROM j), g AS (SELECT CAST(unnest(range(-3, 4)) AS INT) AS lag) "
    "SELECT a.l_suppkey, g.lag, round(corr(a.x, b.y), 6) AS correlation FROM g, k a JOIN k b ON b.l_suppkey = a.l_suppkey WHERE b.i = a.i + g.lag GROUP BY 1, 2",
)
def _(spark, sf):
    a, b = two(spark, sf)
    return rounded(a.reduce(b, pairs.cross_correlation(3)), "correlation")


KERNEL = [0.25, 0.5, 0.25]


@query(
    "convolve",
    f"WITH {E}, k AS (SELECT user_id, value, row_number() OVER w - 1 AS i FROM e {W}), b AS (SELECT unnest(range(0, 3)) AS j, unnest({KERNEL}) AS c) "
    "SELECT user_id, CAST(i + j AS BIGINT) AS i, round(sum(value * c), 6) AS value FROM k, b GROUP BY 1, 2",
)
def _(spark, sf):
    ts = events(spark, sf)
    kernel = ts.series_keys().select("user_id", F.posexplode(F.array(*[F.lit(c) for c in KERNEL])).alias("tick", "value"))
    from ..handle import TS

    return rounded(ts.reduce(TS(kernel.withColumn("tick", F.col("tick").cast("long")), ("user_id",)), pairs.convolve()), "value")


@query(
    "sbd",
    f"""WITH {E}, v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY tick) - 1 AS i FROM e WHERE event_type = 'view'),
b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY tick) - 1 AS i FROM e WHERE event_type = 'purchase'),
c AS (SELECT v.user_id, v.i - b.i AS s, sum(v.value * b.value) AS c FROM v JOIN b USING (user_id) GROUP BY 1, 2),
nv AS (SELECT user_id, sqrt(sum(value * value)) AS n FROM v GROUP BY 1), nb AS (SELECT user_id, sqrt(sum(value * value)) AS n FROM b GROUP BY 1)
SELECT user_id, round(1 - max(c) / any_value(nv.n * nb.n), 6) AS sbd FROM c JOIN nv USING (user_id) JOIN nb USING (user_id) GROUP BY 1""",
)
def _(spark, sf):
    a = events(spark, sf, where="event_type = 'view'")
    b = events(spark, sf, where="event_type = 'purchase'")
    return rounded(a.reduce(b, pairs.sbd()), "sbd")


@query(
    "mutual_information",
    f"""WITH {TWO}, m AS (SELECT *, min(x) OVER p AS x0, max(x) OVER p AS x1, min(y) OVER p AS y0, max(y) OVER p AS y1 FROM j WINDOW p AS (PARTITION BY l_suppkey)),
b AS (SELECT l_suppkey, least(3, floor((x - x0) / (x1 - x0) * 4)) AS bx, least(3, floor((y - y0) / (y1 - y0) * 4)) AS by_ FROM m),
c AS (SELECT l_suppkey, bx, by_, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT l_suppkey, c / sum(c) OVER (PARTITION BY l_suppkey) AS pxy, sum(c) OVER (PARTITION BY l_suppkey, bx) / sum(c) OVER (PARTITION BY l_suppkey) AS px, sum(c) OVER (PARTITION BY l_suppkey, by_) / sum(c) OVER (PARTITION BY l_suppkey) AS py FROM c)
SELECT l_suppkey, round(sum(pxy * ln(pxy / (px * py))), 6) AS mutual_information FROM p GROUP BY 1""",
)
def _(spark, sf):
    a, b = two(spark, sf)
    return rounded(a.reduce(b, pairs.mutual_information(4)), "mutual_information")


DIST = f"""{E}, h AS (SELECT user_id, tick, value AS x, value * value - 40 * (event_id % 7) AS y FROM e), n AS (SELECT user_id, count(*) AS n FROM h GROUP BY 1),
p AS (SELECT a.user_id, a.tick AS i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM h a JOIN h b USING (user_id)),
r AS (SELECT user_id, i, sum(dx) AS rx, sum(dy) AS ry, sum(dx * dy) AS xy, sum(dx * dx) AS xx, sum(dy * dy) AS yy FROM p GROUP BY 1, 2),
v AS (SELECT user_id, sum(xy) / any_value(n * n) + sum(rx) * sum(ry) / any_value(n ** 4) - 2 * sum(rx * ry) / any_value(n ** 3) AS xy,
 sum(xx) / any_value(n * n) + sum(rx) * sum(rx) / any_value(n ** 4) - 2 * sum(rx * rx) / any_value(n ** 3) AS xx,
 sum(yy) / any_value(n * n) + sum(ry) * sum(ry) / any_value(n ** 4) - 2 * sum(ry * ry) / any_value(n ** 3) AS yy FROM r JOIN n USING (user_id) GROUP BY 1)"""


def _dist(spark, sf):
    ts = events(spark, sf)
    return ts, ts.map("value * value - 40 * (event_id % 7)")


for _name, _sql in [("covariance", "sqrt(xy)"), ("variance", "sqrt(xx)"), ("correlation", "sqrt(xy / sqrt(xx * yy))")]:

    def _run(spark, sf, name=_name):
        a, b = _dist(spark, sf)
        return rounded(a.reduce(b, getattr(pairs, f"distance_{name}")()), f"distance_{name}", digits=4)

    query(f"distance_{_name}", f"WITH {DIST} SELECT user_id, round({_sql}, 4) AS distance_{_name} FROM v")(_run)


@query(
    "granger_one_lag",
    f"""WITH {TWO}, l AS (SELECT l_suppkey, y, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM j WINDOW w AS (PARTITION BY l_suppkey ORDER BY tick)),
f AS (SELECT * FROM l WHERE y1 IS NOT NULL),
g AS (SELECT l_suppkey, regr_slope(y, y1) AS a1, regr_intercept(y, y1) AS a0, regr_slope(x1, y1) AS b1, regr_intercept(x1, y1) AS b0, count(*) AS n FROM f GROUP BY 1),
q AS (SELECT l_suppkey, n, y - a0 - a1 * y1 AS u, x1 - b0 - b1 * y1 AS v FROM f JOIN g USING (l_suppkey)),
s AS (SELECT l_suppkey, any_value(n) AS n, sum(u * u) AS short, sum(u * u) - sum(u * v) ** 2 / sum(v * v) AS long FROM q GROUP BY 1)
SELECT l_suppkey, round((short - long) / (long / (n - 3)), 5) AS f_statistic FROM s""",
)
def _(spark, sf):
    a, b = two(spark, sf)
    return rounded(a.reduce(b, pairs.granger(1)), "f_statistic", digits=5).select("l_suppkey", "f_statistic")


@query("granger")
def _(spark, sf):
    a, b = two(spark, sf)
    return rounded(a.reduce(b, pairs.granger(2)), "f_statistic", "p_value")


def _neighbours(ts):
    key = ts.keys[0]
    return ts.series_keys().select(F.col(key).alias(f"left_{key}"), (F.col(key) + 1).alias(f"right_{key}"))


def _dtw_sql(ok: str, cost: str = "abs(p.x[t.i + 1] - p.y[j])", on: str = "b.user_id = a.user_id + 1") -> str:
    return f"""WITH RECURSIVE {E}, k AS (SELECT user_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e {W}),
s AS (SELECT user_id, list(value ORDER BY i) AS v FROM k GROUP BY 1),
p AS (SELECT a.user_id AS l, b.user_id AS r, a.v AS x, b.v AS y FROM s a JOIN s b ON {on}),
t AS (SELECT l, r, 0 AS i, [CASE WHEN j = 0 THEN 0.0 ELSE 1e300 END FOR j IN range(0, len(y) + 1)] AS row FROM p
 UNION ALL SELECT t.l, t.r, t.i + 1, list_reduce(list_prepend([1e300], [[least(t.row[j], t.row[j + 1]), CASE WHEN {ok} THEN {cost} ELSE 1e300 END] FOR j IN range(1, len(p.y) + 1)]),
  lambda acc, c: list_append(acc, least(acc[-1], c[1]) + c[2])) FROM t JOIN p USING (l, r) WHERE t.i < len(p.x))
SELECT l AS left_user_id, r AS right_user_id, CASE WHEN row[-1] >= 1e299 THEN CAST('Infinity' AS DOUBLE) ELSE round(row[-1], 6) END AS dtw FROM t JOIN p USING (l, r) WHERE i = len(x)"""


@query("dtw", _dtw_sql("true"))
def _(spark, sf):
    ts = events(spark, sf)
    return rounded(warp.dtw(ts, ts, _neighbours(ts)), "dtw")


@query("sakoe_chiba_dtw", _dtw_sql("abs(t.i - (j - 1)) <= 20"))
def _(spark, sf):
    ts = events(spark, sf)
    return rounded(warp.sakoe_chiba_dtw(ts, ts, _neighbours(ts), 20), "dtw")


@query("dtw_user_cost", _dtw_sql("true", "(p.x[t.i + 1] - p.y[j]) ** 2"))
def _(spark, sf):
    ts = events(spark, sf)
    return rounded(warp.dtw(ts, ts, _neighbours(ts), cost=lambda a, b: (a - b) ** 2), "dtw")


@query(
    "sakoe_chiba_nearest",
    f"WITH d AS ({_dtw_sql('abs(t.i - (j - 1)) <= 20', on='b.user_id BETWEEN a.user_id + 1 AND a.user_id + 3')}) "
    "SELECT left_user_id, min({'d': dtw, 'r': right_user_id}).r AS right_user_id, min(dtw) AS dtw FROM d GROUP BY 1",
)
def _(spark, sf):
    ts = events(spark, sf)
    ahead = F.explode(F.sequence(F.col("user_id") + 1, F.col("user_id") + 3)).alias("right_user_id")
    pairs_ = ts.series_keys().select(F.col("user_id").alias("left_user_id"), ahead)
    return rounded(warp.nearest(ts, ts, pairs_, 20), "dtw")


_U, _V = "(t.i / greatest(len(p.x) - 1, 1))", "((j - 1) / greatest(len(p.y) - 1, 1))"


@query(
    "itakura_parallelogram_dtw",
    _dtw_sql(f"{_V} >= greatest({_U} / 2, 2 * {_U} - 1) - 1e-9 AND {_V} <= least(2 * {_U}, ({_U} + 1) / 2) + 1e-9"),
)
def _(spark, sf):
    ts = events(spark, sf)
    return rounded(warp.itakura_parallelogram_dtw(ts, ts, _neighbours(ts)), "dtw")


_EDIT = f"""WITH RECURSIVE {E}, s AS (SELECT user_id, list(event_type ORDER BY tick, event_id) AS v FROM e GROUP BY 1),
p AS (SELECT a.user_id AS l, b.user_id AS r, a.v AS x, b.v AS y FROM s a JOIN s b ON b.user_id = a.user_id + 1),
t AS (SELECT l, r, 0 AS i, [CAST(j AS DOUBLE) FOR j IN range(0, len(y) + 1)] AS row, [CAST(1e9 AS DOUBLE) FOR j IN range(0, len(y) + 1)] AS old FROM p
 UNION ALL SELECT t.l, t.r, t.i + 1, list_reduce(list_prepend([t.i + 1.0], [[least(t.row[j + 1] + 1, t.row[j] + CASE WHEN p.x[t.i + 1] = p.y[j] THEN 0 ELSE 1 END,
   CASE WHEN t.i > 0 AND j > 1 AND p.x[t.i + 1] <> p.y[j] AND p.x[t.i + 1] = p.y[j - 1] AND p.x[t.i] = p.y[j] THEN t.old[j - 1] + 1 ELSE 1e9 END)] FOR j IN range(1, len(p.y) + 1)]),
  lambda acc, c: list_append(acc, least(acc[-1] + 1, c[1]))), t.row FROM t JOIN p USING (l, r) WHERE t.i < len(p.x))
SELECT l AS left_user_id, r AS right_user_id, row[-1] AS distance FROM t JOIN p USING (l, r) WHERE i = len(x)"""


@query("damerau_levenshtein", _EDIT)
def _(spark, sf):
    ts = events(spark, sf, "event_type")
    return warp.damerau_levenshtein(ts, ts, _neighbours(ts))


_EDIT_COSTS = (
    _EDIT.replace("[CAST(j AS DOUBLE) FOR", "[CAST(j * 1.5 AS DOUBLE) FOR").replace("[t.i + 1.0]", "[CAST((t.i + 1) * 0.75 AS DOUBLE)]").replace("t.row[j + 1] + 1,", "t.row[j + 1] + 0.75,")
    .replace("THEN 0 ELSE 1 END", "THEN 0 ELSE 0.5 + abs(length(p.x[t.i + 1]) - length(p.y[j])) * 0.25 END").replace("t.old[j - 1] + 1 ELSE", "t.old[j - 1] + 0.5 ELSE").replace("acc[-1] + 1,", "acc[-1] + 1.5,")
)


@query("damerau_levenshtein_user_costs", _EDIT_COSTS)
def _(spark, sf):
    ts = events(spark, sf, "event_type")
    return warp.damerau_levenshtein(ts, ts, _neighbours(ts), 1.5, 0.75, lambda a, b: 0.5 + abs(len(a) - len(b)) * 0.25, 0.5)


# Transformers


@query("transform_two_series", f"WITH {TWO} SELECT l_suppkey, tick, round(x / y, 9) AS value FROM j")
def _(spark, sf):
    a, b = two(spark, sf)
    return rounded(a.transform(b, "left / right").to_df_observations(), "value", digits=9)


@query(
    "difference_nanoseconds",
    f"WITH {E}, n AS (SELECT user_id, tick * 1000000 + event_id % 3 AS tick, event_id, value FROM e) SELECT user_id, tick, round(value - p, 6) AS value FROM "
    "(SELECT *, lag(value) OVER w AS p, lag(tick) OVER w AS pt FROM n WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)) WHERE pt IS NOT NULL",
)
def _(spark, sf):
    """Ticks beyond what a double can tell apart, every series cut into chunks."""
    ts = events(spark, sf)
    ts = ts.with_df(ts.df.withColumn("tick", F.col("tick") * 1_000_000 + F.col("event_id") % 3))
    return rounded(transforms.difference(replace(ts, chunk_rows=50)).to_df_observations(), "value")


@query(
    "difference",
    f"WITH {E}, d AS (SELECT user_id, tick, value - lag(value) OVER w AS value FROM e {W}) SELECT user_id, tick, round(value, 6) AS value FROM d WHERE value IS NOT NULL",
)
def _(spark, sf):
    return rounded(events(spark, sf).transform(transforms.difference).to_df_observations(), "value")


@query("z_score", f"WITH {E} SELECT user_id, tick, round((value - avg(value) OVER p) / stddev_samp(value) OVER p, 6) AS value FROM e WINDOW p AS (PARTITION BY user_id)")
def _(spark, sf):
    return rounded(events(spark, sf).transform(transforms.z_score).to_df_observations(), "value")


EMA = f"k AS (SELECT *, row_number() OVER w - 1 AS rn FROM e {W}), m AS (SELECT *, sum(CASE WHEN rn = 0 THEN value ELSE 0.3 * value END / pow(0.7, rn)) OVER w * pow(0.7, rn) AS ema FROM k {W})"


@query("ema", f"WITH {E}, {EMA} SELECT user_id, tick, round(ema, 10) AS value FROM m")
def _(spark, sf):
    return rounded(events(spark, sf).transform(transforms.ema, 0.3).to_df_observations(), "value", digits=10)


@query(
    "paa",
    f"WITH {E}, k AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e {W}) SELECT user_id, min(tick) AS tick, rn * 8 // n AS frame, round(avg(value), 9) AS value FROM k GROUP BY user_id, frame",
)
def _(spark, sf):
    return rounded(events(spark, sf).transform(transforms.paa, 8).df, "value", digits=9)


@query("sax", f"WITH {E} SELECT user_id, tick, chr(CAST(97 + least(5, greatest(0, floor(value / 50))) AS INT)) AS value FROM e")
def _(spark, sf):
    return events(spark, sf).transform(transforms.sax, 0.0, 300.0, 6).to_df_observations()


@query(
    "remove_consecutive_duplicate_values",
    f"WITH {E}, l AS (SELECT *, lag(event_type) OVER w AS p FROM e {W}) SELECT user_id, tick, event_type AS value FROM l WHERE p IS DISTINCT FROM event_type",
)
def _(spark, sf):
    return events(spark, sf, "event_type").transform(transforms.remove_consecutive_duplicate_values).to_df_observations()


@query(
    "combine_duplicate_time_ticks",
    "SELECT l_suppkey, CAST(epoch_ms(l_shipdate) AS BIGINT) AS tick, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY ALL",
)
def _(spark, sf):
    from ..operators.create import multi_time_series

    ts = multi_time_series(table(spark, sf, "lineitem"), "l_shipdate", "l_suppkey", "l_quantity")
    return rounded(ts.transform(transforms.combine_duplicate_time_ticks, "sum(value)").to_df_observations(), "value", digits=4)


@query("awgn")
def _(spark, sf):
    return rounded(events(spark, sf).transform(transforms.awgn, 0.0, 5.0, seed=7).to_df_observations(), "value")


@query("mwgn")
def _(spark, sf):
    return rounded(events(spark, sf).transform(transforms.mwgn, 1.0, 0.1, seed=7).to_df_observations(), "value")


def _decompose_sql(op, inv):
    return f"""WITH {E}, k AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e {W}),
t AS (SELECT *, CASE WHEN rn >= 3 AND rn < n - 3 THEN (sum(value) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + 0.5 * (lag(value, 3) OVER w + lead(value, 3) OVER w)) / 6 END AS trend FROM k {W}),
d AS (SELECT *, value {op} trend AS dev FROM t), p AS (SELECT user_id, rn % 6 AS ph, avg(dev) AS s FROM d GROUP BY 1, 2),
q AS (SELECT user_id, ph, s {op} avg(s) OVER (PARTITION BY user_id) AS seasonal FROM p)
SELECT d.user_id, tick, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(value {op} (trend {inv} seasonal), 9) AS residual FROM d JOIN q ON q.user_id = d.user_id AND q.ph = d.rn % 6"""


@query("decompose", _decompose_sql("-", "+"))
def _(spark, sf):
    out = events(spark, sf).transform(transforms.decompose, 6).df.select("user_id", "tick", "value.*")
    return rounded(out, "trend", "seasonal", "residual", digits=9)


@query("decompose_multiplicative", _decompose_sql("/", "*"))
def _(spark, sf):
    out = events(spark, sf).transform(transforms.decompose, 6, multiplicative=True).df.select("user_id", "tick", "value.*")
    return rounded(out, "trend", "seasonal", "residual", digits=9)


@query(
    "detect_anomalies",
    f"""WITH {E}, {EMA}, f AS (SELECT *, lag(ema) OVER w AS forecast FROM m {W}),
s AS (SELECT *, sum((value - forecast) ** 2) OVER pr AS s, count(forecast) OVER pr AS k FROM f WINDOW pr AS (PARTITION BY user_id ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, 1.959963984540054 * sqrt(s / nullif(k, 0)) AS w FROM s)
SELECT user_id, tick, value, round(forecast, 6) AS forecast, round(forecast - w, 6) AS lower, round(forecast + w, 6) AS upper FROM b WHERE k >= 2 AND abs(value - forecast) > w""",
)
def _(spark, sf):
    out = events(spark, sf).transform(transforms.detect_anomalies, 0.3, 0.95, info=True).df.select("user_id", "tick", "value.*")
    return rounded(out, "forecast", "lower", "upper")
