"""Fourier transforms and what is read off them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..handle import TS
from ..plans import is_bounded, join_on, row_index, saved, small


def _ddl(df, cols):
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def transform(df: DataFrame, group, by, rows: int) -> DataFrame:
    """Rows (group, k, re, im) of the mean-free transform, k = 0..n/2.

    A series that fits a task is transformed there. A longer one goes through the two-step
    factorisation n = n1 * n2 (transforms of length n1 on strided rows, a twist, transforms of length
    n2), each step a shuffle into groups of about sqrt(n) rows.
    """
    group = list(group)
    clean = df.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    if is_bounded(clean, group, rows):
        return _whole(clean, group, by)
    sums = saved(clean.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean")))
    short, long = sums.where(F.col("_n") <= rows), sums.where(F.col("_n") > rows)
    fitting = _whole(join_on(clean, short.select(*group), group, "left_semi"), group, by)
    n_long = long.count()
    x = row_index(join_on(clean, small(long.select(*group), n_long), group, "left_semi"), group, by, "_j", rows, bounded=False)
    x = join_on(x, small(long, n_long), group)
    # Any length n becomes a convolution of power-of-two length m (chirp transform).
    size = F.pow(F.lit(2.0), F.ceil(F.log2((2 * F.col("_n")).cast("double")))).cast("long")
    # j^2 is reduced modulo 2n before it becomes an angle, which keeps the angle exact.
    turn = lambda j: F.lit(np.pi) * F.pmod(j * j, 2 * F.col("_n")) / F.col("_n")
    dev = F.col("value") - F.col("_mean")
    a = x.select(
        *group, "_n", size.alias("_m"), F.col("_j").alias("j"),
        (dev * F.cos(turn(F.col("_j")))).alias("re"), (-dev * F.sin(turn(F.col("_j")))).alias("im"),
    )
    back = F.when(F.col("_j") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.col("_j"), size - F.col("_j")))
    b = x.select(*group, "_n", size.alias("_m"), "_j", F.explode(back).alias("j")).select(
        *group, "_n", "_m", "j", F.cos(turn(F.col("_j"))).alias("re"), F.sin(turn(F.col("_j"))).alias("im")
    )
    fa, fb = _power_of_two(a, group), _power_of_two(b, group)
    on = [*group, "_n", "_m", "j"]
    fb = fb.withColumnsRenamed({"re": "re2", "im": "im2"})
    prod = join_on(fa, fb, on).select(
        *on, (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"),
        (-(F.col("re") * F.col("im2") + F.col("im") * F.col("re2"))).alias("im"),
    )
    conv = _power_of_two(prod, group).where(F.col("j") <= F.floor(F.col("_n") / 2))
    re, im = F.col("re") / F.col("_m"), -F.col("im") / F.col("_m")
    c, s = F.cos(turn(F.col("j"))), F.sin(turn(F.col("j")))
    big = conv.select(*group, F.col("j").alias("k"), (re * c + im * s).alias("re"), (im * c - re * s).alias("im"))
    return fitting.unionByName(big)


def _whole(clean: DataFrame, group, by) -> DataFrame:
    """Transform of series that each fit a task, packed into arrays."""
    item = F.struct(*by, *([] if "value" in by else ["value"]))
    packed = clean.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_o"))
    packed = packed.withColumn("_o", F.transform("_o", lambda s: s["value"]))

    @F.pandas_udf("array<struct<re:double,im:double>>")
    def whole(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            v = np.asarray(v, float)
            z = np.fft.rfft(v - v.mean())
            out.append([{"re": a, "im": b} for a, b in zip(z.real.tolist(), z.imag.tolist())])
        return pd.Series(out)

    bins = packed.select(*group, F.posexplode(whole("_o")).alias("k", "z"))
    return bins.select(*group, F.col("k").cast("long").alias("k"), "z.re", "z.im")


def _power_of_two(df: DataFrame, group) -> DataFrame:
    """Transform rows (group, _n, _m, j, re, im) of length ``_m`` (a power of two); absent rows are 0."""
    ids = [*group, "_n", "_m"]
    schema = f"{_ddl(df, ids)}, _k1 long, _j2 long, re double, im double"
    bits = F.log2(F.col("_m").cast("double"))
    n2 = F.pow(F.lit(2.0), F.floor((bits + 0.5) / 2)).cast("long")
    strided = df.withColumn("_j2", F.col("j") % n2).withColumn("_j1", F.floor(F.col("j") / n2)).withColumn("_n2", n2)

    def columns(pdf):
        m, n2_, j2 = int(pdf["_m"].iat[0]), int(pdf["_n2"].iat[0]), int(pdf["_j2"].iat[0])
        z = np.zeros(m // n2_, complex)
        z[pdf["_j1"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        k1 = np.arange(len(z))
        z = np.fft.fft(z) * np.exp(-2j * np.pi * ((j2 * k1) % m) / m)
        out = pd.DataFrame({"_k1": k1, "_j2": j2, "re": z.real, "im": z.imag})
        for c in ids:
            out[c] = pdf[c].iat[0]
        return out

    step = strided.groupBy(*ids, "_j2").applyInPandas(columns, schema)

    def rows_(pdf):
        m, k1 = int(pdf["_m"].iat[0]), int(pdf["_k1"].iat[0])
        n2_ = 2 ** int((np.log2(m) + 0.5) // 2)
        z = np.zeros(n2_, complex)
        z[pdf["_j2"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        z = np.fft.fft(z)
        out = pd.DataFrame({"j": k1 + (m // n2_) * np.arange(n2_), "re": z.real, "im": z.imag})
        for c in ids:
            out[c] = pdf[c].iat[0]
        return out

    return step.groupBy(*ids, "_k1").applyInPandas(rows_, f"{_ddl(df, ids)}, j long, re double, im double")


def periodogram(ts: TS) -> DataFrame:
    """Power per frequency: rows (keys, k, n, season, power), season = round(n / k), k >= 1."""
    z = transform(ts.df, ts.keys, ts.by, ts.chunk_rows)
    n = ts.df.where(F.col("value").isNotNull()).groupBy(*ts.keys).agg(F.count(F.lit(1)).alias("n"))
    z = join_on(z.where("k >= 1"), n, ts.keys)
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return z.select(*ts.keys, "k", "n", F.round(F.col("n") / F.col("k")).cast("long").alias("season"), power.alias("power"))


def season_length(ts: TS, max_season_length: int | None = None, sub_season_percent_delta: float = 0.0) -> DataFrame:
    """Strongest season per key, -1 when there is none (fewer than two full seasons of data).

    Among seasons within ``sub_season_percent_delta`` of the strongest power the longest wins.
    """
    p = periodogram(ts).where("k >= 2")
    if max_season_length is not None:
        p = p.where(F.col("season") <= max_season_length)
    best = p.groupBy(*ts.keys).agg(F.max("power").alias("_best"))
    near = join_on(p, best, ts.keys).where(F.col("power") >= F.col("_best") * (1 - sub_season_percent_delta))
    pick = near.groupBy(*ts.keys).agg(F.min_by("season", "k").alias("season_length"))
    out = join_on(ts.df.select(*ts.keys).distinct(), pick, ts.keys, "left")
    return out.withColumn("season_length", F.coalesce("season_length", F.lit(-1).cast("long")))


def multi_season_length(ts: TS, num_seasons: int) -> DataFrame:
    """The ``num_seasons`` strongest resonances per key (maybe fewer): rows (keys, rank, season_length, power)."""
    p = periodogram(ts).where("k >= 2")
    # Two frequencies can round to one season; the stronger one stands for it.
    per = p.groupBy(*ts.keys, "season").agg(F.max("power").alias("power"))
    w = Window.partitionBy(*ts.keys).orderBy(F.desc("power"), "season")
    ranked = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= num_seasons)
    return ranked.select(*ts.keys, "rank", F.col("season").alias("season_length"), "power")
