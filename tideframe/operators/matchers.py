"""Matchers: does a pattern of strings occur in a string series?

Every matcher yields one row per series: ``matched``, ``match_start`` / ``match_end`` (ticks of the
match) and ``coverage``. Thresholds: PS = |pattern| / |sequence|, PM = |pattern| / |match|,
MS = |match| / |sequence|, where |match| counts the observations from the first to the last matched one.
None of them packs a series: positions and small state tables are enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..handle import TS
from ..plans import join_on


@dataclass(frozen=True)
class Matcher:
    """``kind``: seq, sublist, subseq or subset."""

    kind: str
    threshold: float = 0.0
    matcher_threshold: str = "PS"

    def matches(self, ts: TS, pattern: Sequence[str]) -> DataFrame:
        return match(ts, pattern, self)


def seq() -> Matcher:
    """The whole series equals the pattern, in order."""
    return Matcher("seq")


def sublist(threshold: float = 0.0) -> Matcher:
    """The pattern occurs as a contiguous run."""
    return Matcher("sublist", threshold, "PS")


def subseq(threshold: float = 0.0, matcher_threshold: str = "PS") -> Matcher:
    """The pattern occurs in order, gaps allowed (earliest match)."""
    return Matcher("subseq", threshold, matcher_threshold)


def subset(threshold: float = 0.0, matcher_threshold: str = "PS") -> Matcher:
    """All items of the pattern occur, in any order (first occurrences)."""
    return Matcher("subset", threshold, matcher_threshold)


def _position(cond: Column, pick=F.min) -> Column:
    return pick(F.when(cond, F.struct("_rn", "tick")))


def match(ts: TS, pattern: Sequence[str], matcher: Matcher) -> DataFrame:
    pattern = list(pattern)
    if not pattern:
        raise ValueError("empty pattern")
    rows = ts.row_index("_rn")
    n = F.count(F.lit(1)).alias("_n")
    p = len(pattern)
    v = F.col("value")
    if matcher.kind == "seq":
        items = F.array(*[F.lit(x) for x in pattern])
        same = F.coalesce(v == F.try_element_at(items, (F.col("_rn") + 1).cast("int")), F.lit(False))
        out = rows.groupBy(*ts.keys).agg(n, F.every(same).alias("_all"), _position(F.lit(True)).alias("_s"), _position(F.lit(True), F.max).alias("_e"))
        hit = F.col("_all") & (F.col("_n") == p)
    elif matcher.kind == "sublist":
        cond = lambda w: [v == pattern[0]] + [F.lead("value", k).over(w) == pattern[k] for k in range(1, p)]

        def cols(w):
            ok = F.lit(True)
            for c in cond(w):
                ok = ok & F.coalesce(c, F.lit(False))
            end = F.lead(F.struct("_rn", "tick"), p - 1).over(w) if p > 1 else F.struct("_rn", "tick")
            return {"_ok": ok, "_end": end}

        rows = ts.frame(cols, after=p - 1, df=rows)
        out = rows.groupBy(*ts.keys).agg(
            n, _position(F.col("_ok")).alias("_s"), F.min_by("_end", F.when(F.col("_ok"), F.col("_rn"))).alias("_e")
        )
        hit = F.col("_s").isNotNull()
    elif matcher.kind == "subseq":
        out = earliest(rows, ts.keys, [v == x for x in pattern], ts.max_rows())
        hit = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    elif matcher.kind == "subset":
        firsts = [_position(v == x).alias(f"_f{i}") for i, x in enumerate(dict.fromkeys(pattern))]
        out = rows.groupBy(*ts.keys).agg(n, *firsts)
        cols_ = [F.col(f"_f{i}") for i in range(len(firsts))]
        whole = F.lit(True)
        for c in cols_:
            whole = whole & c.isNotNull()
        pick = lambda f: f(*cols_) if len(cols_) > 1 else cols_[0]
        out = out.select(*ts.keys, "_n", F.when(whole, pick(F.least)).alias("_s"), F.when(whole, pick(F.greatest)).alias("_e"))
        hit = F.col("_s").isNotNull()
        p = len(firsts)
    else:
        raise ValueError(matcher.kind)
    span = (F.col("_e._rn") - F.col("_s._rn") + 1).cast("double")
    ratio = {"PS": F.lit(float(p)) / F.col("_n"), "PM": F.lit(float(p)) / span, "MS": span / F.col("_n")}[matcher.matcher_threshold]
    matched = F.coalesce(hit & (ratio >= matcher.threshold), F.lit(False))
    return out.select(
        *ts.keys,
        matched.alias("matched"),
        F.when(matched, F.col("_s.tick")).alias("match_start"),
        F.when(matched, F.col("_e.tick")).alias("match_end"),
        F.when(matched, ratio).alias("coverage"),
    )


_CHUNK = 4_096


def earliest(rows: DataFrame, keys, conds: list[Column], longest: int) -> DataFrame:
    """Earliest in-order match of ``conds`` per key: ``_n``, ``_s``, ``_e`` (structs of _rn, tick), ``_at`` (all matched ones).

    Each stretch of rows is boiled down to a small table "items matched before -> items matched after"
    and the tables are chained along the series, so stretches are worked on side by side.
    """
    n_items = len(conds)
    hits = F.array(*[F.coalesce(c, F.lit(False)) for c in conds])
    spot = F.struct("_rn", "tick", hits.alias("ok"))
    useful = F.lit(False)
    for c in conds:
        useful = useful | F.coalesce(c, F.lit(False))
    per = rows.groupBy(*keys, F.floor(F.col("_rn") / _CHUNK).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.array_sort(F.collect_list(F.when(useful, spot))).alias("_a")
    )
    at = "array<struct<_rn:bigint,tick:bigint>>"

    def advance(start):
        # state: matched positions so far in this stretch; the next wanted item is start + size
        return F.aggregate(
            "_a",
            F.array().cast(at),
            lambda got, s: F.when(
                F.coalesce(F.try_element_at(s["ok"], (F.size(got) + start + 1).cast("int")), F.lit(False)),
                F.concat(got, F.array(F.struct(s["_rn"].alias("_rn"), s["tick"].alias("tick")))),
            ).otherwise(got),
        )

    def chain(start):
        return F.aggregate(
            "_ts",
            F.array().cast(at),
            lambda got, b: F.concat(got, F.coalesce(F.try_element_at(b["_t"], (F.size(got) + start + 1).cast("int")), F.array().cast(at))),
        )

    table = per.select(*keys, "_b", "_c", F.array(*[advance(F.lit(k)) for k in range(n_items)]).alias("_t"))
    stretches = longest // _CHUNK + 1
    while True:
        # Stretches are joined in groups until one per series is left.
        table = (
            table.groupBy(*keys, F.floor(F.col("_b") / _CHUNK).alias("_g"))
            .agg(F.sum("_c").alias("_c"), F.array_sort(F.collect_list(F.struct("_b", "_t"))).alias("_ts"))
            .select(*keys, F.col("_g").alias("_b"), "_c", F.array(*[chain(F.lit(k)) for k in range(n_items)]).alias("_t"))
        )
        stretches = stretches // _CHUNK + 1
        if stretches <= 1:
            break
    chained = table.withColumnRenamed("_c", "_n")
    got = F.col("_t")[0]
    out = chained.select(*keys, "_n", got.alias("_got"))
    done = F.size("_got") == n_items
    return out.select(
        *keys, "_n",
        F.when(done, F.try_element_at("_got", F.lit(1))).alias("_s"),
        F.when(done, F.try_element_at("_got", F.lit(n_items))).alias("_e"),
        F.when(done, F.col("_got")).alias("_at"),
    )


def itemset_matches(ts: TS, itemset: Sequence[str]) -> DataFrame:
    """Observations that realise an item set: the first occurrence of each item, where all occur.

    Rows (keys, item, tick) of the matching series.
    """
    items = list(dict.fromkeys(itemset))
    hits = ts.df.where(F.col("value").isin(items)).groupBy(*ts.keys, F.col("value").alias("item")).agg(F.min("tick").alias("tick"))
    whole = hits.groupBy(*ts.keys).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == len(items)).select(*ts.keys)
    return join_on(hits, whole, ts.keys, "left_semi").select(*ts.keys, "item", "tick")


def sequence_matches(ts: TS, itemset_sequence: Sequence[Sequence[str]]) -> DataFrame:
    """Does an ordered sequence of item sets occur, each as one array value (a superset), in order?

    The series' value is an array of items (or one string). Row per key: ``matched``, ``ticks``.
    """
    rows = ts.row_index("_rn")
    is_array = ts.df.schema["value"].dataType.typeName() == "array"
    conds = []
    for items in itemset_sequence:
        wanted = F.array(*[F.lit(i) for i in items])
        have = F.col("value") if is_array else F.array("value")
        conds.append(F.size(F.array_except(wanted, have)) == 0)
    out = earliest(rows, ts.keys, conds, ts.max_rows())
    return out.select(*ts.keys, F.col("_at").isNotNull().alias("matched"), F.transform("_at", lambda s: s["tick"]).alias("ticks"))
