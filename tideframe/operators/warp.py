"""Elastic distances: dynamic time warping and edit distance between pairs of series.

The cost table of a pair is cut into tiles. A tile needs two pieces of the series and the last row,
column and corner of its neighbours; all tiles on one anti-diagonal are worked on side by side, so
no task ever sees a whole long series, and short series take a single step. Tiles that lie outside a
band are never built.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..handle import TS
from ..plans import join_on, saved

TILE = 2_048


class Tile(NamedTuple):
    """Two pieces of series, their offsets, the series' lengths and the values before the pieces."""

    x: list
    y: list
    i0: int
    j0: int
    n: int
    m: int
    x_before: object
    y_before: object


def _pieces(ts: TS, pairs: DataFrame, side: str, tile: int) -> DataFrame:
    """Per pair and piece: ``_<side>`` (array of ``tile`` values), ``_p<side>`` (the value before it), sizes."""
    ids = [f"{side}_{k}" for k in ts.keys]
    rows = ts.frame(lambda w: {"_prev": F.lag("value").over(w)}, before=1, df=ts.row_index("_rn"))
    packed = rows.withColumn("_b", F.floor(F.col("_rn") / tile)).groupBy(*ts.keys, "_b").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("i"), F.col("value").alias("v")))).alias("_a"),
        F.min_by("_prev", "_rn").alias("_prev"),
    )
    sizes = ts.df.groupBy(*ts.keys).agg(F.count(F.lit(1)).alias("_n"))
    cut = join_on(packed, sizes, ts.keys).select(
        *[F.col(k).alias(i) for k, i in zip(ts.keys, ids)], F.col("_b").alias(f"_{side}b"),
        F.transform("_a", lambda s: s["v"]).alias(f"_{side}"), F.col("_prev").alias(f"_p{side}"), F.col("_n").alias(f"_n{side}"),
    )
    return join_on(pairs, cut, ids)


def _run(left: TS, right: TS, pairs: DataFrame, kernel, out: str, tile: int, crosses=None) -> DataFrame:
    """Distance per row of ``pairs`` (columns ``left_<key>`` and ``right_<key>``).

    ``kernel(tile, top, side, corner)`` fills a tile and returns its table; ``top`` and ``side`` are the
    two neighbouring rows / columns (the nearest last) or None at the border. ``crosses(i0, i1, j0, j1,
    n, m)`` tells (as a Column) which tiles a path may enter; without such a last tile the distance is
    infinite.
    """
    ids = [*[f"left_{k}" for k in left.keys], *[f"right_{k}" for k in right.keys]]
    pairs = pairs.select(*ids).distinct()
    a, b = _pieces(left, pairs, "left", tile), _pieces(right, pairs, "right", tile)
    ends = a.groupBy(*ids).agg(F.max("_leftb").alias("_la")), b.groupBy(*ids).agg(F.max("_rightb").alias("_lb"))
    last = join_on(*ends, ids)
    span = last.agg(F.max(F.col("_la") + F.col("_lb"))).first()[0]
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in ids)
    single = span is None or span == 0
    if not single:
        a, b, last = saved(a), saved(b), saved(last)
    edge_schema = f"{kinds}, _leftb long, _rightb long, _edge string, _rows array<array<double>>, _end double"

    def work(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                piece = Tile(
                    list(r["_left"]), list(r["_right"]), int(r["_leftb"]) * tile, int(r["_rightb"]) * tile,
                    int(r["_nleft"]), int(r["_nright"]), r["_pleft"], r["_pright"],
                )
                at = lambda c: None if r.get(c) is None else np.array([list(v) for v in r[c]], float)
                t = kernel(piece, at("_top"), at("_side"), at("_corner"))
                key = [r[c] for c in ids]
                here = [*key, r["_leftb"], r["_rightb"]]
                rows.append([*here, "end", None, float(t[-1, -1])])
                if not single:
                    rows.append([*here, "top", t[-2:, :].tolist(), None])
                    rows.append([*here, "side", t[:, -2:].T.tolist(), None])
                    rows.append([*here, "corner", t[-2:, -2:].tolist(), None])
            yield pd.DataFrame(rows, columns=[*ids, "_leftb", "_rightb", "_edge", "_rows", "_end"])

    answer, edges = None, None
    for wave in range((span or 0) + 1):
        # The pieces of a right series are looked up by the left piece they meet on this wave.
        tiles = join_on(a, b.withColumn("_leftb", F.lit(wave) - F.col("_rightb")), [*ids, "_leftb"])
        if crosses is not None:
            i0, j0 = F.col("_leftb") * tile, F.col("_rightb") * tile
            i1, j1 = F.least(i0 + (tile - 1), F.col("_nleft") - 1), F.least(j0 + (tile - 1), F.col("_nright") - 1)
            tiles = tiles.where(crosses(i0, i1, j0, j1, F.col("_nleft"), F.col("_nright")))
        # A tile is little data and much work, so tiles are spread by number, not by size; those of
        # one pair also go to different tasks.
        tiles = tiles.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ids, "_leftb")
        if edges is not None:
            for name, di, dj in (("top", 1, 0), ("side", 0, 1), ("corner", 1, 1)):
                got = edges.where(F.col("_edge") == name).select(
                    *ids, (F.col("_leftb") + di).alias("_leftb"), (F.col("_rightb") + dj).alias("_rightb"), F.col("_rows").alias(f"_{name}")
                )
                tiles = join_on(tiles, got, [*ids, "_leftb", "_rightb"], "left")
        done = tiles.mapInPandas(work, edge_schema)
        if single:
            answer = done.select(*ids, F.col("_end").alias(out))
            break
        done = saved(done)
        ended = join_on(done.where("_edge = 'end'"), last, ids).where("_leftb = _la AND _rightb = _lb").select(*ids, F.col("_end").alias(out))
        answer = ended if answer is None else answer.unionByName(ended)
        fresh = done.where("_edge <> 'end'")
        if edges is not None:
            keep = edges.where((F.col("_leftb") + F.col("_rightb") == wave - 1) & (F.col("_edge") == "corner"))
            fresh = fresh.unionByName(keep)
        edges = fresh
    if crosses is None:
        return answer
    return join_on(last.select(*ids), answer, ids, "left").withColumn(out, F.coalesce(out, F.lit(float("inf"))))


def _neighbours(t: np.ndarray, top, side, corner) -> None:
    """Fill the two border rows and columns in front of a tile from its neighbours' edges."""
    if top is not None:
        t[2 - len(top) : 2, 2:] = top
    if side is not None:
        t[2:, 2 - len(side) : 2] = side.T
    if corner is not None:
        t[2 - corner.shape[0] : 2, 2 - corner.shape[1] : 2] = corner


def _dtw_kernel(cost, allowed):
    def kernel(piece, top, side, corner):
        x, y = np.asarray(piece.x, float), np.asarray(piece.y, float)
        i0, j0 = piece.i0, piece.j0
        c = cost(x[:, None], y[None, :])
        ok = allowed(np.arange(i0, i0 + len(x))[:, None], np.arange(j0, j0 + len(y))[None, :], piece.n, piece.m)
        c = np.where(ok, c, np.inf)
        rows, cols = c.shape
        t = np.full((rows + 2, cols + 2), np.inf)
        _neighbours(t, top, side, corner)
        if i0 == 0 and j0 == 0:
            t[1, 1] = 0.0
        # Cells of one anti-diagonal do not depend on each other.
        for d in range(rows + cols - 1):
            i = np.arange(max(0, d - cols + 1), min(rows, d + 1))
            j = d - i
            best = np.minimum(np.minimum(t[i + 1, j + 2], t[i + 2, j + 1]), t[i + 1, j + 1])
            t[i + 2, j + 2] = c[i, j] + best
        return t[2:, 2:]

    return kernel


def absolute(a, b):
    return np.abs(a - b)


def dtw(left: TS, right: TS, pairs: DataFrame, cost=absolute, tile: int = TILE) -> DataFrame:
    """Dynamic time warping distance of each pair; ``cost(a, b)`` works on arrays."""
    return _run(left, right, pairs, _dtw_kernel(cost, lambda i, j, n, m: np.ones((len(i), j.shape[1]), bool)), "dtw", tile)


def sakoe_chiba_dtw(left: TS, right: TS, pairs: DataFrame, constraint: int, cost=absolute, tile: int = TILE) -> DataFrame:
    """DTW whose path stays within ``constraint`` rows of the diagonal (infinite when it cannot)."""

    def band(i, j, n, m):
        return np.abs(i - j) <= constraint

    def crosses(i0, i1, j0, j1, n, m):
        return (i0 - j1 <= constraint) & (j0 - i1 <= constraint)

    return _run(left, right, pairs, _dtw_kernel(cost, band), "dtw", tile, crosses)


def itakura_parallelogram_dtw(left: TS, right: TS, pairs: DataFrame, center_offset_percentage: float = 0.0, cost=absolute, tile: int = TILE) -> DataFrame:
    """DTW whose path stays inside the parallelogram of slopes 1/2 and 2 between the two corners.

    ``center_offset_percentage`` (of the right length) widens the parallelogram on both sides.
    """
    pad = center_offset_percentage / 100.0 + 1e-9

    def inside(i, j, n, m):
        u, v = i / max(n - 1, 1), j / max(m - 1, 1)
        low = np.maximum(u / 2, 2 * u - 1) - pad
        high = np.minimum(2 * u, (u + 1) / 2) + pad
        return (v >= low) & (v <= high)

    def crosses(i0, i1, j0, j1, n, m):
        # Both borders rise, so a tile is outside when its upper end is below the lowest or its lower end above the highest.
        rows, cols = F.greatest(n - 1, F.lit(1)), F.greatest(m - 1, F.lit(1))
        u0, u1, v0, v1 = i0 / rows, i1 / rows, j0 / cols, j1 / cols
        return (v1 >= F.greatest(u0 / 2, 2 * u0 - 1) - pad) & (v0 <= F.least(2 * u1, (u1 + 1) / 2) + pad)

    return _run(left, right, pairs, _dtw_kernel(cost, inside), "dtw", tile, crosses)


def lower_bounds(left: TS, right: TS, pairs: DataFrame, constraint: int) -> DataFrame:
    """``bound`` per pair, never above its ``sakoe_chiba_dtw`` of absolute differences.

    Every left value meets a right one within ``constraint`` rows, so it costs at least its distance
    to the range (envelope) of those. One join by position, linear in the pairs' rows.
    """
    lids, rids = [f"left_{k}" for k in left.keys], [f"right_{k}" for k in right.keys]
    rows = left.row_index("_rn").select(*[F.col(k).alias(i) for k, i in zip(left.keys, lids)], "_rn", F.col("value").alias("_x"))

    def envelope(w):
        near = w.rowsBetween(-constraint, constraint)
        return {"_low": F.min("value").over(near), "_high": F.max("value").over(near)}

    around = right.frame(envelope, before=constraint, after=constraint, df=right.row_index("_rn"))
    around = around.select(*[F.col(k).alias(i) for k, i in zip(right.keys, rids)], "_rn", "_low", "_high")
    there = right.df.select(*[F.col(k).alias(i) for k, i in zip(right.keys, rids)]).distinct()
    pairs = join_on(pairs.select(*lids, *rids).distinct(), there, rids, "left_semi")
    meet = join_on(join_on(pairs, rows, lids), around, [*rids, "_rn"], "left")
    off = F.greatest(F.col("_x") - F.col("_high"), F.col("_low") - F.col("_x"), F.lit(0.0))
    return meet.groupBy(*lids, *rids).agg(F.sum(F.coalesce(off, F.lit(0.0))).alias("bound"))


def nearest(left: TS, right: TS, pairs: DataFrame, constraint: int, tile: int = TILE) -> DataFrame:
    """The closest right series of every left one among ``pairs``, by ``sakoe_chiba_dtw``; ties to the smaller key.

    The pair of the least bound is worked out first; then only pairs whose bound is not above that
    distance are.
    """
    lids, rids = [f"left_{k}" for k in left.keys], [f"right_{k}" for k in right.keys]
    bounds = saved(lower_bounds(left, right, pairs, constraint))
    first = bounds.groupBy(*lids).agg(F.min_by(F.struct(*rids), F.struct("bound", *rids)).alias("_r")).select(*lids, *[F.col(f"_r.{r}").alias(r) for r in rids])
    tried = saved(sakoe_chiba_dtw(left, right, first, constraint, tile=tile))
    rest = join_on(bounds, tried.select(*lids, F.col("dtw").alias("_best")), lids).where(F.col("bound") <= F.col("_best"))
    rest = join_on(rest, first, [*lids, *rids], "left_anti").select(*lids, *rids)
    every = tried.unionByName(sakoe_chiba_dtw(left, right, rest, constraint, tile=tile).select(*tried.columns))
    best = every.groupBy(*lids).agg(F.min(F.struct("dtw", *rids)).alias("_m"))
    return best.select(*lids, *[F.col(f"_m.{r}").alias(r) for r in rids], F.col("_m.dtw").alias("dtw"))


def damerau_levenshtein(
    left: TS, right: TS, pairs: DataFrame, insert: float = 1.0, delete: float = 1.0, substitute=1.0, transpose: float = 1.0, tile: int = TILE
) -> DataFrame:
    """Edit distance with swaps of neighbours (optimal alignment) between two value sequences.

    ``substitute`` is a number or ``f(a, b)``; equal values cost nothing.
    """

    def prices(x, y, same):
        """Cost of putting y for x, asked once per pair of distinct values."""
        if not callable(substitute):
            return np.where(same, 0.0, substitute)
        xs, xi = _numbered(x)
        ys, yi = _numbered(y)
        table = np.array([[0.0 if a == b else substitute(a, b) for b in ys] for a in xs], float)
        return np.where(same, 0.0, table[xi[:, None], yi[None, :]])

    def kernel(piece, top, side, corner):
        # One value of either side is kept in front, so that swaps across a tile's border are seen.
        x, y = [piece.x_before, *piece.x], [piece.y_before, *piece.y]
        t = np.full((len(x) + 1, len(y) + 1), np.inf)
        if piece.i0 == 0:
            t[1, max(0, 1 - piece.j0) :] = (np.arange(len(y) + 1) + piece.j0 - 1)[max(0, 1 - piece.j0) :] * insert
        if piece.j0 == 0:
            t[max(0, 1 - piece.i0) :, 1] = (np.arange(len(x) + 1) + piece.i0 - 1)[max(0, 1 - piece.i0) :] * delete
        _neighbours(t, top, side, corner)
        code = {}
        a, b = (np.array([code.setdefault(v, len(code)) for v in s]) for s in (x, y))
        same = a[1:, None] == b[None, 1:]
        price = prices(piece.x, piece.y, same)
        swap = ~same & (a[1:, None] == b[None, :-1]) & (a[:-1, None] == b[None, 1:])
        if piece.i0 == 0:
            swap[0] = False
        if piece.j0 == 0:
            swap[:, 0] = False
        rows, cols = same.shape
        # Cells of one anti-diagonal do not depend on each other.
        for d in range(rows + cols - 1):
            i = np.arange(max(0, d - cols + 1), min(rows, d + 1))
            j = d - i
            best = np.minimum(np.minimum(t[i + 1, j + 2] + delete, t[i + 2, j + 1] + insert), t[i + 1, j + 1] + price[i, j])
            t[i + 2, j + 2] = np.where(swap[i, j], np.minimum(best, t[i, j] + transpose), best)
        return t[2:, 2:]

    return _run(left, right, pairs, kernel, "distance", tile)


def _numbered(values: list) -> tuple[list, np.ndarray]:
    """Distinct values, and the number of each value among them."""
    seen: dict = {}
    at = np.array([seen.setdefault(v, len(seen)) for v in values], int)
    return list(seen), at
