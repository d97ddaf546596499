"""Labelled training windows from a data series and a label series."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..handle import TS, as_column
from ..plans import fold
from .joins import within
from .segments import keep_share


def _vectors(data: TS, anchors: DataFrame, left: int, right: int, name: str, flatten: bool) -> DataFrame:
    """Ordered values within ``[tick - left, tick + right]`` of each anchor."""
    keys = list(data.keys)
    packed = data.df.select(*keys, "tick", F.struct(*data.ord, "value").alias("value"))
    base = anchors.select(*keys, "tick", F.lit(None).cast("int").alias("value"))
    lo, hi = (left, right) if left + right >= 0 else (0, 0)
    hits = within(base, packed, keys, lo, hi)
    item = F.struct("right_tick", *[F.col(f"right.{c}").alias(c) for c in (*data.ord, "value")])
    out = hits.groupBy(*keys, "tick").agg(F.array_sort(F.collect_list(item)).alias("_v"))
    vec = F.transform("_v", lambda s: s["value"])
    return out.select(*keys, "tick", (F.flatten(vec) if flatten else vec).alias(name))


def _offsets(rng, left: int, right: int) -> tuple[int, int]:
    """An (offset, offset) range counted from the window's start, as deltas around the anchor."""
    return (left, right) if rng is None else (left - rng[0], rng[1] - left)


def _apart(ts: TS, anchors: DataFrame, width: int) -> DataFrame:
    """Greedy choice of anchors whose windows do not overlap, along each series."""

    def step(pdf, state):
        last = json.loads(state)
        keep = []
        for t in pdf["tick"].tolist():
            ok = last is None or t - last > width
            if ok:
                last = t
            keep.append(ok)
        return pdf[["tick", "label"]][keep], json.dumps(last)

    return fold(anchors, ts.keys, ["tick"], ["tick", "label"], step, "null", "tick long, label int", min(ts.chunk_rows, 100_000))


def prepare(
    data: TS, label: TS, anchor, left_delta: int, right_delta: int, pos_perc: float = 1.0, neg_perc: float = 0.05,
    label_range=None, feature_range=None, with_replacement: bool = False, flatten_vector: bool = False,
) -> DataFrame:
    """Rows (keys, tick, label, feature): a window of ``data`` around each label observation.

    ``anchor`` (over the label's ``value``) tells positives from negatives; of each class a share is
    kept, chosen by hash. Without ``with_replacement`` windows of one series do not overlap (earliest
    first). ``label_range`` makes the label a vector of the label series; ranges count from the window's
    start.
    """
    keys = list(label.keys)
    marks = label.df.groupBy(*keys, "tick").agg(F.max(F.when(as_column(anchor), 1).otherwise(0)).alias("label"))
    share = lambda p: keep_share(p, *keys, "tick") if p < 1.0 else F.lit(True)
    marks = marks.where(F.when(F.col("label") == 1, share(pos_perc)).otherwise(share(neg_perc)))
    if not with_replacement:
        marks = _apart(label, marks, left_delta + right_delta)
    marks = marks.select(*keys, "tick", "label")
    out = marks.join(_vectors(data, marks, *_offsets(feature_range, left_delta, right_delta), "feature", flatten_vector), [*keys, "tick"])
    if label_range is not None:
        out = out.drop("label").join(_vectors(label, marks, *_offsets(label_range, left_delta, right_delta), "label", flatten_vector), [*keys, "tick"])
    return out.select(*keys, "tick", "label", "feature")


def prepare_predictions(
    data: TS, left_delta: int, right_delta: int, label_range=None, feature_range=None, label: TS | None = None, anchor=None, flatten_vector: bool = False
) -> DataFrame:
    """Windows to predict on: around each anchor of the label series (or each data observation); no label column."""
    source = label or data
    marks = source.df if anchor is None else source.df.where(as_column(anchor))
    marks = marks.select(*source.keys, "tick").distinct()
    return _vectors(data, marks, *_offsets(feature_range, left_delta, right_delta), "feature", flatten_vector)


def labeled_points(prepared: DataFrame) -> DataFrame:
    """(label, features) for MLlib: the feature array as a vector."""
    from pyspark.ml.functions import array_to_vector

    return prepared.select(F.col("label").cast("double").alias("label"), array_to_vector(F.col("feature").cast("array<double>")).alias("features"))
