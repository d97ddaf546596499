"""Fluent methods: binds the operator functions to the handles."""

from __future__ import annotations

from .handle import Segments, TS
from .operators import create, cross, elements, fill, forecast, joins, pairs, reducers, segments, transforms
from .operators import stats_ops
from .sources import sinks

_SERIES = {
    "to_df": create.to_df,
    "to_df_observations": create.to_df_observations,
    "to_df_instants": create.to_df_instants,
    "map": elements.map_values,
    "map_with_index": elements.map_with_index,
    "flatmap": elements.flatmap,
    "filter": elements.filter_values,
    "filter_series": elements.filter_series,
    "filter_series_key": elements.filter_series_key,
    "map_series": elements.map_series,
    "map_series_with_key": elements.map_series_with_key,
    "fold_series": elements.fold_series,
    "map_series_key": elements.map_series_key,
    "series_keys": elements.keys,
    "get_time_series": elements.get_time_series,
    "time_series": elements.get_time_series,
    "get_values": elements.get_values,
    "collect_series": elements.collect_series,
    "collect": elements.collect_series,
    "count": elements.count,
    "concat": elements.concat,
    "lag": elements.lag,
    "shift": elements.shift,
    "with_trs": elements.with_trs,
    "describe": stats_ops.describe,
    "fillna": fill.fillna,
    "resample": fill.resample,
    "floor": fill.floor,
    "lower": fill.lower,
    "ceiling": fill.ceiling,
    "higher": fill.higher,
    "first": fill.first,
    "last": fill.last,
    "contains": fill.contains,
    "size": fill.size,
    "inner_join": joins.inner_join,
    "full_join": joins.full_join,
    "left_join": joins.left_join,
    "right_join": joins.right_join,
    "left_outer_join": joins.left_outer_join,
    "right_outer_join": joins.right_outer_join,
    "inner_align": joins.inner_align,
    "full_align": joins.full_align,
    "left_align": joins.left_align,
    "right_align": joins.right_align,
    "left_outer_align": joins.left_outer_align,
    "right_outer_align": joins.right_outer_align,
    "align": joins.align,
    "interval_join": joins.interval_join,
    "segment": segments.segment,
    "segment_by_time": segments.segment_by_time,
    "segment_by": segments.segment_by,
    "segment_by_anchor": segments.segment_by_anchor,
    "segment_by_changepoint": segments.segment_by_changepoint,
    "segment_by_marker": segments.segment_by_marker,
    "to_segments": segments.to_segments,
    "reduce_range": reducers.reduce_range,
    "aggregate": cross.aggregate,
    "aggregate_series": cross.aggregate_series,
    "aggregate_series_with_key": cross.aggregate_series_with_key,
    "pair_wise_transform": cross.pair_wise_transform,
    "forecast": forecast.forecast,
    "write": property(sinks.SeriesWriter),
}

_SEGMENTS = {
    "flatten": segments.flatten,
    "map": segments.map_segments,
    "flatmap": segments.flatmap_segments,
    "filter": segments.filter_segments,
    "transform": segments.transform,
}


def _reduce(self: TS, first, second=None):
    """``reduce(reducer)`` or ``reduce(other, reducer)``."""
    return reducers.reduce(self, first) if second is None else pairs.reduce2(self, first, second)


def _transform(self: TS, first, *args, **kwargs):
    """``transform(step, ...)`` or ``transform(other, expr)``."""
    if isinstance(first, TS):
        return transforms.transform2(self, first, *args)
    return first(self, *args, **kwargs)


for _name, _fn in _SERIES.items():
    setattr(TS, _name, _fn)
for _name, _fn in _SEGMENTS.items():
    setattr(Segments, _name, _fn)
TS.reduce = _reduce
TS.transform = _transform
