"""Time-series analytics and file skipping on Spark DataFrames."""

from . import api as _api  # noqa: F401
from .handle import Segments, TS
from .operators.create import multi_from_dict, multi_time_series, time_series
from .trs import TRS

__all__ = ["Segments", "TRS", "TS", "multi_from_dict", "multi_time_series", "time_series"]
