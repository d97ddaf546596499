"""Summary of whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..handle import TS
from . import reducers


def describe(ts: TS) -> DataFrame:
    """One summary row per series."""
    return reducers.reduce(ts, reducers.describe())
