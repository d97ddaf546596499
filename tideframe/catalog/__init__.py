from . import fill, language, learning, reducers, relational, segments, series, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
