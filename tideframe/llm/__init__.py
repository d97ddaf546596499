"""Operators of a training-data pipeline, with their queries and check SQL."""

from . import collocations, conversations, decontaminate, embeddings, lm, mixing, pieces, quality, secrets, sharding, simhash, training, urls  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
