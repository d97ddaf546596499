"""Linear recurrences ``e[i] = x[i] + decay * e[i-1]`` without a sequential pass.

Inside a short block the recurrence is a scaled prefix sum; the blocks' last values follow the same
kind of recurrence with a much smaller decay, and so on until it vanishes or one block is left.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import join_on

_BLOCK = 4096
_SPAN = 120.0  # decades a scaled sum may cover inside one block


def decay_scan(df: DataFrame, keys, rn: str, x: str, decay: float, longest: int, out: str) -> DataFrame:
    """Add ``out``. ``rn`` is the 0-based row index; no series has more than ``longest`` rows."""
    if not 0 <= decay <= 1:
        raise ValueError("decay must lie between 0 and 1")
    if decay == 0:
        return df.withColumn(out, F.col(x))
    block = _BLOCK if decay == 1 else int(min(_BLOCK, max(1.0, _SPAN / -math.log10(decay))))
    if longest <= block:
        return _inside(df, [*keys], F.col(rn), x, decay, out)
    # The names carry the output's, so that the levels do not meet.
    b, tail, end = f"{out}_b", f"{out}_x", f"{out}_in"
    df = df.withColumn(b, F.floor(F.col(rn) / block))
    df = _inside(df, [*keys, b], F.col(rn) % block, x, decay, out)
    tails = df.groupBy(*keys, b).agg(F.max_by(out, rn).alias(tail))
    whole = decay**block
    if whole < 1e-40:
        ends = tails.withColumn(end, F.col(tail))
    else:
        ends = decay_scan(tails, keys, b, tail, whole, -(-longest // block), end)
    into = ends.select(*keys, (F.col(b) + 1).alias(b), end)
    df = join_on(df, into, [*keys, b], "left")
    gain = F.pow(F.lit(float(decay)), F.col(rn) % block + 1)
    return df.withColumn(out, F.col(out) + gain * F.coalesce(end, F.lit(0.0))).drop(b, end)


def _inside(df, group, pos, x, decay, out):
    w = Window.partitionBy(*group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    scale = F.pow(F.lit(float(decay)), pos)
    return df.withColumn(out, F.sum(F.col(x) / scale).over(w) * scale)
