"""User functions: one entry per shape. All run on Arrow batches; none sees a whole series unless it says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..handle import Segments, TS, as_column
from ..plans import is_bounded, join_on


def map_values(ts: TS, fn: Callable[[pd.Series], pd.Series], value_type: str) -> TS:
    """value -> value, on batches."""
    return ts.with_value(F.pandas_udf(fn, value_type, F.PandasUDFType.SCALAR)("value"))


def filter_values(ts: TS, fn: Callable[[pd.Series], pd.Series]) -> TS:
    """value -> bool, on batches."""
    return ts.with_df(ts.df.where(F.pandas_udf(fn, "boolean", F.PandasUDFType.SCALAR)("value")))


def flatmap(ts: TS, fn: Callable[[pd.Series], pd.Series], value_type: str) -> TS:
    """value -> list of values, on batches."""
    from ..operators.elements import flatmap as explode

    return explode(ts, F.pandas_udf(fn, f"array<{value_type}>", F.PandasUDFType.SCALAR)("value"))


def combine(ts: TS, columns: Sequence[str], fn: Callable, value_type: str) -> TS:
    """Several columns -> value, on batches (join functions)."""
    return ts.with_value(F.pandas_udf(fn, value_type, F.PandasUDFType.SCALAR)(*columns))


def map_optional(ts: TS, fn: Callable[[pd.Series], pd.Series], value_type: str) -> TS:
    """value -> value or nothing; observations without a result are dropped."""
    out = map_values(ts, fn, value_type)
    return out.with_df(out.df.where(F.col("value").isNotNull() & ~F.isnan("value") if value_type in ("double", "float") else F.col("value").isNotNull()))


def _marked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of ``columns`` as bits of ``_null``, and 0 in their place in whole numbers, which pandas would turn into doubles."""
    bits = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns)]
    whole = {c: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)}
    return df.withColumns(whole | {"_null": reduce(lambda a, b: a.bitwiseOR(b), bits)})


def _unmarked(columns: Sequence[str]) -> list[Column]:
    return [F.when(F.col("_null").bitwiseAND(F.lit(1 << i).cast("long")) == 0, F.col(c)).alias(c) for i, c in enumerate(columns)]


def _runs(pdf: pd.DataFrame, columns: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """Runs of rows that are equal in ``columns``: their key, first row and end."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    values = [pdf[c].to_numpy() for c in columns]
    for v in values:
        new[1:] |= (v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1]))
    starts = np.flatnonzero(new)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)]):
        yield tuple(None if pd.isna(v[a]) else v[a] for v in values), a, b


def fold_values(ts: TS, partial: Callable[[pd.Series], list], combine: Callable[[pd.DataFrame], list], finish: Callable[[list], float], names: Sequence[str], salt: int = 64) -> DataFrame:
    """series -> value as an aggregate with partials.

    ``partial(values)`` boils a batch of one series down to a few doubles (``names``), ``combine`` merges a
    frame of partials into one, ``finish`` turns the last partial into the result. The series follow one
    another in sorted streams, so a task holds a batch and the partials of one series; a series above
    ``chunk_rows`` is dealt to up to ``salt`` slices, and only their partials meet.
    """
    keys, names = list(ts.keys), list(names)
    marks = [*keys, "_null"]
    ddl = ", ".join([*[f"`{k}` {ts.df.schema[k].dataType.simpleString()}" for k in keys], "_null long"])
    fields = ", ".join(f"`{n}` double" for n in names)

    def merged(key, parts):
        frame = pd.DataFrame(np.array(parts, dtype=float).reshape(-1, len(names)), columns=names)
        for i, k in enumerate(keys):
            frame.insert(i, k, [key[i]] * len(frame))
        return combine(frame)

    def stream(group, values: bool, last: bool):
        def row(key, parts):
            out = merged(key, parts)
            return [*key[: len(marks)], *([finish(out)] if last else out)]

        def run(batches):
            key, parts = None, []
            for pdf in batches:
                done = []
                for k, a, b in _runs(pdf, group):
                    if parts and k != key:
                        done.append(row(key, parts))
                        parts = []
                    key = k
                    parts += [partial(pdf["value"].iloc[a:b])] if values else pdf[names].iloc[a:b].to_numpy().tolist()
                    if len(parts) > 1_000:
                        parts = [merged(key, parts)]
                if done:
                    yield pd.DataFrame(done, columns=[*marks, *(["value"] if last else names)], dtype=object)
            if parts:
                yield pd.DataFrame([row(key, parts)], columns=[*marks, *(["value"] if last else names)], dtype=object)

        return run

    if ts.bounded():
        rows = _marked(ts.df.select(*keys, "value"), keys).repartition(*marks).sortWithinPartitions(*marks)
        return rows.mapInPandas(stream(marks, True, True), f"{ddl}, value double").select(*_unmarked(keys), "value")
    sizes = ts.df.groupBy(*keys).agg(F.least(F.lit(salt), F.ceil(F.count(F.lit(1)) / ts.chunk_rows)).alias("_n")).where("_n > 1")
    slices = F.pmod(F.xxhash64(*ts.columns), F.coalesce("_n", F.lit(1).cast("long"))).alias("_slice")
    rows = _marked(join_on(ts.df, sizes, keys, "left").select(*keys, "value", slices), keys)
    rows = rows.repartition(*marks, "_slice").sortWithinPartitions(*marks, "_slice")
    parts = rows.mapInPandas(stream([*marks, "_slice"], True, False), f"{ddl}, {fields}")
    parts = parts.repartition(*marks).sortWithinPartitions(*marks)
    return parts.mapInPandas(stream(marks, False, True), f"{ddl}, value double").select(*_unmarked(keys), "value")


def map_segments(segs: Segments, fn: Callable[[pd.DataFrame], float], value_type: str = "double") -> DataFrame:
    """segment -> value; the function sees one whole segment (ordered), so segments must fit a task.

    Segments follow one another in sorted streams; a task holds a batch and one segment.
    """
    if not is_bounded(segs.df, segs.group, segs.rows()):
        raise ValueError("a segment is longer than chunk_rows")
    group, columns = segs.group, segs.df.columns
    whole = [c for c in columns if c not in group and isinstance(segs.df.schema[c].dataType, T.IntegralType)]
    marked = [*group, *whole]
    marks = [*group, "_group"]
    ddl = ", ".join([*[f"`{k}` {segs.df.schema[k].dataType.simpleString()}" for k in group], "_null long"])

    def result(key, held):
        pdf = (pd.concat(held) if len(held) > 1 else held[0]).reset_index(drop=True)
        gone = pdf["_null"].to_numpy()
        if gone.any():
            for i, c in enumerate(marked):
                null = (gone >> i & 1).astype(bool)
                if null.any() and pd.api.types.is_integer_dtype(pdf[c].dtype):
                    pdf[c] = pdf[c].astype(float).mask(null)
        return [*key, fn(pdf[columns])]

    def run(batches):
        key, held = None, []
        for pdf in batches:
            done = []
            for k, a, b in _runs(pdf, marks):
                if held and k != key:
                    done.append(result(key, held))
                    held = []
                key = k
                held.append(pdf.iloc[a:b])
            if done:
                yield pd.DataFrame(done, columns=[*group, "_null", "value"], dtype=object)
        if held:
            yield pd.DataFrame([result(key, held)], columns=[*group, "_null", "value"], dtype=object)

    rows = _marked(segs.df, marked).withColumn("_group", F.col("_null").bitwiseAND(F.lit((1 << len(group)) - 1).cast("long")))
    last = [x for c in segs.by for x in ([F.col("_null").bitwiseAND(F.lit(1 << marked.index(c)).cast("long")), F.col(c)] if c in marked else [F.col(c).asc_nulls_last()])]
    rows = rows.repartition(*marks).sortWithinPartitions(*marks, *last)
    return rows.mapInPandas(run, f"{ddl}, value {value_type}").select(*_unmarked(group), "value")


def cogroup(left: TS, right: TS, fn: Callable, schema: str) -> DataFrame:
    """two series -> rows: ``fn(key, left_pdf, right_pdf)``; both series must fit a task."""
    if not (left.bounded() and right.bounded()):
        raise ValueError("a series is longer than chunk_rows")
    keys = list(left.keys)
    ddl = ", ".join(f"`{k}` {left.df.schema[k].dataType.simpleString()}" for k in keys)

    by_left, by_right = left.by, right.by

    def run(key, a, b):
        out = fn(key, a.sort_values(by_left), b.sort_values(by_right))
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, *[c for c in out.columns if c not in keys]]]

    return left.df.groupBy(*keys).cogroup(right.df.groupBy(*keys)).applyInPandas(run, f"{ddl}, {schema}")


def map_with_series(ts: TS, summary, fn: Callable, value_type: str) -> TS:
    """(value, summary of its series) -> value: the series enters as an aggregate, not as a list."""
    facts = ts.df.groupBy(*ts.keys).agg(as_column(summary).alias("_s"))
    df = join_on(ts.df, facts, ts.keys).withColumn("value", F.pandas_udf(fn, value_type, F.PandasUDFType.SCALAR)("value", "_s"))
    return ts.with_df(df.drop("_s"))
