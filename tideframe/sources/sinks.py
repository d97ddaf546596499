"""Writers for series tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..handle import TS
from ..plans import join_on


class SeriesWriter:
    """``ts.write.option(...).csv(path)``: options and encoders collect until a target is named."""

    def __init__(self, ts: TS):
        self._ts, self._options, self._value, self._key = ts, {}, None, None

    def option(self, name: str, value) -> SeriesWriter:
        self._options[name] = value
        return self

    def options(self, **options) -> SeriesWriter:
        self._options.update(options)
        return self

    def encode_value(self, encode: Callable | None = None) -> SeriesWriter:
        """Column -> Column; default: cast to string (JSON for records and arrays)."""
        self._value = encode or _encode
        return self

    def encode_key(self, encode: Callable | None = None) -> SeriesWriter:
        self._key = encode or _encode
        return self

    def frame(self) -> DataFrame:
        df = self._ts.df.select(*self._ts.keys, "tick", "value")
        if self._key:
            df = df.withColumns({k: self._key(F.col(k)) for k in self._ts.keys})
        if self._value:
            nested = df.schema["value"].dataType.typeName() in ("struct", "array", "map")
            df = df.withColumn("value", F.to_json("value") if self._value is _encode and nested else self._value(F.col("value")))
        return df

    def csv(self, path: str, mode: str = "overwrite") -> None:
        """CSV files; records and arrays become JSON text."""
        if self._value is None:
            self.encode_value()
        self.frame().write.mode(mode).options(**{"header": True, **self._options}).csv(path)

    def object_file(self, path: str, buckets: int = 32, mode: str = "overwrite") -> None:
        """Parquet, clustered by hash bucket of the key; readable with ``read_object_file``.

        A bucket is written by as many tasks as its rows call for: about ``chunk_rows`` rows each, so a long
        series is spread over several files by its ticks.
        """
        keys = list(self._ts.keys)
        df = self._ts.df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        parts = df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / self._ts.chunk_rows).alias("_parts"))  # a row per bucket
        out = df.join(F.broadcast(parts) if buckets <= 100_000 else parts, "bucket")
        out = out.repartition("bucket", F.pmod(F.xxhash64("tick", "value"), F.col("_parts"))).drop("_parts")
        out.sortWithinPartitions("bucket", *keys, "tick").write.mode(mode).options(**self._options).partitionBy("bucket").parquet(path)

    def save(self, fmt: str, path: str | None = None, mode: str = "append") -> None:
        """Any registered format, including a Python data source."""
        w = self.frame().write.format(fmt).mode(mode).options(**self._options)
        w.save(path) if path else w.save()


def _encode(c):
    return c.cast("string")


def read_object_file(spark: SparkSession, path: str, keys, ord=()) -> TS:
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    ord = (ord,) if isinstance(ord, str) else tuple(ord)
    return TS(spark.read.parquet(path).drop("bucket"), keys, ord)


def create_table(spark: SparkSession, name: str, schema: str, partitioned_by: str | None = None, location: str | None = None) -> None:
    parts = f" PARTITIONED BY ({partitioned_by})" if partitioned_by else ""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{parts}{place}")


def insert(df: DataFrame, name: str) -> None:
    df.write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def merge_latest(old: DataFrame, new: DataFrame, keys, order=None) -> DataFrame:
    """Upsert as a DataFrame: rows of ``new`` replace rows of ``old`` with the same key, and one row per key of ``new`` comes in.

    ``order``: columns whose largest values mark the latest row; ties, and rows without an order,
    go by all their columns. A hot key's rows are reduced before the shuffle.
    """
    keys, order = list(keys), list(order or ())
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(F.struct(*(order or rest)).alias("_by"), F.struct(*rest).alias("_row"))).alias("_last")) if rest else new.distinct()
    fresh = last.select(*[F.col(f"_last._row.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in new.columns]) if rest else last
    return join_on(old, fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def upsert(spark: SparkSession, name: str, new: DataFrame, keys, order=None) -> None:
    """Upsert into a Parquet table: the merged rows are written beside it and then put in its place."""
    from ..plans import saved

    merged = saved(merge_latest(spark.table(name), new, keys, order))
    merged.write.mode("overwrite").insertInto(name)
