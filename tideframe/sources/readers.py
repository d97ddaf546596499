"""Table readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..handle import TS, as_column


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, **options) -> DataFrame:
    """CSV; the types are inferred (a pass of its own) only when no schema is given."""
    reader = spark.read.options(header=header, **options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """Avro; needs the external Avro package on the session's class path."""
    return spark.read.format("avro").load(path)


def read_hive_table(spark: SparkSession, name: str, location: str | None = None, schema: str | None = None, partitioned_by: str | None = None) -> DataFrame:
    """A table of partitioned Parquet files; with a location it is declared and its partitions are recovered."""
    if location is not None:
        parts = f" PARTITIONED BY ({partitioned_by})" if partitioned_by else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{parts} LOCATION '{location}'")
        if partitioned_by:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower=None, upper=None, partitions: int = 16, **properties) -> DataFrame:
    """Relational table, read in ``partitions`` ranges of ``column`` when one is given."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties)


def read_generated(spark: SparkSession, start: int, end: int, partitions: int | None = None) -> DataFrame:
    """The integers of a range as column ``id``."""
    return spark.range(start, end, 1, partitions) if partitions else spark.range(start, end)


def read_text_map(lines: DataFrame, parse: Column | str, line_col: str = "value") -> DataFrame:
    """Text lines to observations: ``parse`` gives ``struct(tick, value)`` or null, and nulls are dropped.

    Works on a batch (``spark.read.text``) and on a stream (``spark.readStream.text``).
    """
    return lines.select(as_column(parse).alias("o")).where("o IS NOT NULL AND o.tick IS NOT NULL").select("o.*")


def json_project(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """A JSON text column to its fields."""
    return df.select(F.from_json(F.col(column).cast("string"), schema).alias("data")).select("data.*")


def read_kafka_json(spark: SparkSession, servers: str, topic: str, schema: str, **options) -> DataFrame:
    """JSON messages of a topic as a stream; needs the external Kafka package."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    return json_project(stream.load(), schema)


def range_reader(ts: TS, start: int, end: int, inclusive: bool = False) -> TS:
    """Ticks in a range; ``inclusive`` adds the neighbours just outside."""
    from ..operators.elements import get_values

    return get_values(ts, start, end, inclusive)
