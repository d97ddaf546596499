"""Stream sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..plans import shared_folder


class _Slice(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _PollReader(DataSourceStreamReader):
    def __init__(self, latest, poll, parse, slices):
        self._latest, self._poll, self._parse, self._slices = latest, poll, parse, slices

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        return {"offset": int(self._latest())}

    def partitions(self, start: dict, end: dict):
        a, b = start["offset"], end["offset"]
        step = max(1, -(-(b - a) // self._slices))
        return [_Slice(i, min(i + step, b)) for i in range(a, b, step)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for message in self._poll(partition.start, partition.end):
            row = self._parse(message)
            if row is not None:
                yield row


def polling_source(spark: SparkSession, name: str, schema: str, latest: Callable[[], int], poll: Callable, parse: Callable, slices: int = 4) -> DataFrame:
    """A pull reader as a stream.

    ``latest()`` tells how many messages there are, ``poll(start, end)`` yields those of an offset range
    and must give the same ones when asked again, ``parse(message)`` returns a row or None (dropped).
    """

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def streamReader(self, schema):
            return _PollReader(latest, poll, parse, slices)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


def writer_source(spark: SparkSession, name: str, write_rows: Callable[[Iterator, dict], None]) -> None:
    """Register a write format: ``write_rows(rows, options)`` runs once per task."""

    class Writer(DataSourceWriter):
        def __init__(self, options):
            self.options = dict(options)

        def write(self, iterator):
            write_rows(iterator, self.options)
            return WriterCommitMessage()

    class Sink(DataSource):
        @classmethod
        def name(cls):
            return name

        def writer(self, schema, overwrite):
            return Writer(self.options)

    spark.dataSource.register(Sink)


def _writer(df: DataFrame, checkpoint: str | None, trigger: str | None, mode: str):
    place = checkpoint or f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", place)
    return w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)


def to_parquet(df: DataFrame, path: str, checkpoint: str | None = None, trigger: str | None = None) -> StreamingQuery:
    """Append to Parquet; with a trigger interval it keeps running, without one it takes what is there and ends."""
    return _writer(df, checkpoint, trigger, "append").format("parquet").start(path)


def add_sink(df: DataFrame, dump: Callable[[DataFrame, int], None], checkpoint: str | None = None, trigger: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to ``dump(batch, batch_id)``; a batch may come again under its id after a failure."""
    return _writer(df, checkpoint, trigger, "append").foreachBatch(dump).start()


def run(df: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over everything available and return what it put out, as a table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    query = to_parquet(df, path, checkpoint)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as late so far, from the progress reports at hand."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
