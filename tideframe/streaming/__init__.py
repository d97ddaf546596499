from .handle import SegmentStream, StreamTS, stream_series, to_observation_stream
from .io import add_sink, late_rows, polling_source, run, to_parquet, writer_source

__all__ = ["SegmentStream", "StreamTS", "add_sink", "late_rows", "polling_source", "run", "stream_series", "to_observation_stream", "to_parquet", "writer_source"]
