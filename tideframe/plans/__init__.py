from .durable import saved, shared_folder
from .ordered import CHUNK_ROWS, add_chunk, fold, frame, is_bounded, join_on, longest, row_index, running, small

__all__ = ["CHUNK_ROWS", "add_chunk", "fold", "frame", "is_bounded", "join_on", "longest", "row_index", "running", "saved", "shared_folder", "small"]
