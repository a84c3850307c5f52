"""Slices of Arrow batches that hold a bounded amount of text; shared by operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose texts hold about ``size`` bytes each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, before + size, side="right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """A list column of the flat ``values``, ``sizes[i]`` of them in row i."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, place by place: the high places of small numbers are all zero."""
    places = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return len(places).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(places, asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    places = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(places, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)
