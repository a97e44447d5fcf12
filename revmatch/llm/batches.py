"""Batches of documents and hash ranges of keys: how operators look up what every document has in the whole corpus.

Documents are gathered into batches of bounded size, written once. A batch sends its distinct keys, sorted, in one
small binary per hash range; the range works on all batches' keys and answers each batch in the order of its keys.
Few large rows travel instead of one per key, and a frequent key travels once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext

from revmatch.llm.text import blocks, buffer

#: Bytes of text in a batch, and for each hash range.
BATCH, RANGE = 6 << 20, 8 << 20


def shrink(values: np.ndarray) -> bytes:
    """Numbers as byte planes, zstd-compressed: high bytes that are all alike cost nothing."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def grow(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data) if data else b"", np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(apart, text, ...)`` gathered into compressed batches of about ``BATCH`` bytes of text; rows set apart have batches of their own."""
    task, made = TaskContext.get().partitionId(), 0
    waiting: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    size = {False: 0, True: 0}
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))

    def flush(flag: bool) -> Iterator[pa.RecordBatch]:
        nonlocal made
        if waiting[flag]:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[flag][0].schema, options=options) as out:
                for b in waiting[flag]:
                    out.write_batch(b)
            columns = [pa.array([(task << 32) + made]), pa.array([flag]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.record_batch(columns, names=["batch", "apart", "docs"])
            waiting[flag], size[flag], made = [], 0, made + 1

    for b in batches:
        for flag in (False, True):
            part = b.filter(b.column(0) if flag else pc.invert(b.column(0)))
            if part.num_rows:
                part = part.select(list(range(1, part.num_columns)))
                _, offsets = buffer(part.column(0))
                for i, j in blocks(offsets, BATCH // 4):
                    waiting[flag].append(part.slice(i, j - i))
                    size[flag] += int(offsets[j] - offsets[i])
                    if size[flag] >= BATCH:
                        yield from flush(flag)
    for flag in (False, True):
        yield from flush(flag)


def unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all().combine_chunks()


def range_count(size: int | None) -> int:
    """Hash ranges for so many bytes of text."""
    return max(1, -(-int(size or 0) // RANGE))


def hash_ranges(keys: np.ndarray, count: int) -> np.ndarray:
    """The hash range of each key; rising with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
