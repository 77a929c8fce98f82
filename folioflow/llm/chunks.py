"""Documents in chunks, in which repeated items are numbered, so that each is looked up once and put back in its places.

A chunk is one row: its distinct items, which of them stands at each place, and its members (the documents).  Items are
exploded, joined with what stands for them, and come back to the chunk, whose members are then made anew by place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

#: Bytes of a chunk; a document is never cut, so a longer one is a chunk of its own.
CHUNK = 4_000_000
#: What a document counts for beside its bytes.
ROW = 32


def chunks(batches, column: str, most: int | None = None) -> Iterator[tuple[int, object]]:
    """Number and record batch of the chunks of a task; ``column`` (text, bytes or list of 4-byte integers) gives the sizes.

    Numbers are unique among the tasks of a stage.  A repeated task makes the same chunks if its rows come in the same order.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    most = most or CHUNK
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        values = batch.column(column)
        lengths = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW)
        at, done = 0, 0
        while at < batch.num_rows:
            stop = min(batch.num_rows, int(np.searchsorted(ends, most - size + done)) + 1)
            held.append(batch.slice(at, stop - at))
            size, at, done = size + int(ends[stop - 1]) - done, stop, int(ends[stop - 1])
            if size >= most:
                yield number, _one(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, _one(held)


def _one(held):
    import pyarrow as pa

    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def chunk_schema(keep: StructType, item: str) -> StructType:
    """``chunk``, ``items``, ``places`` and ``members`` (the kept columns in ``kept``, their number of places in ``size``)."""
    members = ArrayType(StructType([StructField("kept", keep), StructField("size", _parse_datatype_string("int"))]))
    head = _parse_datatype_string(f"chunk bigint, items array<{item}>, places binary").fields
    return StructType([*head, StructField("members", members)])


def chunk_row(number: int, items, sequence: np.ndarray, kept: list, names: list[str], sizes):
    """The row of a chunk: ``items`` (an Arrow array), the number of the item at each place, and the members.

    Items go by their frequency, so that the common ones have short numbers.
    """
    import pyarrow as pa

    order = np.argsort(-np.bincount(sequence, minlength=len(items)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    members = pa.StructArray.from_arrays([pa.StructArray.from_arrays(kept, names=names), pa.array(sizes, pa.int32())], names=["kept", "size"])
    columns = [pa.array([number], pa.int64()), one_list(items.take(pa.array(order))), pa.array([packed(rank[sequence])], pa.binary()), one_list(members)]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "items", "places", "members"])


def one_list(values):
    """All ``values`` as the one list of a row."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def packed(sequence: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, their bytes by significance, compressed."""
    return zlib.compress(sequence.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the stretches of ``lengths`` from ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
