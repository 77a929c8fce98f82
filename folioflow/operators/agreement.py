"""How far two versions of a text agree, line by line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NEW = ("lines_a", "lines_b", "common", "agreement")


def common_lines(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence of lines.

    Bit by bit: a zero of ``row`` at place ``j`` says that line ``j`` of ``b`` lengthens the subsequence; each line of ``a`` moves all
    zeros at once, as one sum of long integers.
    """
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    every = row = (1 << len(b)) - 1
    for line in a:
        met = row & places.get(line, 0)
        row = ((row + met) | (row - met)) & every
    return len(b) - row.bit_count()


def line_agreement(versions: DataFrame, a: str, b: str) -> DataFrame:
    """``versions`` without the texts ``a`` and ``b``, with their numbers of lines, how many they have in ``common`` in the same
    order, and ``agreement``: twice that over both numbers, 1 for two texts without lines.

    NULL counts as empty, an empty text has no lines, a last line end makes no further one; columns with the new names are
    replaced.  No shuffle; time grows with the product of the two numbers of lines, by 64 at a time.
    """
    keep = [c for c in versions.columns if c not in (a, b, *_NEW)]
    schema = T.StructType([*versions.select(*keep).schema.fields, *[T.StructField(n, T.LongType()) for n in _NEW[:3]], T.StructField(_NEW[3], T.DoubleType())])

    def lines(text: str | None) -> list[str]:
        whole = (text or "").removesuffix("\n")
        return whole.split("\n") if text else []

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for one, other in zip(batch.column("__a"), batch.column("__b")):
                x, y = lines(one.as_py()), lines(other.as_py())
                shared = common_lines(x, y)
                rows.append((len(x), len(y), shared, 2 * shared / (len(x) + len(y)) if x or y else 1.0))
            columns = list(zip(*rows)) or [()] * 4
            own = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *own], names=[*keep, *_NEW])

    return versions.select(*keep, versions[a].alias("__a"), versions[b].alias("__b")).mapInArrow(run, schema)
