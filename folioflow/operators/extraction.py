"""Guarded extraction: a caller-supplied function over documents, one failure never failing the rest."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import paths
from folioflow.schemas import IMAGE_TYPE
from folioflow.session import bounded
from folioflow.sources.objects import RowBatcher, read_object, rows_of, spread


class UnsupportedFormat(Exception):
    """Raised by an extractor for a document it cannot take; the document is skipped, not failed."""


class Extracted(NamedTuple):
    md: str
    layout_json: str | None = None
    images: tuple[tuple[str, bytes], ...] = ()


#: ``(content, file name, lang, backend) -> Extracted``
Extractor = Callable[[bytes, str, str | None, str | None], Extracted]

OUTCOME = [
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("md", T.StringType()),
    T.StructField("layout_json", T.StringType()),
    T.StructField("images", T.ArrayType(IMAGE_TYPE)),
    T.StructField("duration_us", T.LongType()),
]


def _run(extractor: Extractor, read: Callable[[], bytes], row: dict, name: str) -> dict:
    began = time.monotonic_ns()
    outcome = {"error": None, "md": None, "layout_json": None, "images": []}
    try:
        got = Extracted(*extractor(read(), name, row.get("lang"), row.get("backend")))
        outcome |= {
            "status": "success",
            "md": got.md,
            "layout_json": got.layout_json,
            "images": [{"name": n, "content": c} for n, c in got.images],
        }
    except UnsupportedFormat as refused:
        outcome |= {"status": "skipped", "error": str(refused)}
    except Exception as problem:
        outcome |= {"status": "failed", "error": str(problem) or type(problem).__name__}
    return outcome | {"duration_us": (time.monotonic_ns() - began) // 1000}


def extract(docs: DataFrame, extractor: Extractor, root: str | None = None, tasks: int | None = None) -> DataFrame:
    """Run ``extractor`` over ``docs(key, …[, content, lang, backend])``; adds the outcome columns.

    With ``root`` the documents are read by key inside the task that extracts them, so ``docs`` is
    a table of keys: filter it first, and only what is left is ever read.  The keys (not the bytes)
    are spread over ``tasks`` tasks, by default as many as their sizes ask for.  Without ``root``
    the ``content`` column is used where it already lies; no bytes are shuffled.

    Unsupported files become ``skipped`` rows without reaching Python.
    """
    bounded(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != "content"]
    schema = T.StructType([*kept, *OUTCOME])
    ok = paths.is_supported("key")
    wanted = docs.where(ok)
    if root is not None:
        wanted = spread(wanted.select("key", *[f.name for f in kept if f.name != "key"]), tasks).select(*[f.name for f in kept])
    wanted = wanted.withColumn("_name", paths.file_name("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = read_object(root) if root is not None else None
        out = RowBatcher(schema)
        for batch in batches:
            for row in rows_of(batch):
                name, content = row.pop("_name"), row.pop("content", None)
                read = (lambda: fetch(row["key"])) if fetch else (lambda: content)
                outcome = _run(extractor, read, row, name)
                size = len(outcome["md"] or "") + len(outcome["layout_json"] or "") + sum(len(i["content"] or b"") for i in outcome["images"])
                yield from out.add({**row, **outcome}, size)
        yield from out.flush()

    reason = F.concat(F.lit("Unsupported format: "), paths.suffix("key"))
    fixed = {"status": F.lit("skipped"), "error": reason, "duration_us": F.lit(0)}
    refused = docs.where(~ok).select(
        *[f.name for f in kept],
        *[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OUTCOME],
    )
    return wanted.mapInArrow(run, schema).unionByName(refused)
