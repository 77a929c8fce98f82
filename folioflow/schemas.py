"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_SCHEMA = T.StructType(
    [T.StructField("key", T.StringType(), False), T.StructField("size", T.LongType(), False)]
)

JOB_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType(), False),
        T.StructField("file_key", T.StringType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("submitted_at", T.TimestampType(), False),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("target_key", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("arabic_bidi_fix", T.StringType()),
        T.StructField("backend", T.StringType()),
    ]
)

IMAGE_TYPE = T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])

# Job states and the fields an update may touch.
STATUSES = ("pending", "running", "success", "failed", "skipped")
UNFINISHED = ("pending", "running")
TERMINAL = ("success", "failed", "skipped")
UPDATABLE = (
    "status",
    "started_at",
    "completed_at",
    "page_count",
    "error",
    "target_key",
    "lang",
    "arabic_bidi_fix",
    "backend",
)
PUBLIC_FIELDS = (
    "job_id",
    "file_key",
    "file_size",
    "status",
    "submitted_at",
    "started_at",
    "completed_at",
    "page_count",
    "error",
)


def align_jobs(df: DataFrame) -> DataFrame:
    """Bring an older or narrower job table to the current 13 columns, absent ones as NULL.

    The two timestamp flavours both pass unchanged, as ``submitted_at`` decides which one applies.
    """
    clock = df.schema["submitted_at"].dataType
    out: list[Column] = []
    for field in JOB_SCHEMA.fields:
        kind = clock if isinstance(field.dataType, T.TimestampType) else field.dataType
        if field.name in df.columns:
            column = F.col(field.name).cast(kind)
        elif field.name == "file_size":
            column = F.lit(0).cast(kind)
        elif field.name == "status":
            column = F.lit("pending")
        else:
            column = F.lit(None).cast(kind)
        out.append(column.alias(field.name))
    return df.select(*out)
