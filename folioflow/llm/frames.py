"""Small helpers for frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """Schema of ``df`` and more fields."""
    return StructType([*df.schema.fields, *[StructField(name, _parse_datatype_string(kind)) for name, kind in kinds.items()]])
