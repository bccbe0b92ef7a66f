"""What is wrong with a record: a stable code, the field, and the value found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBLEM = "struct<code: string, field: string, value: string>"


def problem(code: str, field: str | Column | None = None, value: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    name = none if field is None else F.lit(field) if isinstance(field, str) else field
    return F.struct(F.lit(code).alias("code"), name.alias("field"), (none if value is None else value.cast("string")).alias("value"))


def found(checks: list[tuple[Column, Column]]) -> Column:
    """The problems whose condition holds, in the order of the list."""
    if not checks:
        return F.array().cast(f"array<{PROBLEM}>")
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), what) for holds, what in checks]))
