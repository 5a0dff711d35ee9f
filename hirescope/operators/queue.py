"""Which postings are ready to apply to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_BODY = 400


def usable_body(body: Column, partial: Column, flags: Column) -> Column:
    """P25: not a snippet, by field or flag, and long enough to read."""
    snippet = F.coalesce(partial, F.lit(False)) | F.coalesce(
        F.array_contains(flags, "partial-description"), F.lit(False)
    )
    return ~snippet & (F.length(F.coalesce(body, F.lit(""))) >= MIN_BODY)
