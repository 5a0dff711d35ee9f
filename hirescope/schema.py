"""Table schemas. Reads name their schema, so unknown keys drop out and missing
ones come back null; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINT = "struct<label:string,points:int,reasons:array<string>>"
POSTING = {
    "title": "string", "company": "string", "url": "string", "source": "string",
    "location": "string", "description": "string", "department": "string",
    "external_id": "string", "division": "string", "posted_at": "timestamp",
    "first_seen": "timestamp", "salary_min": "double", "salary_max": "double",
    "remote": "boolean", "partial": "boolean", "also_on": "array<string>", "score": "int",
    "tier": "string", "job_family": "string", "reasons": "array<string>",
    "flags": "array<string>", "points": f"array<{POINT}>",
}
TEXT_FIELDS = ("title", "company", "url", "source", "location", "description", "department",
               "external_id", "division", "tier", "job_family")
SNAPSHOT_DROPPED = ("description", "reasons", "points")


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def struct(fields: dict[str, str]) -> StructType:
    return StructType.fromDDL(ddl(fields))


SNAPSHOT = {k: v for k, v in POSTING.items() if k not in SNAPSHOT_DROPPED} | {"required_years": "int"}
# Dates travel as ISO text in stored documents.
STORED = {k: ("string" if v == "timestamp" else v) for k, v in POSTING.items()}


def conform(df: DataFrame, fields: dict[str, str] = POSTING) -> DataFrame:
    """Exactly the schema's columns, missing ones null or ''."""
    have = set(df.columns)

    def one(name: str, kind: str) -> Column:
        c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if name in TEXT_FIELDS:
            c = F.coalesce(c, F.lit(""))
        elif kind == "boolean":
            c = F.coalesce(c, F.lit(False))
        elif kind == "array<string>":
            c = F.coalesce(c, F.array().cast(kind))
        return c.alias(name)

    return df.select(*[one(k, v) for k, v in fields.items()])
