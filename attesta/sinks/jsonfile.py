"""Findings as JSON, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import schemas

ARRAY = "array<struct<" + ",".join(f"{c}:string" for c in schemas.FINDING_FIELDS) + ">>"


def to_text(findings: DataFrame, order: list[str] | None = None) -> str:
    """One JSON array, for findings that fit in the driver; write.json is the sink for larger ones."""
    import json

    rows = findings.orderBy(*order) if order else findings
    return json.dumps([{c: r[c] for c in schemas.FINDING_FIELDS} for r in rows.select(*schemas.FINDING_FIELDS).toLocalIterator()])


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """Findings of a JSON array; unknown keys are ignored, a missing one is an error."""
    rows = spark.createDataFrame([(text,)], "doc string").select(F.inline(F.from_json("doc", ARRAY)))
    for c in schemas.FINDING_FIELDS:
        rows = rows.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"a finding has no {c}"))))
    return rows


def write(findings: DataFrame, path: str) -> None:
    """A folder of JSON lines, written by the executors; replaces what is there."""
    findings.select(*schemas.FINDING_FIELDS).write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in schemas.FINDING_FIELDS)).json(path)
