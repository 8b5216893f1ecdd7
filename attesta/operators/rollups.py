"""Counts over findings and delta findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import schemas


def actionable(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status").isin(*schemas.ACTIONABLE))


def label(value: str) -> str:
    return value.lower().replace(" ", "_").replace("-", "_")


def _counts(column: str, values: tuple[str, ...]) -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(label(v)) for v in values]


def _spine(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord long, {name} string")


def _filled(spine: DataFrame, counts: DataFrame, on: str) -> DataFrame:
    numbers = [c for c in counts.columns if c != on]
    # the spine has a handful of rows, and so have the counts joined to it
    return spine.join(counts, on, "left").select("ord", on, *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers))


def run_summary(findings: DataFrame, files: int) -> DataFrame:
    cats = [F.count_if(F.col("severity") == s).alias(f"cat{i}") for i, s in enumerate(schemas.SEVERITIES, 1)]
    hosts = F.count_distinct(F.nullif("server", F.lit(""))).alias("hosts")
    return findings.agg(F.lit(files).cast("long").alias("files"), hosts, F.count("*").alias("findings"), *cats)


def by_severity(findings: DataFrame) -> DataFrame:
    counts = _counts("status", schemas.ACTIONABLE)
    total = F.count_if(F.col("status").isin(*schemas.ACTIONABLE)).alias("total")
    spine = _spine(findings.sparkSession, "severity", schemas.SEVERITIES)
    return _filled(spine, findings.where(F.col("severity").isin(*schemas.SEVERITIES)).groupBy("severity").agg(*counts, total), "severity")


def _by_category(findings: DataFrame, *keys: str) -> DataFrame:
    total = F.count_if(F.col("severity").isin(*schemas.SEVERITIES)).alias("total")
    return findings.groupBy(*keys).agg(*_counts("severity", schemas.SEVERITIES), total)


def by_server(findings: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each (server, ip); the counts are the server's, so a server with two addresses shows them twice."""
    # counts by (server, ip) first: the sums over a server's addresses need few rows
    pairs = findings.groupBy("server", "ip_address").agg(F.min(order).alias("first"), *_counts("severity", schemas.SEVERITIES))
    names = [label(s) for s in schemas.SEVERITIES]
    sums = pairs.groupBy("server").agg(*(F.sum(n).alias(n) for n in names))
    total = sum((F.col(n) for n in names), F.lit(0))
    return pairs.select("server", "ip_address", "first").join(sums, "server").withColumn("total", total)


def by_stig(findings: DataFrame, order: str = "ord") -> DataFrame:
    titled = findings.where("stig_title <> ''").groupBy("stig_title")
    total = F.count_if(F.col("severity").isin(*schemas.SEVERITIES)).alias("total")
    return titled.agg(F.min(order).alias("first"), *_counts("severity", schemas.SEVERITIES), total)


def delta_summary(delta: DataFrame) -> DataFrame:
    """Five rows; total counts every severity, so it exceeds the three columns where some are unknown."""
    counts = delta.groupBy("delta_status").agg(*_counts("severity", schemas.SEVERITIES), F.count("*").alias("total"))
    return _filled(_spine(delta.sparkSession, "delta_status", schemas.DELTA_STATUSES), counts, "delta_status")


def delta_counts(delta: DataFrame) -> DataFrame:
    return delta.groupBy("delta_status").agg(F.count("*").alias("n"))


def blank_vuln_rate(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.avg(F.when(F.col("vuln_id") == "", 1.0).otherwise(0.0)), F.lit(0.0)).alias("rate"))
