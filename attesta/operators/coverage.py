"""Which (host, benchmark title) pairs a run has scanned, and how two runs compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import expr
from attesta.plans.tables import written

UNTITLED = "(untitled)"


def coverage_of_findings(findings: DataFrame, *by: str) -> DataFrame:
    return findings.select(*by, "server", "stig_title").distinct()


def coverage_of_scans(scans: DataFrame, matches: DataFrame) -> DataFrame:
    """One pair for each scan with any rule result; a scan without is no scan."""
    titled = scans.where("n_rules > 0").join(matches, ["benchmark_href", "benchmark_id"], "left")
    return titled.select(F.col("hostname").alias("server"), F.coalesce("title", F.lit("")).alias("stig_title")).distinct()


def keyed_pairs(coverage: DataFrame, *by: str) -> DataFrame:
    """host_key, stig_key and the smallest raw pair (server, stig_title) of each, apart by the columns of by.

    Distinct pairs are written first: the optimizer would drop a distinct below this minimum, and keys would be made for every
    finding, and sorted, instead of for every pair.
    """
    raw = written(coverage.select(*by, "server", "stig_title").distinct(), "raw_pairs")
    keyed = raw.select(*by, expr.host_key("server").alias("host_key"), expr.stig_key("stig_title").alias("stig_key"), "server", "stig_title")
    return keyed.groupBy(*by, "host_key", "stig_key").agg(F.min(F.struct("server", "stig_title")).alias("raw")).select(*by, "host_key", "stig_key", "raw.server", "raw.stig_title")


def host_groups(base: DataFrame, curr: DataFrame) -> DataFrame:
    """host_key, server and side (common, baseline, current) from keyed pairs; spelled as the baseline does where it can."""
    side = lambda pairs, name: pairs.groupBy("host_key").agg(F.min("server").alias(name))
    both = side(base, "b").join(side(curr, "c"), "host_key", "full")
    where = F.when(F.col("c").isNull(), "baseline").when(F.col("b").isNull(), "current").otherwise("common")
    return both.select("host_key", F.coalesce("b", "c").alias("server"), where.alias("side"))


def gap(pairs: DataFrame, other: DataFrame) -> DataFrame:
    """The keyed pairs that the other run lacks, or that have no title: without one nothing can be shown to be re-scanned."""
    titled = pairs.where("stig_key <> ''").join(other.select("host_key", "stig_key"), ["host_key", "stig_key"], "left_anti")
    return titled.unionByName(pairs.where("stig_key = ''"))


def pair_list(pairs: DataFrame, most: int = 20) -> DataFrame:
    """n and text: the first pairs as HOST / TITLE, and how many more there are. Only the first of them are gathered."""
    spelled = F.concat_ws(" / ", "server", F.coalesce(expr.blank_to_null("stig_title"), F.lit(UNTITLED)))
    first = pairs.orderBy("host_key", "stig_key", "server", "stig_title").limit(most)
    shown = first.agg(F.sort_array(F.collect_list(F.struct("host_key", "stig_key", "server", "stig_title", spelled.alias("text")))).alias("l"))
    total = pairs.agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit("; and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    # one row on either side
    return total.join(F.broadcast(shown), F.lit(True), "left").select("n", F.concat(F.array_join(F.transform("l", lambda x: x["text"]), "; "), more).alias("text"))


def scans_without_rules(scans: DataFrame, results: DataFrame) -> DataFrame:
    return scans.join(results.select("file_ord").distinct(), "file_ord", "left_anti")
