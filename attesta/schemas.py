"""Relations of the engine, and the fixed values of their enumerated columns."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of findings, and the values of their enumerated columns.
FINDING_FIELDS = ("stig_title", "vuln_id", "rule_id", "severity", "status", "server", "ip_address", "check_text", "fix_text")
ORDER_FIELDS = ("kind_rank", "file_ord", "row_ord")

SEVERITIES = ("CAT I", "CAT II", "CAT III")
ACTIONABLE = ("Open", "Not Reviewed", "Error", "Unknown")
DELTA_STATUSES = ("New", "Resolved", "Persisting", "Not re-scanned", "Newly scanned")

#: The words that scan formats use, and what they become.
XCCDF_STATUS = {"fail": "Open", "notchecked": "Not Reviewed", "notselected": "Not Reviewed", "error": "Error", "unknown": "Unknown"}
CKLB_STATUS = {"open": "Open", "not_reviewed": "Not Reviewed", "not_a_finding": "Not A Finding", "not_applicable": "Not Applicable", "error": "Error"}
NESSUS_STATUS = {"FAILED": "Open", "PASSED": "Not A Finding", "WARNING": "Not Reviewed", "ERROR": "Error"}
SEVERITY = {"high": "CAT I", "medium": "CAT II", "low": "CAT III"}
CATEGORY = {"I": "CAT I", "II": "CAT II", "III": "CAT III"}
HOST_FACTS = ("urn:scap:fact:asset:identifier:host_name", "urn:scap:fact:asset:identifier:fqdn")
IP_FACTS = ("urn:scap:fact:asset:identifier:ipv4", "urn:scap:fact:asset:identifier:ipv6")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), False) for n in names]


def _ints(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType(), False) for n in names]


FINDINGS = T.StructType([*_strings(*FINDING_FIELDS), *_ints(*ORDER_FIELDS)])
SCANS = T.StructType([*_strings("source_file", "hostname", "ip_address", "benchmark_href", "benchmark_id", "scanner"), *_ints("file_ord", "n_rules")])
RULE_RESULTS = T.StructType([*_ints("file_ord", "row_ord"), *_strings("rule_id", "status")])
BENCHMARKS = T.StructType([*_ints("bm_ord"), *_strings("benchmark_id", "title")])
BENCHMARK_RULES = T.StructType([*_ints("bm_ord", "row_ord"), *_strings("rule_id", "vuln_id", "severity", "check_text", "fix_text")])
WARNINGS = T.StructType([*_ints("phase", "file_ord", "row_ord"), *_strings("message")])
COVERAGE = T.StructType(_strings("server", "stig_title"))
