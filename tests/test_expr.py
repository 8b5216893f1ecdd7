import pytest
from pyspark.sql import functions as F

from attesta.functions import expr
from attesta.sources import formats

TITLES = {
    "": "", "   ": "", "Unknown STIG": "", " nessus   COMPLIANCE ": "", "Windows 11 STIG": "windows 11", "Windows 11 Security Technical Implementation Guide": "windows 11",
    "MS_Windows_11_STIG SCAP Benchmark V1R2": "ms windows 11", "RHEL 9 v2r3": "rhel 9", "CIS_Linux.audit": "cis linux", "Audit Policy": "audit policy", "STIG": "stig", "DISA STIG Manual": "disa stig manual",
}
STEMS = {"": "", " SV-1r2_rule ": "SV-1", "xccdf_mil.disa.stig_rule_SV-254239r1_rule": "SV-254239", "SV-1": "SV-1", "1.1.2 Ensure x": "1.1.2 Ensure x", "xccdf_a_rule_b": "b"}


def values(spark, inputs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_stig_key(spark):
    assert values(spark, TITLES, expr.stig_key) == list(TITLES.values())


def test_rule_stem(spark):
    assert values(spark, STEMS, expr.rule_stem) == list(STEMS.values())


def test_host_key(spark):
    assert values(spark, [" Web01\t", "WEB01", "STRAßE", " x "], expr.host_key) == ["web01", "web01", "strasse", "x"]


def test_status_maps(spark):
    assert values(spark, ["fail", "Fail", "pass", "notselected"], expr.xccdf_status) == ["Open", None, None, "Not Reviewed"]
    assert values(spark, [" OPEN ", "odd", ""], expr.cklb_status) == ["Open", "Unknown", "Unknown"]
    assert values(spark, ["passed", " Warning", None], expr.nessus_status) == ["Not A Finding", "Not Reviewed", "Unknown"]


@pytest.mark.parametrize(("raw", "over", "want"), [("high", "", "CAT I"), ("low", " MEDIUM ", "CAT II"), ("", "", "Unknown"), ("High", "odd", "Unknown")])
def test_effective_severity(spark, raw, over, want):
    row = spark.createDataFrame([(raw, over)], "a string, b string").select(expr.effective_severity("a", "b").alias("s")).first()
    assert row["s"] == want


def test_path_stem(spark):
    assert values(spark, ["./p/Xccdf_A.b.xml", "x/y/", ".hidden", "", "a.tar.gz"], expr.path_stem) == ["xccdf_a.b", "y", ".hidden", "", "a.tar"]


def test_reference_tokens():
    ref = "CAT|II,CCI|1,CCI|2, Rule-ID |SV-1,odd,CAT|I"
    assert [formats.tokens(ref).get(k, "") for k in ("CAT", "CCI", "Rule-ID", "STIG-ID")] == ["II", "1", "SV-1", ""]


def test_cells(spark):
    assert values(spark, ["=1", "+a", "-", "@x", "|y", "\tz", "\rq", "ok", "", " =1"], expr.sanitized) == ["'=1", "'+a", "'-", "'@x", "'|y", "'\tz", "'\rq", "ok", "", " =1"]
    assert values(spark, ['a"b', ""], expr.formula_quoted) == ['"a""b"', '""']


def test_upload_names(spark):
    rows = spark.createDataFrame([("a.xml", 1), ("../a.xml", 1), ("a/b.xml", 1), ("A.CKLB", 1), ("a.exe", 1), ("a.xml", 300 * 2**20)], "n string, s long")
    assert [r[0] for r in rows.select(expr.is_accepted_upload("n", "s")).collect()] == [True, False, False, True, False, False]


def test_casefold_as_unicode_has_it(spark):
    words = ["Straße", "ẞ", "ﬁLM ﬃ", "ΟΔΟΣ ς", "İstanbul", "ŉ ǰ ΐ", "Ǆ ᾳ", "plain ASCII", "", "日本語", "𐐀"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", expr.casefold("w").alias("f")).collect()
    assert {r["w"]: r["f"] for r in got} == {w: w.casefold() for w in words}
