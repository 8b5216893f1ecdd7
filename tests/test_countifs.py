"""Criteria of a sheet against a plain version."""

import re
from collections import Counter

from attesta.operators import countifs

CELLS = ["web1", "WEB1", "web", "we?1", "w*", "web~x", "~web", "", "a.b", "axb", "web\nx", "10", "9", "'=web1", "[w]eb", "webweb12", "ß", "É", "zeta"]
CRITERIA = [
    *CELLS, "we?", "w*1", "*", "?", "~*", "w~*", "we~?1", "~~web", "web~~x", "~~*", "*~**", "=web1", "=w*", "<>web1", "<>w*", "<m", ">m", "<=web", ">=WEB", "<10", ">=9", "<>", "=", "*.b", "web*12", "webwebwebweb*", "é", "<", ">",
]


def plain(cell, criterion):
    op, rest = re.match("(?s)(<>|<=|>=|=|<|>|)(.*)", criterion).groups()
    cell, rest = cell.lower(), rest.lower()
    if op in ("", "=", "<>"):
        wild, i = "", 0
        while i < len(rest):
            if rest[i] == "~" and rest[i + 1 : i + 2] in ("*", "?", "~") and rest[i + 1 : i + 2]:
                wild, i = wild + re.escape(rest[i + 1]), i + 1
            else:
                wild += {"*": ".*", "?": "."}.get(rest[i], re.escape(rest[i]))
            i += 1
        fits = re.fullmatch(wild, cell, re.S) is not None and (cell != "" or rest == "")
        return fits if op != "<>" else not fits
    if re.fullmatch(countifs.NUMBER, rest) or cell == "":
        return False
    return {"<": cell < rest, ">": cell > rest, "<=": cell <= rest, ">=": cell >= rest}[op]


def test_criteria(spark):
    rows = [(c, s) for i, c in enumerate(CELLS) for s in ("I", "II")[: 1 + i % 2] for _ in range(1 + i % 3)]
    criteria = spark.createDataFrame([(c,) for c in [*CRITERIA, *CRITERIA, None]], "c string")
    got = countifs.counts(criteria, "c", spark.createDataFrame([*rows, (None, "I")], "cell string, s string"), "cell", "s")
    want = Counter()
    for c in set(CRITERIA):
        for cell, s in rows:
            want[c, s] += plain(cell, c)
    assert {(r["c"], r["s"]): r["n"] for r in got.collect()} == {k: n for k, n in want.items() if n}


def test_plain_criteria_meet_no_other_cell(spark):
    """An equi-join finds them: there is no nested loop in the plan."""
    df = countifs.matching_cells(spark.createDataFrame([("a",), ("b*",)], "c string"), "c", spark.createDataFrame([("A",), ("bc",)], "cell string"), "cell")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and sorted(map(tuple, df.collect())) == [("a", "A"), ("b*", "bc")]
