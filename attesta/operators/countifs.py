"""What a sheet counts: criteria of COUNTIFS as a spreadsheet reads them, evaluated over findings.

A criterion is a text. It may begin with an operator (= <> < > <= >=); what follows is its operand. Texts are compared without
regard to case. In an operand, * stands for any characters, ? for one, and a tilde before *, ? or ~ for that character itself. An operand of an
ordering that is a number compares with numbers, of which a sheet of texts has none.

Criteria meet the distinct cells, never the rows, which are counted by cell first. A criterion without wildcards and
operators is found by its own text in an equi-join. One with wildcards meets the cells that share the characters before its
first wildcard, LEADING of them at most, again by an equi-join; only criteria without such characters, and orderings, meet every
distinct cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.plans.tables import written

#: Characters before the first wildcard that are joined on.
LEADING = 6
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def operator(criterion: Column) -> Column:
    return F.regexp_extract(criterion, "^(<>|<=|>=|=|<|>)?", 1)


def operand(criterion: Column) -> Column:
    return F.lower(F.regexp_replace(criterion, "^(<>|<=|>=|=|<|>)", ""))


def pattern(text: Column) -> Column:
    """The regular expression that an operand's wildcards say."""
    # what tildes protect becomes characters that no text of a sheet can hold, and comes back as itself
    held = F.regexp_replace(text, r"~([*?~])", "\x01$1")
    held = F.regexp_replace(F.regexp_replace(F.regexp_replace(held, "\x01\\*", "\x02"), "\x01\\?", "\x03"), "\x01~", "\x04")
    plain = F.regexp_replace(held, r"([\\.^$|()\[\]{}+])", r"\\$1")
    wild = F.regexp_replace(F.regexp_replace(plain, r"\*", ".*"), r"\?", ".")
    back = F.regexp_replace(F.regexp_replace(F.regexp_replace(wild, "\x02", r"\\*"), "\x03", r"\\?"), "\x04", "~")
    return F.concat(F.lit("(?s)^"), back, F.lit("$"))


def is_plain(criterion: Column) -> Column:
    """Whether a criterion is just a text to be equal to."""
    return (operator(criterion) == "") & ~criterion.rlike("[*?~]")


def leading(criterion: Column) -> Column:
    """What a matching cell must begin with, LEADING characters at most; blank if that is nothing."""
    return F.when(operator(criterion).isin("", "="), F.substring(F.regexp_extract(operand(criterion), r"^([^*?~]*)", 1), 1, LEADING)).otherwise("")


def holds(cell: Column, criterion: Column) -> Column:
    """Whether a cell fits a criterion."""
    op, rest, low = operator(criterion), operand(criterion), F.lower(cell)
    equal = F.when(rest.rlike("[*?~]"), F.regexp(low, pattern(rest)) & ((low != "") | (rest == ""))).otherwise(low == rest)
    order = F.when(op == "<", low < rest).when(op == ">", low > rest).when(op == "<=", low <= rest).otherwise(low >= rest)
    return F.when(op.isin("", "="), equal).when(op == "<>", ~equal).otherwise(~rest.rlike(NUMBER) & (low != "") & order)


def matching_cells(criteria: DataFrame, criterion: str, cells: DataFrame, cell: str) -> DataFrame:
    """Each distinct criterion with each distinct cell that fits it."""
    criteria, cells = criteria.select(criterion).where(F.col(criterion).isNotNull()).distinct(), cells.select(cell).where(F.col(cell).isNotNull()).distinct()
    plain = is_plain(F.col(criterion))
    equal = criteria.where(plain).join(cells, F.lower(criterion) == F.lower(cell))
    starts = criteria.where(~plain).withColumn("_start", leading(F.col(criterion)))
    # a cell under each of its beginnings, as long as criteria can ask for
    begun = cells.select(cell, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(LEADING)), lambda n: F.substring(F.lower(cell), F.lit(1), n)))).alias("_start"))
    wild = starts.join(begun, "_start").where(holds(F.col(cell), F.col(criterion))).select(criterion, cell)
    return equal.unionByName(wild)


def counts(criteria: DataFrame, criterion: str, cells: DataFrame, cell: str, by: str, weight: str | None = None) -> DataFrame:
    """criterion, by and n: how many rows of cells fit each criterion, by a column of their own; criteria that nothing fits have no row.

    cells: rows with the cell and by, or counts of such rows in the column weight; they are counted by both before any join, and written, so that they are
    made once.
    """
    n = F.sum(weight) if weight else F.count("*")
    sums = written(cells.groupBy(cell, by).agg(n.alias("_n")), "cell_sums")
    return matching_cells(criteria, criterion, sums, cell).join(sums, cell).groupBy(criterion, by).agg(F.sum("_n").alias("n"))
