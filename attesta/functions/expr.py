"""Scalar functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import schemas

#: Fixed values of title keys.
STIG_PHRASE = "security technical implementation guide"
STIG_WORDS = ("stig", "scap", "benchmark", "manual", "disa")
PLACEHOLDER_TITLES = ("unknown stig", "nessus compliance")
#: White space of any script.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(_col(c), F.lit(SPACES))


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other (from, to), and those that fold to several."""
    changed = [(c, c.casefold()) for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and c != c.casefold()]
    single = [(a, b) for a, b in changed if len(b) == 1]
    return "".join(a for a, _ in single), "".join(b for _, b in single), {a: b for a, b in changed if len(b) > 1}


def casefold(c: Column | str) -> Column:
    """Unicode's full case folding; text in ASCII takes the short way."""
    before, after, longer = _foldings()
    many = F.create_map(*map(F.lit, chain.from_iterable(longer.items())))
    spelled = F.array_join(F.transform(F.split(F.translate(_col(c), before, after), ""), lambda x: F.coalesce(many[x], x)), "")
    return F.when(_col(c).rlike(r"[^\x00-\x7F]"), spelled).otherwise(F.lower(_col(c)))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    """The first that is neither null nor blank, else blank."""
    return F.coalesce(*(blank_to_null(c) for c in cs), F.lit(""))


def lookup(values: Mapping[str, str], c: Column | str) -> Column:
    """The value of a small fixed map, null where it has none."""
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))[_col(c)]


def xccdf_status(c: Column | str) -> Column:
    """Null for results that are not reported (pass, notapplicable and the like)."""
    return lookup(schemas.XCCDF_STATUS, c)


def cklb_status(c: Column | str) -> Column:
    return F.coalesce(lookup(schemas.CKLB_STATUS, F.lower(strip(c))), F.lit("Unknown"))


def nessus_status(c: Column | str) -> Column:
    return F.coalesce(lookup(schemas.NESSUS_STATUS, F.upper(strip(c))), F.lit("Unknown"))


def severity(c: Column | str) -> Column:
    return F.coalesce(lookup(schemas.SEVERITY, F.lower(_col(c))), F.lit("Unknown"))


def category(c: Column | str) -> Column:
    return F.coalesce(lookup(schemas.CATEGORY, c), F.lit("Unknown"))


def effective_severity(raw: Column | str, override: Column | str) -> Column:
    """The override where it isn't blank, else the rule's own severity."""
    return severity(first_filled(F.lower(strip(override)), F.lower(strip(raw))))


def path_stem(c: Column | str) -> Column:
    """The last part of a path without its last suffix, trimmed and lower; a leading dot is no suffix."""
    return F.lower(strip(F.regexp_replace(F.regexp_extract(_col(c), r"([^/]+)/*$", 1), r"(?<=.)\.[^.]+$", "")))


def vuln_of_group(c: Column | str) -> Column:
    return F.substring_index(_col(c), "_group_", -1)


def host_key(c: Column | str) -> Column:
    return casefold(strip(c))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _title_words(text: Column) -> Column:
    bare = F.replace(F.regexp_replace(text, r"\.audit$", ""), F.lit(STIG_PHRASE), F.lit(" "))
    kept = F.filter(F.split(bare, "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*STIG_WORDS) & ~t.rlike(r"^v\d+r\d+$"))
    return F.when(text.isin("", *PLACEHOLDER_TITLES), "").otherwise(first_filled(F.array_join(kept, " "), text))


def stig_key(c: Column | str) -> Column:
    """A title's key: words without editions, versions and filler; blank for blanks and placeholders."""
    return _bound(casefold(F.trim(F.regexp_replace(_col(c), r"(?U)[\s\x1c-\x1f]+", " "))), _title_words)


def rule_stem(c: Column | str) -> Column:
    """A rule id without its namespace prefix and its revision."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^xccdf_[^_]+_rule_", ""), r"r\d+_rule$", "")


def vuln_key(vuln_id: Column | str) -> Column:
    """Null where blank: a null key joins with nothing."""
    return blank_to_null(vuln_id)


def rule_key(rule_id: Column | str) -> Column:
    return blank_to_null(rule_stem(rule_id))


def finding_key(vuln_id: Column | str, rule_id: Column | str) -> Column:
    return F.coalesce(blank_to_null(vuln_id), _col(rule_id))


def sanitized(c: Column | str) -> Column:
    """Text that a spreadsheet would take for a formula, behind an apostrophe."""
    return F.when(_col(c).rlike(r"^[=+\-@|\t\r]"), F.concat(F.lit("'"), _col(c))).otherwise(_col(c))


def formula_quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(_col(c), F.lit('"'), F.lit('""')), F.lit('"'))


def is_safe_name(c: Column | str) -> Column:
    """A bare file name: no separators, no parent step, not blank."""
    return (_col(c) != "") & ~_col(c).rlike(r"[/\\]") & ~_col(c).isin(".", "..")


def is_accepted_upload(name: Column | str, size: Column | str) -> Column:
    """A safe name with a suffix that is read, of 200 MiB at most."""
    return is_safe_name(name) & F.lower(_col(name)).rlike(r"\.(xml|zip|cklb|nessus)$") & (_col(size) <= 200 * 1024 * 1024)


def cell_width(c: Column | str, header: str, most: int) -> Column:
    """An aggregate: the width of a sheet's column, from the first lines of its cells."""
    longest = F.max(F.least(F.length(F.substring_index(_col(c), "\n", 1)), F.lit(most)))
    return F.least(F.greatest(F.coalesce(longest, F.lit(0)), F.lit(len(header))) + 2, F.lit(most))


def reference_token(reference: Column | str, key: str) -> Column:
    """The value of a key's first KEY|value among commas, stripped; blank where it has none."""
    parts = F.transform(F.split(_col(reference), ","), lambda p: F.struct(strip(F.substring_index(p, "|", 1)).alias("k"), strip(F.substring(p, F.instr(p, F.lit("|")) + 1, F.length(p))).alias("v"), (F.instr(p, F.lit("|")) > 0).alias("has")))
    return F.coalesce(F.get(F.filter(parts, lambda p: p["has"] & (p["k"] == key)), 0)["v"], F.lit(""))
