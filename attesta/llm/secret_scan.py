"""Secrets, and weak candidates that complementary parts nearby confirm.

Strong patterns are reported wherever they match. Weak ones (a user name, a mixed-case token, an endpoint) are
reported only within a scope: a name beside a secret, a token beside an identifier or an endpoint, an endpoint beside
both. The scope is an interval of SCOPE code points; the join is on (row, bucket of the start) with the three buckets
that the interval can reach, against one summary row per bucket, so its rows stay linear in the number of candidates.

Defined cases: a null text is empty; a text of any length is scanned whole; scopes never cross rows; repeated rows each get the
same result; rows that share a doc_id but differ in text are scanned apart; a null doc_id passes through (-2**63 counts as
null in keys); spans that begin together go by their kind; no match gives zero counts and the hash of an empty string; other columns of
any name play no part (redacted passes them through); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import apart, keyed, parted, restored, whole, written

SCOPE = 256
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
IDENT = r"""(?i:(username|user|login|account_?id|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)"""
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(?:https?|s3|postgresql|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9][A-Za-z0-9._~:/?@%+=&-]*"
#: kind: pattern, group whose length counts, that length at least, class (identifier, secret, endpoint), strong
KINDS = {
    "assign": (ASSIGN, 2, 6, "s", True),
    "access": (ACCESS, 0, 20, "i", True),
    "hex": (HEX, 0, 24, "s", True),
    "ident": (IDENT, 2, 3, "i", False),
    "token": (TOKEN, 0, 20, "s", False),
    "endpoint": (ENDPOINT, 0, 8, "e", False),
}
#: For a first look only: cheaper than the pattern, and true wherever a match can pass.
GATES = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}", "token": TOKEN}
RANK = {k: i for i, k in enumerate(KINDS)}
SPAN = "array<struct<rank:int,s:int,e:int>>"
CHUNK = 256


def spans(text: str, kind: str) -> Column:
    """The passing matches of a kind in column text as array<struct<rank, s, e>>: code points, end exclusive.

    Gaps come from split and matches from regexp_extract_all; running sums are taken in chunks, so that the work stays
    linear in the number of matches.
    """
    pattern, group, least, _, _ = KINDS[kind]
    q = lambda s: "r'" + s.replace("'", r"\x27") + "'"
    r, rank = q(pattern), RANK[kind]
    none = f"cast(array() as {SPAN})"
    lens = f"transform(arrays_zip(regexp_extract_all({text}, {r}, 0) as m, regexp_extract_all({text}, {r}, {group}) as v, slice(split({text}, {r}, -1), 1, size(regexp_extract_all({text}, {r}, 0))) as g), x -> named_struct('g', length(x.g), 'm', length(x.m), 'v', length(x.v)))"
    lens = lens.replace(" as m,", ",").replace(" as v,", ",").replace(" as g)", ")").replace("x.g", "x.`2`").replace("x.m", "x.`0`").replace("x.v", "x.`1`")
    extra = ""
    if kind == "token":  # random tokens mix cases and digits
        m = f"regexp_extract_all({text}, {r}, 0)"
        extra = f"transform({m}, x -> x rlike '[0-9]' and x rlike '[a-z]' and x rlike '[A-Z]')"
    total = f"transform(sequence(0, (size(l) - 1) div {CHUNK}), j -> aggregate(slice(l, j * {CHUNK} + 1, {CHUNK}), 0, (a, x) -> a + x.g + x.m))"
    starts = "aggregate(c, named_struct('p', 0, 'a', cast(array() as array<int>)), (a, x) -> named_struct('p', a.p + x, 'a', concat(a.a, array(a.p))), a -> a.a)"
    within = f"flatten(transform(o, (p, j) -> aggregate(slice(l, j * {CHUNK} + 1, {CHUNK}), named_struct('p', p, 'a', cast(array() as array<struct<s:int,e:int,v:int>>)), (a, x) -> named_struct('p', a.p + x.g + x.m, 'a', concat(a.a, array(named_struct('s', a.p + x.g, 'e', a.p + x.g + x.m, 'v', x.v)))), a -> a.a)))"
    # nested single-element transforms bind a value once
    bind = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    found = bind(lens, "l", bind(total, "c", bind(starts, "o", within)))
    keep = f"x.v >= {least}"
    if extra:
        found = bind(extra, "k", f"filter({found}, (x, i) -> element_at(k, i + 1))")
    picked = f"transform(filter({found}, x -> {keep}), x -> named_struct('rank', {rank}, 's', x.s, 'e', x.e))"
    return F.expr(f"case when {text} rlike {q(GATES.get(kind, pattern))} then cast({picked} as {SPAN}) else {none} end")


def _digest(array: str) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(array_sort(transform({array}, x -> named_struct('s', x.s, 'rank', x.rank, 'e', x.e))), x -> concat_ws(':', element_at(array({names}), x.rank + 1), x.s, x.e)), ',')")


def linked(rows: DataFrame) -> DataFrame:
    """_id, _th and linked: the weak spans (rows have strong and weak) that a complementary part in their scope confirms."""
    parts = rows.where((F.size("weak") > 0) & (F.size("strong") + F.size("weak") > 1)).select("_id", "_th", F.explode(F.concat("strong", "weak")).alias("x")).select("_id", "_th", "x.*").distinct()
    rank = lambda which: F.col("rank").isin(*(RANK[k] for k, v in KINDS.items() if v[3] == which))
    parts = written(parts.withColumn("b", F.floor(F.col("s") / SCOPE)), "parts")
    marks = parts.groupBy("_id", "_th", "b").agg(*(f(F.when(rank(c), F.col("s"))).alias(f"{c}_{n}") for c in "ise" for n, f in (("min", F.min), ("max", F.max))))
    weak = parts.where(F.col("rank").isin(*(RANK[k] for k, v in KINDS.items() if not v[4]))).withColumn("q", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    marks = marks.withColumnRenamed("b", "q")
    hit = lambda c: F.coalesce(F.max((F.abs(F.col(f"{c}_min") - F.col("s")) <= SCOPE) | (F.abs(F.col(f"{c}_max") - F.col("s")) <= SCOPE)), F.lit(False))
    near = weak.join(marks, ["_id", "_th", "q"]).groupBy("_id", "_th", "rank", "s", "e").agg(*(hit(c).alias(c) for c in "ise"))
    i, s, e = F.col("i"), F.col("s_near"), F.col("e_near")
    near = near.toDF("_id", "_th", "rank", "s", "e", "i", "s_near", "e_near")
    good = F.when(F.col("rank") == RANK["ident"], s).when(F.col("rank") == RANK["token"], i | e).otherwise(i & s)
    return near.where(good).groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("rank", "s", "e"))).alias("linked"))


def scanned(docs: DataFrame) -> DataFrame:
    """keyed() rows without text, with strong and weak spans; a weak span that touches a strong one is part of it."""
    rows = keyed(docs)
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", spans("text", kind))
    strong, weak = ([f"_{k}" for k, v in KINDS.items() if v[4] is yes] for yes in (True, False))
    rows = rows.withColumn("strong", F.concat(*strong)).withColumn("_weak", F.concat(*weak))
    rows = rows.withColumn("weak", F.when((F.size("strong") == 0) | (F.size("_weak") == 0), F.col("_weak")).otherwise(_apart()))
    counts = [F.size(c).cast("long").alias(f"n{c}") for c in strong]
    return rows.select("doc_id", "_id", "_th", "strong", "weak", *counts)


def _apart() -> Column:
    """The weak spans that overlap no strong one; both lists are short where both have any."""
    return F.filter("_weak", lambda w: ~F.exists("strong", lambda x: (x["s"] < w["e"]) & (w["s"] < x["e"])))


def found(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, _id, _th, n_assign, n_access, n_hex, strong, all_spans."""
    rows = written(scanned(docs), "spans")
    links = written(linked(rows), "links")
    return rows.join(links, ["_id", "_th"], "left").withColumn("all_spans", F.concat("strong", F.coalesce("linked", F.expr(f"cast(array() as {SPAN})"))))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked."""
    return found(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode(_digest("strong"), "UTF-8"), 256).alias("base_sha256"), _digest("all_spans").alias("spans"),
        F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"),
    )


MASK = "[redacted]"


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every found span masked and n_chars set anew, in the columns of docs; no document goes.

    Spans that overlap are masked as one. Only documents with spans change.
    """
    spans_of = written(found(docs).where(F.size("all_spans") > 0).select("_id", "_th", "all_spans").dropDuplicates(["_id", "_th"]), "to_redact")
    some, unchanged = parted(apart(docs).drop("text"), spans_of)
    df = some.join(spans_of, ["_id", "_th"], "left").withColumn("text", whole("_row.text")).withColumn("_o", F.expr("array_sort(transform(all_spans, x -> named_struct('s', x.s, 'e', x.e)))"))
    # a span counts as masked from where the spans before it end
    ends = F.expr(
        "aggregate(_o, named_struct('p', 0, 'a', cast(array() as array<struct<s:int,e:int,c:int>>)), (a, x) -> named_struct('p', greatest(a.p, x.e), 'a', case when x.e <= a.p then a.a else concat(a.a, array(named_struct('s', greatest(x.s, a.p), 'e', x.e, 'c', a.p))) end), a -> a.a)"
    )
    df = df.withColumn("_m", ends)
    pieces = F.expr(f"array_join(transform(_m, x -> concat(substring(text, x.c + 1, x.s - x.c), '{MASK}')), '')")
    rest = F.expr("substring(text, element_at(_m, -1).e + 1)")
    masked = F.size("_m") > 0
    df = df.withColumn("_text", F.when(masked, F.concat(pieces, rest)))
    changed = lambda new, c: F.when(masked, new).otherwise(F.col(f"_row.{c}"))
    df = restored(df, docs.columns, {"text": changed(F.col("_text"), "text")} | ({"n_chars": changed(F.length("_text").cast("long"), "n_chars")} if "n_chars" in docs.columns else {}))
    return df.union(restored(unchanged, docs.columns))
