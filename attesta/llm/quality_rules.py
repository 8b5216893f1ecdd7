"""Quality rules with host verdicts.

Each document is measured on its own (whole text, one pass, no shuffle). The failures of each rule are then summed by
host, the host's rate of each is shrunk towards the corpus by a beta prior of that rule, fitted to all hosts, and hosts
with a shrunk rate that is too high are rejected with all their documents.

Defined cases: a null or empty text has no words and fails; a text of any length is measured whole; a null host is one host of
its own; repeated rows are each measured and counted; ties don't arise, as a host's verdict is one of its counts; an empty
table gives an empty result; other columns of the input, of any name, play no part (keep_good passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import WHITE, apart, restored, whole, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host goes if a shrunk failure rate of it is above this.
MAX_HOST_RATE = 0.5
#: What fails a document by each rule, in SQL over the measures; the first is the verdict on the document itself.
RULES = {
    "failed": "base_failed",
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
#: Bounds for the prior's weight, in documents.
MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text", keep: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words (long) and base_failed; the words as column `keep` if named.

    Repeated windows: sort (hash, position) of all windows, keep those beside an equal hash, and sum the gaps between
    their positions, so a text of n words takes n log n steps.
    """
    t = whole(text)
    wordy = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = lambda i: F.element_at("_w", i)
    df = docs.withColumns({"_w": words(t), "_l": wordy, "word_chars": _without(t, WHITE).cast("long"), "n_symbols": (F.length(t) - _without(t, SYMBOLS)).cast("long")})
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn(
        "_h",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(*(at(i + k) for k in range(WINDOW)))),
        ),
    )
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda k: F.get("_s", k).getField("h")
    df = df.withColumn(
        "_p",
        F.array_sort(
            F.transform(
                F.filter("_s", lambda x, k: F.coalesce(near(k - 1) == x["h"], F.lit(False)) | F.coalesce(near(k + 1) == x["h"], F.lit(False))), lambda x: x["i"]
            )
        ),
    )
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    df = df.withColumns({"n_lines": F.size("_l").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long"))})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return (df.withColumnRenamed("_w", keep) if keep else df).drop("_w", "_l", "_h", "_s", "_p")


def host_verdicts(stats: DataFrame, host: str) -> DataFrame:
    """Per host: host_docs, for each of RULES host_<rule> (failures) and rate_<rule> (shrunk), and host_rejected.

    Counts are summed on the map side, so a host with a third of all rows sends one row per task. The priors come from
    one row of sums over the hosts: mean m of all documents, variance v of host rates about it (weighted by documents,
    less binomial noise), weight m(1-m)/v - 1 within bounds.
    """
    n = F.col("host_docs")
    hosts = stats.groupBy(host).agg(F.count("*").alias("host_docs"), *(F.sum(F.expr(rule).cast("long")).alias(f"host_{r}") for r, rule in RULES.items()))
    square = lambda r: F.sum(n * (F.col(f"host_{r}") / n) * (F.col(f"host_{r}") / n)).alias(f"q_{r}")
    sums = hosts.agg(F.sum(n).alias("n"), F.count("*").alias("k"), *(F.sum(f"host_{r}").alias(f"f_{r}") for r in RULES), *map(square, RULES))
    mean = sums.select("n", "k", *(f"q_{r}" for r in RULES), *((F.col(f"f_{r}") / F.nullif("n", F.lit(0))).alias(f"m_{r}") for r in RULES))

    def weight(r: str) -> Column:
        m = F.col(f"m_{r}")
        v = F.greatest(F.col(f"q_{r}") / F.nullif("n", F.lit(0)) - m * m - m * (1 - m) * F.col("k") / F.col("n"), F.lit(0.0))
        return F.when(v <= 0, F.lit(MAX_PRIOR)).otherwise(F.least(F.lit(MAX_PRIOR), F.greatest(F.lit(MIN_PRIOR), m * (1 - m) / F.nullif(v, F.lit(0.0)) - 1)))

    prior = mean.select(*(f"m_{r}" for r in RULES), *(weight(r).alias(f"w_{r}") for r in RULES))
    shrunk = {r: (F.col(f"host_{r}") + F.col(f"m_{r}") * F.col(f"w_{r}")) / (n + F.col(f"w_{r}")) for r in RULES}
    # the prior is a single row
    rated = hosts.join(F.broadcast(prior), F.lit(True), "left").select(host, "host_docs", *(f"host_{r}" for r in RULES), *(c.alias(f"rate_{r}") for r, c in shrunk.items()))
    return rated.withColumn("host_rejected", F.greatest(*(f"rate_{r}" for r in RULES)) > MAX_HOST_RATE)


def judged(stats: DataFrame, host: str = "source") -> DataFrame:
    """Joins the host verdicts back to measured documents; kept is false for failed documents and for rejected hosts.

    The verdict table is written first, so Catalyst knows its size: it is broadcast only below
    spark.sql.autoBroadcastJoinThreshold; beyond, a sort-merge join whose hot hosts adaptive execution splits.
    """
    verdicts = written(host_verdicts(stats, host), "hosts").withColumnRenamed(host, "_host")
    return (
        stats.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))
        .drop("_host")
    )


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, kept, and of the host its documents and failures by rule; one row for each row of docs."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    stats = written(measured(slim).drop("text"), "stats")
    return judged(stats, "host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", *(f"host_{r}" for r in RULES)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of docs.

    Texts are measured twice, for the hosts and for themselves, as a second pass costs less than a shuffle of all texts;
    only the rejected hosts are joined. Failed documents go by a generator that makes no row of them: a filter on
    base_failed would be pushed into the projections of measured() and evaluate the words again for every window.
    """
    stats = measured(docs.select("text", F.col("source").alias("host"))).drop("text")
    bad = written(host_verdicts(stats, "host").where("host_rejected").select(F.col("host").alias("bad_host")), "rejected_hosts")
    rows = measured(apart(docs).withColumn("host", F.col("_row.source"))).select("_row", "host", "base_failed")
    kept = rows.select("_row", "host", F.explode(F.when(F.col("base_failed"), F.expr("cast(array() as array<int>)")).otherwise(F.array(F.lit(1)))))
    return restored(kept.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti"), docs.columns)
