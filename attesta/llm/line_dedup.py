"""Lines that many documents share.

Eligible lines are exploded as (row key, position, 128-bit key hash); documents are counted per hash; frequent hashes
go back to their positions; each text is rebuilt from the positions that stay.

Defined cases: null text is one empty line; a null doc_id counts as no document and keeps no frequent line; rows with
one doc_id count as one document, each is rebuilt on its own; repeated rows are each returned; the largest doc_id
that holds a key keeps all its lines of that key, so ties of counts need no choice; a text of any length is split whole;
other columns of any name play no part (rewrite passes them through); -2**63 counts as a null doc_id in keys; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import WHITE, apart, ascii_lower, keyed, parted, restored, whole, written

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """_id, _th and the positions of the lines to drop, for the rows that lose any."""
    lines = (
        docs.select("doc_id", "_id", "_th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "_id", "_th", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))
    )
    # one row for each key and document before documents are counted, so a key in a third of all documents is spread
    frequent = lines.where(F.col("doc_id").isNotNull()).groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    frequent = written(frequent.where(F.col("n") >= min_docs).select("h1", "h2", "last"), "frequent_lines")
    gone = lines.join(frequent, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return written(gone.groupBy("_id", "_th").agg(F.collect_set("pos").alias("gone")), "dropped_lines")


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, _id, _th, text (as it was), n_lines, n_dropped and kept_text, one row for each row of docs."""
    rows = keyed(docs)
    gone = shared_lines(rows, min_chars, min_docs)
    df = rows.join(gone, ["_id", "_th"], "left").withColumn("_l", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("gone"))
    df = df.withColumn("_stay", F.when(F.col("gone").isNotNull(), stay))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.element_at("_l", i + 1)), "\n"))
    return df.select(
        "doc_id", "_id", "_th", "text", F.size("_l").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text")
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    return drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def rewrite(docs: DataFrame) -> DataFrame:
    """The documents with their kept text and its length, in the columns of docs; only those that lose a line are shuffled, each with one text."""
    gone = shared_lines(keyed(docs), MIN_CHARS, MIN_DOCS)
    some, rest = parted(apart(docs).drop("text"), gone)
    df = some.join(gone, ["_id", "_th"], "left").withColumn("_l", F.split(whole("_row.text"), "\n", -1))
    df = df.withColumn("_stay", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("gone"))))
    df = df.withColumn("_kept", F.when(F.col("gone").isNotNull(), F.array_join(F.transform("_stay", lambda i: F.element_at("_l", i + 1)), "\n")))
    changed = lambda new, c: F.when(F.col("gone").isNull(), F.col(f"_row.{c}")).otherwise(new)
    df = restored(df, docs.columns, {"text": changed(F.col("_kept"), "text")} | ({"n_chars": changed(F.length("_kept").cast("long"), "n_chars")} if "n_chars" in docs.columns else {}))
    return df.union(restored(rest, docs.columns))
