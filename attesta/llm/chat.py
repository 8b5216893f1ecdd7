"""Logged conversations: snapshots that a longer conversation continues are collapsed before rendering.

A conversation logged after every turn appears many times, each time a little longer. The rolling hash of its first
turns is a prefix sum of per-turn hashes (128 bits in four 32-bit lanes, each turn hashed with its position), so it's
computed by windows over blocks of BLOCK turns and over block totals. Positions come from ranges of the ordered turns and
their counts. So no task gathers a whole conversation, also none whose turns all share one number.
An anti-join of whole-conversation hashes against the proper prefixes leaves the maximal conversations.

Defined cases: turns are ordered by turn, then role, then text, which settles ties; a repeated row (same conv_id, turn, role,
text) counts once; null role or text is empty; a text of any length is rendered whole; a null conv_id or turn leaves the row
out, as it can't be placed; equal conversations keep the smallest conv_id; other columns of any name play no part; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import written

BLOCK = 512
#: Turns in a rendered part, so that no row grows without bound.
PART = 256
LANES = ("h0", "h1", "h2", "h3")


def _sums(w) -> list[Column]:  # noqa: ANN001
    return [F.sum(c).over(w).alias(c) for c in LANES]


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos (from 1) of the distinct turns, by ranges of the order and the counts of each conversation in them."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).distinct()
    # the start of a text keeps the order, and bounds of ranges stay small
    rows = rows.withColumn("_start", F.left("text", F.lit(64))).repartitionByRange("conv_id", "turn", "role", "_start").withColumn("part", F.spark_partition_id())
    rows = written(rows.drop("_start"), "ranges")
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    return rows.withColumn("pos", F.row_number().over(inside).cast("long")).join(starts, ["conv_id", "part"]).select(
        "conv_id", "turn", "role", "text", (F.col("pos") + F.col("before")).alias("pos")
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos and h0 to h3: the hash of the first pos turns."""
    a, b = F.xxhash64(F.lit(1), "pos", "role", "text"), F.xxhash64(F.lit(2), "pos", "role", "text")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    hashed = turns.select("conv_id", "pos", F.floor(F.col("pos") / BLOCK).alias("blk"), low(a).alias("h0"), F.shiftrightunsigned(a, 32).alias("h1"), low(b).alias("h2"), F.shiftrightunsigned(b, 32).alias("h3"))
    totals = hashed.groupBy("conv_id", "blk").agg(*(F.sum(c).alias(c) for c in LANES))
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv_id", "blk", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in LANES))
    inside = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("conv_id", "blk", "pos", *_sums(inside))
    return running.join(starts, ["conv_id", "blk"]).select("conv_id", "pos", *((F.col(c) + F.col(f"{c}_0")).alias(c) for c in LANES))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay, and n_same: how many conversations have those very turns."""
    rolling = written(prefixes(turns), "prefixes")
    lengths = rolling.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    marked = rolling.join(lengths, "conv_id")
    key = ["pos", *LANES]
    # copies collapse on the map side, so a conversation or first turn in a third of all rows is one key, one row per task
    ends = marked.where(F.col("pos") == F.col("n_turns")).groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    inner = marked.where(F.col("pos") < F.col("n_turns")).select(*key).distinct()
    return ends.join(inner, key, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_same")


def rendered(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_same and text: the kept conversations in parts of at most PART turns."""
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    parts = turns.select("conv_id", F.floor((F.col("pos") - 1) / PART).alias("part"), "pos", line.alias("line")).join(kept, "conv_id")
    out = parts.groupBy("conv_id", "part", "n_turns", "n_same").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return out.select("conv_id", "part", "n_turns", "n_same", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


def chat_format(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_same, n_chars and rendered_sha256 of the maximal conversations."""
    rows = written(placed(turns), "turns")
    kept = written(maximal(rows), "maximal")
    return rendered(rows, kept).select("conv_id", "part", "n_turns", "n_same", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("rendered_sha256"))
