"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.plans.tables import scope, shared_dir, written

__all__ = ["LOWER", "NO_ID", "UPPER", "WHITE", "WORD", "apart", "ascii_lower", "keyed", "parted", "restored", "scope", "shared_dir", "table", "whole", "words", "written"]

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id in join keys.
NO_ID = -(2**63)
#: Bits of the marks in parted(), 8 MB at most whatever they are made from, and the bits of one bitmap of Spark's.
MARKS, BITMAP = 2**26, 2**15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and (_id, _th), the key of a row: rows that agree in both are repeats of one another."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), whole(text).alias("text"), F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("_id"), F.xxhash64(whole(text)).alias("_th")
    )


def apart(docs: DataFrame) -> DataFrame:
    """_row (all columns of docs), _id, _th and text: rows to work on beside columns of any name."""
    return docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64(whole("text")).alias("_th"), whole("text").alias("text"))


def restored(df: DataFrame, columns: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of _row under their names, those in new replaced."""
    return df.select(*((new or {}).get(c, F.col("_row").getField(c)).alias(c) for c in columns))


def parted(rows: DataFrame, few: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys, (_id, _th) if none are named, may occur in few, and those whose don't for sure: only the first need a join with few, so no shuffle has the others.

    Hashes of few's keys are marked in bitmaps, a summary of a fixed size that is broadcast. The more keys, the more rows count as possible; none is lost.
    """
    mark = F.pmod(F.xxhash64(*(keys or ("_id", "_th"))), F.lit(MARKS))
    marks = few.select(mark.alias("_mark")).select(F.floor(F.col("_mark") / BITMAP).alias("_map"), (F.col("_mark") % BITMAP).alias("_bit"))
    marks = written(marks.repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "marks")
    held = rows.withColumn("_mark", mark).join(F.broadcast(marks), F.floor(F.col("_mark") / BITMAP) == F.col("_map"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_mark % {BITMAP} / 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = F.coalesce(F.expr("shiftleft(1, cast(_mark % 8 as int))").bitwiseAND(byte) > 0, F.lit(False))
    return held.where(marked).select(*rows.columns), held.where(~marked).select(*rows.columns)
