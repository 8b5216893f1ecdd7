"""Additions for streams: scan files that arrive in a folder, and rate limits over arriving events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attesta.sources import scanset


def records(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """The records of results files as they arrive; scanset.split() takes them apart.

    A file's ordinal is a hash of its path: arrival has no order that a restart would repeat.
    """
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = files.select("path", "content", F.xxhash64("path").alias("file_ord"), F.lit(True).alias("as_results"), F.lit(True).alias("as_benchmark"))
    return files.mapInPandas(scanset.parse_batches, scanset.RECORDS)


def arrivals_by_status(spark: SparkSession, folder: str) -> DataFrame:
    """Running counts of results by source file and raw status."""
    rows = records(spark, folder).where("role = 'results' and kind in ('result', 'cklb', 'nessus')")
    status = F.when(F.col("kind") == "result", F.col("v1")).otherwise(F.col("v3"))
    return rows.groupBy(F.col("kind"), status.alias("raw_status")).agg(F.count("*").alias("n"))


def rate_limited(events: DataFrame, most: int = 10, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """client, ts, accepted for a stream (client string, ts timestamp); state per client is its accepted times in the window, `most` at most.

    Events are judged in time order within a batch; those behind the watermark are dropped, and idle clients are forgotten.
    """
    window = pd.Timedelta(seconds=seconds)

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        held = [pd.Timestamp(t) for t in (state.get[0] if state.exists else [])]
        accepted = []
        for at in rows["ts"]:
            held = [t for t in held if at - t < window]
            accepted.append(len(held) < most)
            if accepted[-1]:
                held.append(at)
        state.update(([t.isoformat() for t in held],))
        last = int(rows["ts"].max().timestamp() * 1000) + seconds * 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "ts": rows["ts"], "accepted": accepted})

    marked = events.withWatermark("ts", lateness)
    return marked.groupBy("client").applyInPandasWithState(walk, "client string, ts timestamp, accepted boolean", "held array<string>", "append", GroupStateTimeout.EventTimeTimeout)
