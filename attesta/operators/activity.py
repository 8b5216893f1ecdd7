"""Rate limits, job lifecycles and expiry over event relations."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.plans.tables import written

#: The lifecycle of a job.
TERMINAL = ("complete", "error", "cancelled")
LEGAL = {"pending": ("queued", "cancelled"), "queued": ("running", "error", "cancelled"), "running": ("complete", "error", "cancelled")}


def spells(rows: DataFrame, seconds: int, ranges: int | None = None) -> DataFrame:
    """rows (client, ts, order_id) with spell: the number of the stretch of a client's events in which none is `seconds` or more after the one before.

    Events are dealt into ranges of (client, ts), so a client of any size is many ranges. Pauses are found within each range; of
    a range only its first and last event and its number of spells meet those of the others, one row for each range. A spell
    that goes on in the next range keeps its number there.
    """
    order = ("client", "ts", "order_id")
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "event_ranges")
    paused = lambda client, ts, client_before, ts_before: ~client.eqNullSafe(client_before) | (ts - ts_before >= F.expr(f"interval {seconds} seconds"))
    own = Window.partitionBy("range").orderBy(*order)
    begins = F.row_number().over(own) == 1
    begins = begins | paused(F.col("client"), F.col("ts"), F.lag("client").over(own), F.lag("ts").over(own))
    # the first event of a range counts as a begin here, whether it is one or not
    local = dealt.withColumn("begins", begins.cast("long")).withColumn("local", F.sum("begins").over(own)).drop("begins")
    at = F.struct(*order)
    edges = local.groupBy("range").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max("local").alias("n"))
    along = Window.orderBy("range")
    before = F.lag("last").over(along)
    goes_on = (F.row_number().over(along) > 1) & ~paused(F.col("first.client"), F.col("first.ts"), before["client"], before["ts"])
    edges = edges.withColumn("goes_on", goes_on.cast("long")).select("range", (F.sum(F.col("n") - F.col("goes_on")).over(along) - F.col("n")).alias("offset"))
    # one row for each range
    return local.join(F.broadcast(edges), "range").withColumn("spell", F.col("offset") + F.col("local")).drop("range", "offset", "local")


def rate_limited(events: DataFrame, client: str, ts: str, order: str, most: int = 10, seconds: int = 60, ranges: int | None = None) -> DataFrame:
    """order, client and accepted: a client's event passes if fewer than `most` accepted ones lie less than `seconds` before it.

    What is accepted depends on what was, so frames can't say it, and a walk in order must. After a pause of the window's
    length nothing is held, so spells between pauses are walked on their own: a busy client is one task only as long as it
    never pauses. A walk streams through its rows and holds the last accepted times, at most `most` of them.
    """
    window = seconds * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for batch in batches:
            out = []
            for spell, at in zip(batch["spell"].tolist(), batch["us"].tolist(), strict=True):
                if spell != now:
                    now, held = spell, deque()
                while held and at - held[0] >= window:
                    held.popleft()
                out.append(len(held) < most)
                if out[-1]:
                    held.append(at)
            yield pd.DataFrame({"order_id": batch["order_id"], "client": batch["client"], "accepted": out})

    rows = events.select(F.col(order).alias("order_id"), F.col(client).alias("client"), F.col(ts).cast("timestamp_ntz").alias("ts"))
    dealt = spells(rows, seconds, ranges).repartition("spell").sortWithinPartitions("spell", "ts", "order_id")
    dealt = dealt.select("order_id", "client", "spell", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    kinds = dict(rows.dtypes)
    return dealt.mapInPandas(walk, f"order_id {kinds['order_id']}, client {kinds['client']}, accepted boolean")


def transitions(events: DataFrame, job: str, status: str, order: list[str]) -> DataFrame:
    """Adds previous: the status before, null for the first."""
    return events.withColumn("previous", F.lag(status).over(Window.partitionBy(job).orderBy(*order)))


def is_legal(before: Column, after: Column) -> Column:
    """Whether a job may go from one status to another; terminal ones are final, a first status may be anything."""
    out = before.isNull()
    for status, nexts in LEGAL.items():
        out = out | ((before == status) & after.isin(*nexts))
    return out


def is_idle(status: Column) -> Column:
    """Whether nobody works on a job any more: its status is terminal, or there is none, as for what an earlier process left."""
    return F.coalesce(status, F.lit("")).isin("", *TERMINAL)


def expired(events: DataFrame, ts: str, now: Column, status: str, hours: int = 8) -> DataFrame:
    """Rows from before the last hours whose job nobody works on."""
    return events.where((F.col(ts) < now - F.expr(f"interval {hours} hours")) & is_idle(F.col(status)))


def swept(listing: DataFrame, jobs: DataFrame, root: str, now: Column, hours: int = 8) -> DataFrame:
    """job, files, modified of the folders below root that may go: the newest file is older than the hours, and no live job has the folder's name.

    listing: path, modificationTime of files, as binaryFile lists them; jobs: job, status. A folder is as old as its newest
    file, so a job that still writes keeps it, and one that doesn't keeps it too while its status isn't terminal.
    """
    below = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    top = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    inside = listing.where(below.startswith(top)).select(F.split(F.substring(below, F.lit(len(top) + 1), F.length(below)), "/").alias("parts"), "modificationTime")
    folders = inside.where(F.size("parts") > 1).groupBy(F.col("parts")[0].alias("job")).agg(F.count("*").alias("files"), F.max("modificationTime").alias("modified"))
    old = folders.where(F.col("modified") < now - F.expr(f"interval {hours} hours"))
    return old.join(jobs.where(~is_idle(F.col("status"))).select("job"), "job", "left_anti")
