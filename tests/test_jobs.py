import os
import random
import time

import pytest
from pyspark.sql import functions as F

from attesta.operators import activity
from attesta.plans import jobs, pipeline
from tests import build


def test_store():
    store = jobs.JobStore()
    store.create("a")
    for status in ("complete", "running", "error"):
        with pytest.raises(jobs.IllegalTransition):
            store.transition("a", status)
    with pytest.raises(ValueError, match="pending"):
        store.transition("a", "pending")
    with pytest.raises(TypeError):
        store.update("a", "pending", x=1)
    store.transition("a", "queued")
    store.transition("a", "running", phase="parsing")
    assert not store.update("a", ("running",), {"phase": "parsed"}, x=1) and store.update("a", ("running",), {"phase": "parsing"}, x=1)
    with pytest.raises(ValueError, match="transition"):
        store.update("a", ("running",), status="complete")
    assert store.transition("a", "complete")["version"] == 5
    for status in ("running", "cancelled", "error"):
        with pytest.raises(jobs.IllegalTransition):
            store.transition("a", status)


def test_job_runs(spark, tmp_path):
    (tmp_path / "x.xml").write_text(build.results())
    run = jobs.Jobs(spark)
    run.store.create("j")
    assert run.parse("j", [str(tmp_path / "x.xml")], [], str(tmp_path / "f")) and run.parse("j", [], [], "")
    assert run.store.get("j")["summary"]["findings"] == 1
    assert run.export("j", str(tmp_path / "r.xlsx")) and run.export("j", "") and (tmp_path / "r.xlsx").exists()
    assert run.store.get("j")["status"] == "complete" and run.cancel("j") == "complete"


def test_errors_become_fields(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<a")
    run = jobs.Jobs(spark)
    run.store.create("j")
    assert not run.parse("j", [str(tmp_path / "x.xml")], [], str(tmp_path / "f"))
    assert run.store.get("j")["status"] == "error" and run.store.get("j")["error"] == "None of the results files could be read."
    run.store.create("k")
    assert run.cancel("k") == "cancelled" and not run.export("k", "")


EDGES = {("pending", "queued"), ("pending", "cancelled"), ("queued", "running"), ("queued", "error"), ("queued", "cancelled"), ("running", "complete"), ("running", "error"), ("running", "cancelled")}


def test_legal_edges(spark):
    names = ["pending", "queued", "running", "complete", "error", "cancelled"]
    rows = spark.createDataFrame([(a, b) for a in [None, *names] for b in names], "a string, b string")
    assert {(r["a"], r["b"]) for r in rows.where(activity.is_legal(F.col("a"), F.col("b"))).collect()} == EDGES | {(None, b) for b in names}


def hits(spark, rows):
    """i, client, seconds as events."""
    return spark.createDataFrame(rows, "i long, c string, s long").selectExpr("i", "c", "timestamp_seconds(s) as t")


def accepted(df, most, seconds, ranges=None):
    return {r["order_id"]: r["accepted"] for r in activity.rate_limited(df, "c", "t", "i", most, seconds, ranges).collect()}


def plain_limit(rows, most, seconds):
    held, out = {}, {}
    for i, c, s in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [t for t in held.get(c, []) if s - t < seconds]
        out[i] = len(own) < most
        held[c] = [*own, s] if out[i] else own
    return out


def test_rate_limit_counts_accepted_only(spark):
    rows = [(i, "a", s) for i, s in enumerate((0, 1, 2, 59))] + [(9, "a", 61), (10, "b", 0)]
    assert accepted(hits(spark, rows), 2, 60) == {0: True, 1: True, 2: False, 3: False, 9: True, 10: True}


def test_a_hit_as_old_as_the_window_is_free(spark):
    assert accepted(hits(spark, [(1, "a", 0), (2, "a", 60), (3, "a", 119), (4, "a", 120)]), 1, 60) == {1: True, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_rate_limit_over_ranges(spark, ranges):
    r = random.Random(ranges)
    rows = [(i, "busy" if i % 3 else r.choice(["a", "b", None]), r.choice([r.randrange(4000), 60 * r.randrange(70)])) for i in range(600)]
    assert accepted(hits(spark, rows), 2, 60, ranges) == plain_limit(rows, 2, 60)


def test_spells_of_a_busy_client_are_many_tasks(spark):
    """A client with nearly all rows: no range and no spell holds more than a part of them, and spells go on over ranges."""
    rows = [(i, "busy", 100 * (i // 50) + i % 50) for i in range(2000)] + [(5000 + i, f"c{i}", i) for i in range(20)]
    got = activity.spells(hits(spark, rows).selectExpr("c as client", "t as ts", "i as order_id"), 51, 8)
    sizes = [r["count"] for r in got.groupBy("spell").count().collect()]
    assert len(sizes) == 40 + 20 and max(sizes) == 50
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 1000
    endless = activity.spells(hits(spark, rows).selectExpr("c as client", "t as ts", "i as order_id"), 10_000, 8)
    assert endless.where("client = 'busy'").select("spell").distinct().count() == 1


def test_rate_limit_starts_anew_after_a_gap(spark):
    rows = [(i, "a", 60 * m + s) for i, (m, s) in enumerate((m, s) for m in range(0, 30, 3) for s in (0, 1, 2))]
    assert accepted(hits(spark, rows), 2, 60) == {i: i % 3 < 2 for i, *_ in rows}


def test_expiry_needs_an_idle_job(spark):
    rows = spark.createDataFrame([(i, s, h) for h in (7, 8, 9) for i, s in enumerate([None, "", "pending", "queued", "running", "complete", "error", "cancelled"])], "i int, status string, h int")
    old = activity.expired(rows.selectExpr("*", "timestamp_seconds(-3600 * h) as t"), "t", F.timestamp_seconds(F.lit(0)), "status")
    assert {(r["h"], r["i"]) for r in old.collect()} == {(9, i) for i in (0, 1, 5, 6, 7)}


def test_conditional_writes():
    store = jobs.JobStore()
    store.create("a", n=0)

    def meanwhile(job):
        if job["n"] < 2:
            store.update("a", ("pending",), n=job["n"] + 1)
        return {"n": job["n"] + 10}

    assert store.changed("a", meanwhile)["n"] == 12 and store.changed("none", dict) is None
    with pytest.raises(jobs.Conflict):
        store.changed("a", lambda job: store.update("a", ("pending",), n=job["n"] + 1) and {"x": 1}, tries=3)
    with pytest.raises(ValueError, match="transition"):
        store.changed("a", lambda _: {"status": "complete"})
    store.transition("a", "cancelled")
    assert store.changed("a", lambda _: {"n": 1}) is None


def test_sweep(spark, tmp_path):
    now = [0.0]
    run = jobs.Jobs(spark, jobs.JobStore(lambda: now[0]))
    (tmp_path / "x.xml").write_text(build.results())
    run.store.create("old")
    assert run.parse("old", [str(tmp_path / "x.xml")], [], str(tmp_path / "f"))
    assert run.store.get("old")["files_done"] == run.store.get("old")["files"] == 1
    now[0] = 9 * 3600
    # a job that still runs stays, however long ago it was touched
    assert run.sweep() == [] and (tmp_path / "f").exists()
    assert run.export("old", str(tmp_path / "r.xlsx"))
    now[0] = 14 * 3600
    run.store.create("young")
    assert run.sweep() == [] and (tmp_path / "f").exists()
    now[0] = 18 * 3600
    assert run.sweep() == ["old"] and not (tmp_path / "f").exists() and run.store.get("old") is None and run.store.get("young")


def test_folders_without_a_live_job_go(spark, tmp_path):
    run = jobs.Jobs(spark)
    for name, status in (("runs", "running"), ("waits", "pending"), ("done", "cancelled"), ("fresh-done", "cancelled")):
        run.store.create(name)
        if status != "pending":
            for step in ("queued", "running") if status == "running" else (status,):
                run.store.transition(name, step)
    stale = time.time() - 9 * 3600
    for name in ("runs", "waits", "done", "fresh-done", "orphan", "fresh-orphan", "mixed"):
        (tmp_path / name / "deep").mkdir(parents=True)
        for f in ("a.xml", "deep/b.xml"):
            (tmp_path / name / f).write_text("x")
            if not name.startswith("fresh") and (name, f) != ("mixed", "deep/b.xml"):
                os.utime(tmp_path / name / f, (stale, stale))
    (tmp_path / "loose.xml").write_text("x")
    assert run.sweep_folder(str(tmp_path)) == ["done", "orphan"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["fresh-done", "fresh-orphan", "loose.xml", "mixed", "runs", "waits"]


def test_report_names():
    from datetime import datetime

    assert pipeline.report_name("delta", datetime(2024, 3, 5, 7, 8, 9)) == "stig_delta_20240305_070809.xlsx"
