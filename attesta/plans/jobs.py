"""Jobs on the driver: a store with legal, atomic transitions, and the stages that run under it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attesta.operators import rollups
from attesta.operators.activity import LEGAL, TERMINAL, swept
from attesta.plans import pipeline
from attesta.sinks import jsonfile, xlsx


class IllegalTransition(ValueError):
    """The job is in a status from which there is no way to the one asked for."""


class Cancelled(RuntimeError):
    """The job was cancelled while it ran."""


class Conflict(RuntimeError):
    """Other writers were faster each time."""


class JobStore:
    """Job records by id; every change happens under one lock, and a terminal job changes no more."""

    def __init__(self, clock: Callable[[], float] = time.time) -> None:
        self._jobs: dict[str, dict[str, Any]] = {}
        self._lock = threading.Lock()
        self._clock = clock

    def create(self, job_id: str, **fields: Any) -> dict[str, Any]:
        with self._lock:
            if job_id in self._jobs:
                raise ValueError(f"there is a job {job_id}")
            self._jobs[job_id] = {"status": "pending", "version": 1, "touched": self._clock(), **fields}
            return dict(self._jobs[job_id])

    def get(self, job_id: str) -> dict[str, Any] | None:
        with self._lock:
            return dict(self._jobs[job_id]) if job_id in self._jobs else None

    def transition(self, job_id: str, status: str, **fields: Any) -> dict[str, Any]:
        with self._lock:
            if status not in {s for nexts in LEGAL.values() for s in nexts}:
                raise ValueError(f"no job goes to {status}")
            job = self._jobs[job_id]
            if status not in LEGAL.get(job["status"], ()):
                raise IllegalTransition(f"{job['status']} -> {status}")
            job.update(fields, status=status, version=job["version"] + 1, touched=self._clock())
            return dict(job)

    def update(self, job_id: str, statuses: tuple[str, ...], expected: dict[str, Any] | None = None, **fields: Any) -> bool:
        """Sets fields if the job is in one of the statuses and has the expected values; the status itself only by transition()."""
        if isinstance(statuses, str):
            raise TypeError("statuses is a collection of statuses, not one")
        if "status" in fields:
            raise ValueError("a status changes by transition() only")
        with self._lock:
            job = self._jobs.get(job_id)
            if job is None or job["status"] not in statuses or any(job.get(k) != v for k, v in (expected or {}).items()):
                return False
            job.update(fields, version=job["version"] + 1, touched=self._clock())
            return True

    def changed(self, job_id: str, change: Callable[[dict[str, Any]], dict[str, Any] | None], tries: int = 8) -> dict[str, Any] | None:
        """A conditional write: change(job) gives the fields to set (none: leave it), which are set if the job's version is still the same.

        Another writer in between means another try on the newer version; after `tries` of them Conflict is raised.
        """
        for _ in range(tries):
            job = self.get(job_id)
            fields = None if job is None or job["status"] in TERMINAL else change(dict(job))
            if fields is None:
                return None
            if "status" in fields:
                raise ValueError("a status changes by transition() only")
            with self._lock:
                now = self._jobs.get(job_id)
                if now is not None and now["version"] == job["version"]:
                    now.update(fields, version=now["version"] + 1, touched=self._clock())
                    return dict(now)
        raise Conflict(f"job {job_id} changed {tries} times meanwhile")

    def statuses(self) -> list[tuple[str, str]]:
        """(job, status) of all jobs."""
        with self._lock:
            return [(i, j["status"]) for i, j in self._jobs.items()]

    def sweep(self, idle_hours: float = 8, drop: Callable[[dict[str, Any]], None] | None = None) -> list[str]:
        """Removes the ended jobs that nothing has touched for so long, none that still runs or waits; drop(job) removes what they have written. Their ids."""
        with self._lock:
            before = self._clock() - 3600 * idle_hours
            old = [(i, j) for i, j in self._jobs.items() if j["touched"] < before and j["status"] in TERMINAL]
            for i, _ in old:
                del self._jobs[i]
        for _, job in old:
            if drop is not None:
                drop(job)
        return [i for i, _ in old]


class Jobs:
    """Parse and export under a store; errors become fields of the job, a cancelled job's Spark work is interrupted."""

    def __init__(self, spark: SparkSession, store: JobStore | None = None):
        self.spark, self.store = spark, store or JobStore()

    def _check(self, job_id: str) -> None:
        if self.store.get(job_id)["status"] == "cancelled":
            raise Cancelled(job_id)

    def _drop(self, job: dict[str, Any]) -> None:
        for path in filter(None, (job.get("findings"), job.get("report"))):
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def sweep(self, idle_hours: float = 8) -> list[str]:
        """Removes ended jobs that were idle so long, with their findings and reports."""
        return self.store.sweep(idle_hours, self._drop)

    def sweep_folder(self, root: str, idle_hours: int = 8) -> list[str]:
        """Removes the job folders below root that are older, but for those of jobs that still run or wait; a folder without a job is what an earlier process left.

        Spark lists the folder; what goes comes to the driver folder by folder. A folder without files has nothing to remove.
        """
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
        jobs = self.spark.createDataFrame(self.store.statuses(), "job string, status string")
        gone = []
        for row in swept(files, jobs, root, F.current_timestamp(), idle_hours).select("job").toLocalIterator():
            # a job of that name may have begun meanwhile
            now = self.store.get(row["job"])
            if now is None or now["status"] in TERMINAL:
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, row["job"])
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
                gone.append(row["job"])
        return sorted(gone)

    def _guarded(self, job_id: str, work: Callable[[], dict[str, Any]]) -> bool:
        self.spark.addTag(f"job-{job_id}")
        try:
            fields = work()
        except Exception as e:  # a stage never raises: the job tells what happened
            told = getattr(e, "warnings", [])
            if self.store.get(job_id)["status"] not in TERMINAL:
                self.store.transition(job_id, "error", error=str(e), warnings=told)
            return False
        finally:
            self.spark.removeTag(f"job-{job_id}")
        return self.store.update(job_id, ("running",), **fields)

    def parse(self, job_id: str, results: list[str], benchmarks: list[str], target: str) -> bool:
        """Findings of the job as JSON lines in the folder target; done once, repeating it changes nothing."""
        job = self.store.get(job_id)
        if job["status"] in TERMINAL or job.get("phase") in ("parsed", "exporting"):
            return job.get("phase") in ("parsed", "exporting")
        if job["status"] == "pending":
            self.store.transition(job_id, "queued")
        if job["status"] != "running":
            self.store.transition(job_id, "running", phase="parsing")

        def work() -> dict[str, Any]:
            # who cancels a job interrupts its Spark work; between units it is told from the store
            parsed = pipeline.parse(self.spark, results, benchmarks, progress=lambda done, total: self.store.update(job_id, ("running",), files_done=done, files=total))
            self._check(job_id)
            jsonfile.write(parsed.findings.orderBy(*pipeline.ORDER), target)
            summary = rollups.run_summary(parsed.findings, parsed.source_files).first().asDict()
            return {"phase": "parsed", "findings": target, "summary": summary, "warnings": pipeline.first_lines(parsed.told(), pipeline.MOST_TOLD)}

        return self._guarded(job_id, work)

    def export(self, job_id: str, target: str) -> bool:
        """The job's workbook; overwrites what an earlier attempt left."""
        job = self.store.get(job_id)
        if job["status"] == "complete":
            return True
        if not self.store.update(job_id, ("running",), {"phase": "parsed"}, phase="exporting") and job.get("phase") != "exporting":
            return False

        def work() -> dict[str, Any]:
            rows = jsonfile.read(self.spark, job["findings"]).withColumn("row_ord", F.monotonically_increasing_id())
            paths, told = xlsx.write_report_volumes(rows, target, ["row_ord"])
            self._check(job_id)
            return {"report": target, "warnings": [*job.get("warnings", []), *told]} | ({"more_reports": paths[1:]} if len(paths) > 1 else {})

        if not self._guarded(job_id, work):
            return False
        self.store.transition(job_id, "complete", phase=None)
        return True

    def cancel(self, job_id: str) -> str:
        """The status that holds in the end: cancelled, unless the job had ended before."""
        try:
            self.store.transition(job_id, "cancelled")
            self.spark.interruptTag(f"job-{job_id}")
        except IllegalTransition:
            pass
        return self.store.get(job_id)["status"]
