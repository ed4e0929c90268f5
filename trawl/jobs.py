"""Long operations: started in the background, watched, cancelled, timed out."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class JobCancelled(RuntimeError):
    pass


class Job:
    """An operation in a thread of its own, all of whose Spark jobs are of one group.

        job = Job(spark, lambda: store.save(docs, path, fields))
        job.progress(); job.cancel(); index = job.result(timeout=3600)

    on_progress is called with progress() every `every` seconds while it runs, and once with 1.0 when it has succeeded.
    """

    def __init__(self, spark: SparkSession, work: Callable[[], object], name: str = "trawl", on_progress: Callable[[float], None] | None = None, every: float = 1.0):
        self.spark, self.group, self.on_progress, self.every = spark, f"{name}-{uuid.uuid4().hex}", on_progress, every
        self.cancelled, self.error, self.value = False, None, None
        self.done = threading.Event()

        def run() -> None:
            try:
                spark.sparkContext.setJobGroup(self.group, name, interruptOnCancel=True)
                if not self.cancelled:
                    self.value = work()
            except BaseException as e:  # handed on by result()
                self.error = e
            finally:
                self.done.set()

        self.thread = InheritableThread(target=run, daemon=True)
        self.thread.start()
        if on_progress is not None:
            threading.Thread(target=self._watch, daemon=True).start()

    def _watch(self) -> None:
        while not self.done.wait(self.every):
            self.on_progress(self.progress())
        if self.error is None and not self.cancelled:
            self.on_progress(1.0)

    def progress(self) -> float:
        """Tasks done over tasks known of the stages of the group that still run, 0 before and between them, 1 at the end."""
        if self.done.is_set():
            return 1.0
        tracker, done, total = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            for stage in (tracker.getJobInfo(job) or type("none", (), {"stageIds": ()})).stageIds:
                if info := tracker.getStageInfo(stage):
                    done, total = done + info.numCompletedTasks, total + info.numTasks
        return done / total if total else 0.0

    def cancel(self) -> None:
        """Running Spark jobs of the group end at once; result() then raises JobCancelled."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, timeout: float | None = None) -> bool:
        """Whether it has ended within so many seconds."""
        return self.done.wait(timeout)

    def result(self, timeout: float | None = None) -> object:
        """What the operation returns, or its error. Beyond the timeout it is cancelled and TimeoutError raised."""
        if not self.done.wait(timeout):
            self.cancel()
            raise TimeoutError(f"{self.group} took longer than {timeout} s")
        if self.cancelled:
            raise JobCancelled(self.group)
        if self.error is not None:
            raise self.error
        return self.value

