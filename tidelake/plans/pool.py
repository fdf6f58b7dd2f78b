"""Spark jobs side by side under a limit they share, such as a source's connections."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

POOL = "tidelake"


class Job(NamedTuple):
    """What to run, and how much of the limit it takes while it runs."""

    weight: int
    run: Callable[[], None]


class Shared:
    """A limit that running jobs share; who came first is served first, so a heavy job is not passed over for ever."""

    def __init__(self, limit: int):
        self.limit = max(limit, 1)
        self.free, self.highest = self.limit, 0
        self._turn, self._next = 0, 0
        self._changed = threading.Condition()

    @contextmanager
    def held(self, weight: int) -> Iterator[None]:
        weight = min(max(weight, 1), self.limit)
        with self._changed:
            mine, self._next = self._next, self._next + 1
            self._changed.wait_for(lambda: self._turn == mine and self.free >= weight)
            self.free -= weight
            self.highest = max(self.highest, self.limit - self.free)
            self._turn += 1
            self._changed.notify_all()
        try:
            yield
        finally:
            with self._changed:
                self.free += weight
                self._changed.notify_all()


def run_jobs(spark: SparkSession, jobs: Sequence[Job], limit: int) -> Shared:
    """Run all jobs, as many at once as their weights allow within ``limit``.

    Each is submitted from a thread of its own in one scheduler pool: under a
    fair scheduler the jobs share the executors evenly, else the first get
    theirs first. When one fails, those running end, no other starts, and the
    failure is raised.
    """
    shared, stop = Shared(limit), threading.Event()
    if not jobs:
        return shared

    def one(job: Job) -> None:
        with shared.held(job.weight):
            if stop.is_set():
                return
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", POOL)
            try:
                job.run()
            except BaseException:
                stop.set()
                raise

    with ThreadPoolExecutor(min(len(jobs), shared.limit), thread_name_prefix=POOL) as threads:
        waiting = [threads.submit(inheritable_thread_target(spark)(one), job) for job in jobs]
    for done in waiting:
        done.result()
    return shared
