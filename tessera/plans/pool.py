"""Jobs of two priorities on one session: critical ones start before background ones.

Work runs on Spark's executors; a driver thread only submits it, in a scheduler pool
named for its priority.
"""

from __future__ import annotations

import importlib
import itertools
import os
import queue
import threading
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import DataFrame, SparkSession

PRIORITIES = ("critical", "background")


class WorkerPool:
    def __init__(self, spark: SparkSession, size: int | None = None):
        self.spark, self.size = spark, size or max(2, (os.cpu_count() or 1) - 1)
        self._jobs: queue.PriorityQueue = queue.PriorityQueue()
        self._number, self._open = itertools.count(), True
        self._threads = [threading.Thread(target=self._work, daemon=True) for _ in range(self.size)]
        for t in self._threads:
            t.start()

    def submit(self, task: Callable[..., Any] | str, *args: Any, priority: str = "background") -> Future:
        """Run a function, or `module:function`; a task that fails fails its own future only."""
        if priority not in PRIORITIES:
            raise ValueError(f"unknown priority {priority!r}")
        if not self._open:
            raise RuntimeError("the pool is terminated")
        done: Future = Future()
        self._jobs.put((PRIORITIES.index(priority), next(self._number), task, args, done))
        return done

    @property
    def queue_depth(self) -> int:
        return self._jobs.qsize()

    def _work(self) -> None:
        while True:
            level, _, task, args, done = self._jobs.get()
            if task is None:
                return
            if not done.set_running_or_notify_cancel():
                continue
            try:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", PRIORITIES[level])
                if isinstance(task, str):
                    module, name = task.split(":")
                    task = getattr(importlib.import_module(module), name)
                done.set_result(task(*args))
            except BaseException as e:  # noqa: BLE001
                done.set_exception(e)

    def terminate(self) -> None:
        """Waiting jobs are cancelled, running ones end."""
        self._open = False
        while True:
            try:
                job = self._jobs.get_nowait()
            except queue.Empty:
                break
            job[-1].cancel()
        for _ in self._threads:
            self._jobs.put((len(PRIORITIES), next(self._number), None, (), None))


def run_on_rows(df: DataFrame, module: str, function: str, schema: str) -> DataFrame:
    """A function of a module over a table's batches, on the executors: it takes and gives a pandas frame."""

    def work(frames):
        call = getattr(importlib.import_module(module), function)
        for frame in frames:
            yield call(frame)

    return df.mapInPandas(work, schema)
