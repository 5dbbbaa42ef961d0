"""Counts and rates of a conversion, observed while its one job runs."""

from __future__ import annotations

import sys
import threading
import time
from typing import TextIO

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandforge.functions.text import count, duration, rate


class Progress:
    """Wrap the records with ``watch`` and ask for the ``line`` after the write."""

    def __init__(self) -> None:
        self.observation, self.began = Observation("progress"), time.monotonic()

    def watch(self, records: DataFrame) -> DataFrame:
        return records.observe(self.observation, F.count_if(F.col("stage") >= 0).alias("records"))

    def line(self, items: int | None = None) -> str:
        n, seconds = self.observation.get["records"], time.monotonic() - self.began
        where = f" across {items} of {items} work items" if items else " unaligned"
        return f"[progress] Processed {count(n)} records{where} in {duration(seconds)} ({rate(n, seconds)}) (complete)"


class Status:
    """Prints a line each interval while a block of code runs Spark jobs: records and tasks of the stage that is at work.

    ``with Status(spark): ...``; the lines come from Spark's own counts, so nothing is added to the plan.
    """

    def __init__(self, spark: SparkSession, interval: float = 10.0, out: TextIO | None = None):
        self.spark, self.interval, self.out = spark, interval, out
        self.began, self.ended, self.said = time.monotonic(), threading.Event(), (-1, -1)
        self.thread = threading.Thread(target=self._run, daemon=True)

    def now(self) -> tuple[int, int, int, int] | None:
        """(stage, records it has read or written, tasks done, tasks) of the latest stage at work."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i]
        if not stages:
            return None
        at = max(stages, key=lambda i: i.stageId)
        data = self.spark.sparkContext._jsc.sc().statusStore().lastStageAttempt(at.stageId)
        return at.stageId, max(data.outputRecords(), data.shuffleReadRecords(), data.inputRecords()), at.numCompletedTasks, at.numTasks

    def line(self, records: int, done: int, tasks: int) -> str:
        seconds = time.monotonic() - self.began
        return f"[progress] Processed {count(records)} records across {done} of {tasks} work items in {duration(seconds)} ({rate(records, seconds)})"

    def _run(self) -> None:
        while not self.ended.wait(self.interval):
            try:
                seen = self.now()
            except Py4JJavaError:  # the stage ended in between, and its counts are gone
                continue
            if seen and seen[:2] > self.said:  # a later stage, or more records: lines never go back
                self.said = seen[:2]
                print(self.line(*seen[1:]), file=self.out or sys.stderr, flush=True)

    def __enter__(self) -> Status:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.ended.set()
        self.thread.join()
