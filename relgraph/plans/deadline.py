"""Cancellation: the Spark jobs of a question end when its time is up."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..errors import Cancelled


@contextmanager
def deadline(spark: SparkSession, seconds: float = 0, event: threading.Event | None = None) -> Iterator[None]:
    """Run the block's jobs as one group, which is cancelled, with those still to come, after `seconds` (0: never) or when `event` is set."""
    if not seconds and event is None:
        yield
        return
    group, over, done = uuid.uuid4().hex, threading.Event(), threading.Event()
    sc = spark.sparkContext

    def watch() -> None:
        left = seconds or float("inf")
        while not done.wait(min(0.1, max(left, 0.01))):
            left -= 0.1
            if left <= 0 or event is not None and event.is_set():
                over.set()
                sc._jsc.sc().cancelJobGroupAndFutureJobs(group)
                return

    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(group, "a question with a deadline", True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise Cancelled("the question was cancelled") from e
        raise
    finally:
        done.set()
        watcher.join()
        for k, v in before.items():
            sc.setLocalProperty(k, v)
    if over.is_set():
        raise Cancelled("the question was cancelled")
