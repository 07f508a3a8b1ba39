"""Queries that end when they are no longer wanted."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """A newer query of the channel, or the deadline, ended this one."""


class Channel:
    """The queries of one reader, of whom only the newest is waited for."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock = spark, threading.Lock()
        self._newest, self._tag = -1, None

    def run(self, sequence: int, work: Callable, seconds: float | None = None):
        """The result of work(); the jobs of an older query, and this one's beyond its deadline, are interrupted.

        A query that comes after one with a higher sequence does not begin.
        """
        tag, late = f"channel-{uuid.uuid4().hex}", threading.Event()
        with self._lock:
            if sequence <= self._newest:
                raise Cancelled(f"query {sequence} comes after query {self._newest}")
            older, self._newest, self._tag = self._tag, sequence, tag
        if older is not None:
            self.spark.sparkContext.cancelJobsWithTag(older)

        def expire():
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, expire) if seconds is not None else None
        self.spark.sparkContext.addJobTag(tag)
        if timer:
            timer.start()
        try:
            result = work()
        except Exception as e:
            if late.is_set() or self._newest > sequence:
                raise Cancelled(f"query {sequence} was ended") from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(tag)
            if timer:
                timer.cancel()
            with self._lock:
                if self._tag == tag:
                    self._tag = None
        if late.is_set() or self._newest > sequence:
            raise Cancelled(f"query {sequence} was ended")
        return result
