"""The latest request wins: each channel of a user interface has one query at a time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from missive.functions.display import retry_delay


class Channels:
    """``run(channel, work)`` stops the channel's earlier query by its job tag, and gives None
    for a result that a later request has overtaken."""

    def __init__(self, spark: SparkSession):
        self.spark, self.lock, self.latest = spark, threading.Lock(), {}

    def issue(self, channel: str) -> str:
        with self.lock:
            before, self.latest[channel] = self.latest.get(channel), f"{channel}-{uuid.uuid4().hex}"
        if before:
            self.spark.interruptTag(before)
        return self.latest[channel]

    def current(self, channel: str, tag: str) -> bool:
        return self.latest.get(channel) == tag

    def run(self, channel: str, work: Callable[[], Any]) -> Any:
        tag = self.issue(channel)
        self.spark.addTag(tag)
        try:
            out = work()
        except Exception:
            if self.current(channel, tag):
                raise
            return None
        finally:
            self.spark.removeTag(tag)
        return out if self.current(channel, tag) else None

    def cancel(self, channel: str) -> None:
        with self.lock:
            before = self.latest.pop(channel, None)
        if before:
            self.spark.interruptTag(before)


class Transient(Exception):
    """A failure that may go away."""


def with_retry(work: Callable[[], Any], retries: int = 3, base: float = 1.0, stopped: threading.Event | None = None) -> Any:
    """``work()``, tried again after transient failures with waits that double; ``stopped`` ends a wait at once."""
    if retries < 0 or base < 0:
        raise ValueError("retries and base are not negative")
    stopped = stopped or threading.Event()
    for attempt in range(retries + 1):
        if stopped.is_set():
            raise InterruptedError("stopped")
        try:
            return work()
        except Transient:
            if attempt == retries:
                raise
        stopped.wait(retry_delay(base, attempt))
    return None
