"""Actions on their own thread, with a Spark job group by which they are cancelled, and a state to poll."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class JobState(Enum):
    RUNNING = "running"
    DONE = "done"
    CANCELLED = "cancelled"
    FAILED = "failed"


@dataclass(frozen=True)
class Status:
    state: JobState
    progress: float  #: share of the group's tasks that are done, 1 at the end
    result: Any = None
    error: BaseException | None = None


class Job:
    def __init__(self, spark: SparkSession, action: Callable[[], Any], name: str = "tabulon") -> None:
        self.spark, self.group = spark, f"{name}-{uuid.uuid4().hex}"
        self._state, self._result, self._error = JobState.RUNNING, None, None
        self._lock = threading.Lock()

        def run() -> None:
            spark.sparkContext.setJobGroup(self.group, name, interruptOnCancel=True)
            try:
                result, error = action(), None
            except Exception as e:  # whatever the action raises is the job's outcome
                result, error = None, e
            with self._lock:
                if self._state is JobState.RUNNING:
                    self._state, self._result, self._error = (JobState.FAILED if error else JobState.DONE), result, error

        self._thread = threading.Thread(target=inheritable_thread_target(run), daemon=True)
        self._thread.start()

    def poll(self) -> Status:
        with self._lock:
            state, result, error = self._state, self._result, self._error
        return Status(state, 1.0 if state is JobState.DONE else self._progress(), result, error)

    def _progress(self) -> float:
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        return done / total if total else 0.0

    def cancel(self) -> None:
        """Nothing the job still does changes its outcome."""
        with self._lock:
            if self._state is not JobState.RUNNING:
                return
            self._state = JobState.CANCELLED
        self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, timeout: float | None = None) -> Status:
        self._thread.join(timeout)
        return self.poll()


class SortAction(Enum):
    ASCENDING = "ascending"
    DESCENDING = "descending"
    CLEAR = "clear"
    RETRY = "retry"


def next_sort(current: int | None, descending: bool, clicked: int, state: JobState = JobState.DONE) -> SortAction:
    """What another click on a column's header asks for: ascending, descending, none; a failed sort again, a running one off."""
    if current != clicked:
        return SortAction.ASCENDING
    if state is JobState.FAILED:
        return SortAction.RETRY
    if state is JobState.RUNNING or descending:
        return SortAction.CLEAR
    return SortAction.DESCENDING


def jump_field(text: str) -> int | None:
    """A 1-based row number as typed: ASCII digits only, at least 1, below 2**64; the row from 0."""
    if not text.isascii() or not text.isdigit() or not 1 <= int(text) < 1 << 64:
        return None
    return int(text) - 1


def header_shift(before: bool, after: bool) -> int:
    """By how much rows move when the header is switched."""
    return (not after) - (not before)
