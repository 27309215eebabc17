"""Long calls as jobs: stage timings, progress, cancellation."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class StageTimes:
    """Seconds by named stage, in order."""

    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start


class Job:
    """A call in its own thread and job group; its Spark stages show the progress, and it can be cancelled."""

    def __init__(self, spark: SparkSession, call: Callable[[], Any]) -> None:
        self.spark, self.group = spark, f"cairnlog-{uuid.uuid4().hex[:12]}"
        self.result: Any = None
        self.error: BaseException | None = None
        self.cancelled = False
        self._thread = threading.Thread(target=self._run, args=(call,), daemon=True)
        self._thread.start()

    def _run(self, call: Callable[[], Any]) -> None:
        self.spark.sparkContext.setJobGroup(self.group, "cairnlog", interruptOnCancel=True)
        try:
            self.result = call()
        except BaseException as e:  # noqa: BLE001
            self.error = e

    def progress(self) -> dict[str, int]:
        """Tasks done and tasks known of the group's running jobs."""
        tracker = self.spark.sparkContext.statusTracker()
        done = known = 0
        for j in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(j)
            for s in info.stageIds if info else ():
                stage = tracker.getStageInfo(s)
                if stage:
                    done, known = done + stage.numCompletedTasks, known + stage.numTasks
        return {"done": done, "known": known, "running": int(self._thread.is_alive())}

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, timeout: float | None = None) -> Any:
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.group)
        if self.error is not None and self.cancelled:
            raise RuntimeError("cancelled") from self.error
        if self.error is not None:
            raise self.error
        return self.result
