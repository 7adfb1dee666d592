"""One job at a time in the background: a second start is refused, a stop is asked for and, if need be, enforced."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from threading import Event, Lock

from pyspark.sql import SparkSession
from pyspark.util import InheritableThread


class Runner:
    """Runs a function of a stop question in a thread of its own; all Spark jobs that it starts carry the run's tag.

    ``stop`` sets a flag that the function asks about between its rounds, so that it ends in order and keeps what it has.
    ``interrupt`` ends the run's Spark jobs at once; the function then fails, and what it had written stays.
    A job that failed or was stopped never stands in the way of the next one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._stop = spark, Lock(), Event()
        self._thread: InheritableThread | None = None
        self.tag: str | None = None
        self.result = self.error = None

    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def start(self, job: Callable[[Callable[[], bool]], object]) -> bool:
        """Begins a job; False if one is still running."""
        with self._lock:
            if self.running():
                return False
            stop = self._stop = Event()  # a stop belongs to the job that it was meant for
            tag = self.tag = f"run-{uuid.uuid4().hex}"
            self.result = self.error = None

            def run() -> None:
                sc = self.spark.sparkContext
                sc.addJobTag(tag)
                sc.setInterruptOnCancel(True)
                try:
                    self.result = job(stop.is_set)
                except Exception as e:  # told by ``error``; nobody waits for the thread
                    self.error = e
                finally:
                    sc.removeJobTag(tag)

            self._thread = InheritableThread(target=run, session=self.spark)
            self._thread.daemon = True
            self._thread.start()
            return True

    def stop(self) -> bool:
        """Asks the running job to end; False if there is none."""
        if not self.running():
            return False
        self._stop.set()
        return True

    def interrupt(self) -> bool:
        """Ends the Spark jobs of the running job; False if there is none."""
        if not self.stop():
            return False
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        return True

    def wait(self, seconds: float | None = None) -> bool:
        """Waits for the end of the job; whether it came in time."""
        if self._thread is not None:
            self._thread.join(seconds)
        return not self.running()
