"""Work in the background, with a status, cancellation and an end."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from ..errors import ToolError

#: What ``result`` tells of work that has not ended yet, by the kind of work.
NOT_READY = {"tree": "tree_not_ready", "discovery": "discovery_not_ready", "refresh": "refresh_not_ready", "capture": "dataset_incomplete"}


class Job:
    """One piece of work: running, then complete, failed or canceled, then perhaps closed.

    The work runs on a thread whose Spark jobs carry a tag; ``cancel`` stops those.
    """

    def __init__(self, spark: SparkSession, kind: str, work: Callable[[], Any], discard: Callable[[Any], None] | None = None):
        self.kind, self._spark, self._discard = kind, spark, discard
        self._tag, self._value, self._error = f"recordloom-{uuid.uuid4().hex}", None, None
        self._lock, self._status, self._asked = threading.Lock(), "running", False
        self._thread = InheritableThread(target=self._work, args=(work,), daemon=True)
        self._thread.start()

    def _work(self, work: Callable[[], Any]) -> None:
        context = self._spark.sparkContext
        context.addJobTag(self._tag)
        try:
            value = work()
            with self._lock:
                self._value, self._status = value, "canceled" if self._asked else "complete"
            if self._asked and self._discard:
                self._discard(value)
        except Exception as error:  # told by result()
            with self._lock:
                self._error, self._status = error, "canceled" if self._asked else "failed"
        finally:
            context.removeJobTag(self._tag)

    @property
    def status(self) -> str:
        return self._status

    def wait(self, timeout: float | None = None) -> str:
        self._thread.join(timeout)
        return self._status

    def cancel(self) -> None:
        """Stops the work; once it has ended this changes nothing."""
        with self._lock:
            if self._status != "running":
                return
            self._asked = True
        self._spark.sparkContext.cancelJobsWithTag(self._tag)

    def result(self) -> Any:
        """The value of complete work; an error with a code that tells why there is none."""
        if self._status == "running":
            raise ToolError(NOT_READY.get(self.kind, "operation_not_ready"), f"the {self.kind} has not ended yet")
        if self._status == "closed":
            raise ToolError("result_closed", f"the {self.kind} is closed")
        if self._status == "canceled":
            raise ToolError("capture_canceled" if self.kind == "capture" else "operation_canceled", f"the {self.kind} was canceled")
        if isinstance(self._error, ToolError):
            raise self._error
        if self._error is not None:
            raise ToolError("execution_failed", f"the {self.kind} failed: {self._error}") from self._error
        return self._value

    def close(self) -> None:
        """Cancels what still runs, waits for it and gives the result up."""
        self.cancel()
        self._thread.join()
        with self._lock:
            value, self._value = self._value, None
            was, self._status = self._status, "closed"
        if was == "complete" and self._discard and value is not None:
            self._discard(value)
