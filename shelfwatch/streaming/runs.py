"""Run rows of streaming queries, from what Spark reports of them."""

import queue
import threading
import time
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from shelfwatch.plans.oplog import run_row, save_runs


class RunLogListener(StreamingQueryListener):
    """Adds a run row below ``path`` for every batch of the session's named queries, and for a failure.

    Rows and durations are those of Spark's progress events, so nothing is counted
    again. A batch without new rows is no run. Rows are written by a thread of the
    listener's own, so that the event bus never waits for a file; a batch that is
    reported again replaces its row. Use as a context, or call ``start`` and ``stop``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._events: queue.Queue = queue.Queue()
        self._ended: dict[str, threading.Event] = {}
        self._names: dict[str, str] = {}
        self._writer = threading.Thread(target=self._write, daemon=True)

    def start(self) -> "RunLogListener":
        self._writer.start()
        self.spark.streams.addListener(self)
        return self

    def stop(self) -> None:
        self.spark.streams.removeListener(self)
        self._events.put(None)
        self._writer.join()

    __enter__ = start

    def __exit__(self, *error) -> None:
        self.stop()

    def wait(self, query: StreamingQuery) -> None:
        """Until the query has ended, well or not, and its rows are written."""
        try:
            query.awaitTermination()
        except Exception:  # its FAILED row tells
            pass
        self._ended.setdefault(str(query.runId), threading.Event()).wait()

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if not progress.numInputRows:
            return
        begun = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")).timestamp()
        seconds = progress.durationMs.get("triggerExecution", 0) / 1000
        run = run_row(progress.name or str(progress.id), begun, begun + seconds, progress.numInputRows)
        self._events.put((f"{progress.id}.{progress.batchId}", run, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run_id = str(event.runId)
        failed = None
        if event.exception:
            now = time.time()
            failed = run_row(self._names.get(run_id, str(event.id)), now, now, 0, event.exception)
        self._events.put((f"{event.id}.failed-{run_id}", failed, run_id))

    def _write(self) -> None:
        while (event := self._events.get()) is not None:
            label, run, ended = event
            try:
                if run is not None:
                    save_runs(self.spark, self.path, label, [run])
            finally:
                if ended is not None:
                    self._ended.setdefault(ended, threading.Event()).set()
