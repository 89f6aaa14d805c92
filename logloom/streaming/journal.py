"""Failures of streaming queries, kept among the runs of the index."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener

from logloom.functions.times import utc_now
from logloom.operators.index import LogIndex


class RunJournal(StreamingQueryListener):
    """Records each streaming query that ends with an error: ``spark.streams.addListener(RunJournal(index))``.

    ``mode`` of the record is the name of the query, or its id if it has none.
    """

    def __init__(self, index: LogIndex):
        self.index = index
        self.started: dict[str, tuple[str, str]] = {}

    def onQueryStarted(self, event) -> None:
        self.started[str(event.runId)] = (event.name or str(event.id), utc_now())

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name, at = self.started.pop(str(event.runId), (str(event.id), utc_now()))
        if event.exception:
            self.index.log_run("stream", name, at, error=event.exception.split("\n")[0])
