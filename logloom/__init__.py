"""Log analytics on PySpark: NDJSON in, an indexed Parquet table, search, counts, retention and alerts."""

from logloom.operators.index import LogIndex
from logloom.operators.filters import LogQuery
from logloom.session import configure, local_session

__all__ = ["LogIndex", "LogQuery", "configure", "local_session"]
