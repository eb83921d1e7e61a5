"""Heartbeats of streams that have nothing to say (STM4)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql.streaming import StreamingQueryListener

#: Text of a server-sent comment that keeps a connection open, and empty polls in a row before one is sent (fixed values).
FRAME, POLLS = ": heartbeat\n\n", 15


class Heartbeats(StreamingQueryListener):
    """Calls send(query id, FRAME) after every POLLS polls of a query in a row without a row; rows start the count anew.

    Add it with spark.streams.addListener(). A poll is a trigger: one without new data is told as idle, or as progress of no rows.
    """

    def __init__(self, send: Callable[[str, str], None], polls: int = POLLS):
        self.send, self.polls = send, polls
        self.empty: dict[str, int] = {}

    def _poll(self, ident: str, rows: int) -> None:
        self.empty[ident] = 0 if rows else self.empty.get(ident, 0) + 1
        if self.empty[ident] >= self.polls:
            self.empty[ident] = 0
            self.send(ident, FRAME)

    def onQueryStarted(self, event: Any) -> None:
        self.empty[str(event.id)] = 0

    def onQueryProgress(self, event: Any) -> None:
        self._poll(str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event: Any) -> None:
        self._poll(str(event.id), 0)

    def onQueryTerminated(self, event: Any) -> None:
        self.empty.pop(str(event.id), None)
