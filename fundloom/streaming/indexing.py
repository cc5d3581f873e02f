"""The indexing queue as a stream: each document's job is a state machine that survives restarts.

Events are (doc_id, event_id, kind, text, scanned, message) with the kinds
uploaded, started, extracted, failed, reindex and deleted. A document is
pending, processing, indexed, failed or needs_ocr. What doesn't fit a
document's state is ignored, so an event that is delivered twice changes
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fundloom.operators.chunking import chunks_of
from fundloom.streaming.events import keep_state_on_disk

TRANSITIONS = "doc_id long, attempt int, before string, status string, message string, chunk_count int, index_config string"
#: Fixed value: characters of an error message that are kept.
MESSAGE = 500
NO_TEXT = "No text could be extracted from this document."
NEEDS_OCR = "The pages are images without a text layer; run OCR and upload the searchable version."
TIMED_OUT = "The document took too long to index."
EVENTS = ["doc_id", "event_id", "kind", "text", "scanned", "message"]


class _Jobs(StatefulProcessor):
    def __init__(self, timeout_ms: int, config: str):
        self.timeout, self.config = timeout_ms, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, attempt int")
        self.indexed = handle.getValueState("indexed", "chunk_count int, index_config string")
        self.seen = handle.getValueState("seen", "event_id long")

    def _stop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _goes(self, doc_id: int, before: str | None, status: str, attempt: int, message: str | None = None, count: int = 0) -> tuple:
        config = self.config if status == "indexed" else None
        self.status.update((status, attempt))
        self.indexed.update((count, config))
        return doc_id, attempt, before, status, message[:MESSAGE] if message else None, count, config

    def _finished(self, doc_id: int, attempt: int, text: str | None, scanned: bool) -> tuple:
        if scanned:
            return self._goes(doc_id, "processing", "needs_ocr", attempt, NEEDS_OCR)
        count = sum(1 for _ in chunks_of(text)) if text else 0
        return self._goes(doc_id, "processing", "indexed", attempt, None, count) if count else self._goes(doc_id, "processing", "failed", attempt, NO_TEXT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        doc_id, out = int(key[0]), []
        status, attempt = self.status.get() if self.status.exists() else (None, 0)
        last = self.seen.get()[0] if self.seen.exists() else -1
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples():
            if r.event_id <= last:
                continue
            last, made = int(r.event_id), None
            if r.kind == "uploaded" and status is None or r.kind == "reindex" and status in ("indexed", "failed", "needs_ocr"):
                made = self._goes(doc_id, status, "pending", attempt)
            elif r.kind == "started" and status == "pending":
                attempt += 1
                made = self._goes(doc_id, status, "processing", attempt)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
            elif r.kind == "extracted" and status == "processing":
                made = self._finished(doc_id, attempt, r.text, bool(r.scanned))
            elif r.kind == "failed" and status == "processing":
                made = self._goes(doc_id, status, "failed", attempt, r.message or "Indexing failed because of an internal error.")
            elif r.kind == "deleted" and status is not None:
                out.append((doc_id, attempt, status, "deleted", None, 0, None))
                self._stop_timers()
                self.status.clear()
                self.indexed.clear()
                status, attempt = None, 0
            if made:
                out.append(made)
                status = made[3]
                if status != "processing":
                    self._stop_timers()
        self.seen.update((last,))
        yield self._table(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempt = self.status.get() if self.status.exists() else (None, 0)
        yield self._table([self._goes(int(key[0]), status, "failed", attempt, TIMED_OUT)] if status == "processing" else [])

    @staticmethod
    def _table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRANSITIONS.split(", ")]).astype({"doc_id": "int64", "attempt": "int32", "chunk_count": "int32"})

    def close(self) -> None:
        pass


def indexing_states(events: DataFrame, timeout_s: float = 60.0, config: str = "") -> DataFrame:
    """(doc_id, attempt, before, status, message, chunk_count, index_config): each change of a document's state.

    An extracted text is cut into chunks here; one without any has failed, one
    of scanned pages needs OCR. A job that has started and isn't done after
    ``timeout_s`` of processing time fails. Each document's events are taken by
    id, and those up to the last one seen are ignored; a deleted document that
    is uploaded again begins anew. As timers go by the clock there is always
    another batch to come: run it with ``trigger(processingTime=...)``, since
    ``availableNow`` would not end.
    """
    keep_state_on_disk(events.sparkSession)
    rows = events.select(*(F.col(c) for c in EVENTS))
    return rows.groupBy("doc_id").transformWithStateInPandas(_Jobs(int(timeout_s * 1000), config), TRANSITIONS, "Update", "ProcessingTime")
