"""Lag of running queries: what their progress says of the offsets they have reached and of those there are."""

from __future__ import annotations

import json
from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

LAG = "query string, topic string, partition int, next_offset long, end_offset long"


def offsets_of(text: str | dict | None) -> dict[tuple[str, int], int]:
    """(topic, partition) -> offset, of a source's offsets as they are reported: topics with partitions, as brokers have them."""
    found = json.loads(text) if isinstance(text, str) and text.startswith("{") else text if isinstance(text, dict) else {}
    return {(t, int(p)): n for t, parts in found.items() if isinstance(parts, dict) for p, n in parts.items() if str(p).isdigit()}


class Lag(StreamingQueryListener):
    """Positions of the partitions that queries read, kept up to date by their progress.

    A source that doesn't report its latest offsets has them asked from `ends`, a function of the topic. A partition that
    a query's last progress no longer names was taken from it, and is forgotten, as are those of a query that has ended.
    """

    def __init__(self, ends: Callable[[str], dict[int, int]] | None = None) -> None:
        self.ends, self.refresh_errors = ends, 0
        self._held: dict[str, dict[tuple[str, int], tuple[int, int]]] = {}
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.observe(str(event.progress.id), [(s.startOffset, s.endOffset, s.latestOffset) for s in event.progress.sources])

    def observe(self, query: str, sources: list[tuple]) -> None:
        """One progress of a query: (start, end, latest) offsets of its sources."""
        now: dict[tuple[str, int], tuple[int, int]] = {}
        before = self._held.get(query, {})
        for _, end, latest in sources:
            reached, there = offsets_of(end), offsets_of(latest)
            for topic in {t for t, _ in reached} - {t for t, _ in there}:
                there |= self._asked(topic)
            for part, n in reached.items():
                now[part] = (n, there.get(part, max(n, before.get(part, (0, 0))[1])))
            for part, n in there.items():  # one that has records and hasn't been read yet
                now.setdefault(part, (before.get(part, (0, 0))[0], n))
        with self._lock:
            self._held[query] = now

    def _asked(self, topic: str) -> dict[tuple[str, int], int]:
        if self.ends is None:
            return {}
        try:
            return {(topic, p): n for p, n in self.ends(topic).items()}
        except OSError:
            self.refresh_errors += 1
            return {}

    def refresh(self) -> None:
        """Ask for the ends again between batches; positions stay."""
        with self._lock:
            for held in self._held.values():
                for topic in {t for t, _ in held}:
                    held.update({part: (held.get(part, (0, 0))[0], n) for part, n in self._asked(topic).items()})

    def onQueryIdle(self, event) -> None:
        self.refresh()

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._held.pop(str(event.id), None)

    def rows(self, spark: SparkSession) -> DataFrame:
        """What metrics.lag() takes, for each query and partition: a row each, as many as the queries read."""
        with self._lock:
            found = [(q, t, p, a, b) for q, held in self._held.items() for (t, p), (a, b) in held.items()]
        return spark.createDataFrame(found, LAG)
