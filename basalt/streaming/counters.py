"""Counters of running queries: aggregates that each micro-batch observes, added up by a listener."""

from __future__ import annotations

from collections import Counter
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.metrics import BUCKETS

OUTCOMES = ("analysed", "unrouted", "contract_violation", "undecodable", "unstorable", "row")


def observe(df: DataFrame, name: str, outcome: str = "outcome", seconds: str | None = None, bounds: tuple[float, ...] = BUCKETS["event_delay_seconds"]) -> DataFrame:
    """df unchanged, observed as `name`: records, records of each outcome, and a histogram of a column of seconds.

    Observation rides along with the query's own pass, so it costs no job and no shuffle.
    """
    found = [F.count(F.lit(1)).alias("records")]
    found += [F.count(F.when(F.col(outcome) == o, 1)).alias(f"outcome_{o}") for o in OUTCOMES]
    if seconds is not None:
        found += [F.count(F.when(F.col(seconds) <= b, 1)).alias(f"le_{b:g}") for b in bounds]
        found += [F.count(F.col(seconds)).alias("seconds_count"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds_sum")]
    return df.observe(name, *found)


class Totals(StreamingQueryListener):
    """Sums of what micro-batches observed, by observation and metric; a replayed batch counts again."""

    def __init__(self) -> None:
        self.totals: dict[str, Counter] = {}
        self.batches: Counter = Counter()
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            for name, row in event.progress.observedMetrics.items():
                self.batches[name] += 1
                self.totals.setdefault(name, Counter()).update({k: v for k, v in row.asDict().items() if v})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
