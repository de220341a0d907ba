"""Figures of running streams, and rates of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps rows, batches and the last duration of each stream by name, for whatever reads them."""

    def __init__(self):
        self.figures: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.figures.setdefault(event.name or str(event.id), {"rows": 0, "batches": 0, "last_ms": None, "error": None})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        figure = self.figures.setdefault(p.name or str(p.id), {"rows": 0, "batches": 0, "last_ms": None, "error": None})
        figure["rows"] += p.numInputRows
        figure["batches"] += 1
        figure["last_ms"] = p.durationMs.get("triggerExecution")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        for name, figure in self.figures.items():
            if name == str(event.id):
                figure["error"] = event.exception


def rate_windows(requests: DataFrame, client: str, at_ms: str, limit: int, window_ms: int = 60_000) -> DataFrame:
    """``(client, window_ms, n, refused)``: requests per client in fixed windows of the clock, and how many are over the limit."""
    start = F.floor(F.col(at_ms) / window_ms) * window_ms
    counts = requests.where(F.col(client).isNotNull() & F.col(at_ms).isNotNull()).groupBy(F.col(client).alias("client"), start.alias("window_ms")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("refused", F.greatest(F.col("n") - limit, F.lit(0)).cast("long"))
