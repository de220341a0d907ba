"""Scores of new values by a model that is handed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Score of a value that the model fails on.
FALLBACK = 0.5


def classify_relevance(rows: DataFrame, classify: Callable[[str], float], column: str = "value") -> DataFrame:
    """``rows`` with ``relevance`` by ``classify``, within 0 and 1; ``FALLBACK`` where it fails or gives no number.

    Each distinct value is asked once. A null value gets ``FALLBACK`` unasked.
    """

    def score(value: str) -> float:
        try:
            found = float(classify(value))
        except Exception:  # noqa: BLE001 - any failure of the model means the fallback
            return FALLBACK
        return min(1.0, max(0.0, found)) if found == found else FALLBACK

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"__value": batch["__value"], "__score": [score(v) for v in batch["__value"]]})

    values = rows.select(F.col(column).alias("__value")).where(F.col("__value").isNotNull()).distinct()
    scores = values.mapInPandas(scored, "__value string, __score double")
    met = rows.join(scores, F.col(column) == F.col("__value"), "left")
    return met.withColumn("relevance", F.coalesce("__score", F.lit(FALLBACK))).drop("__value", "__score")
