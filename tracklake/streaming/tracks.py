"""Track operators on streams, an extension: the same answers from unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, time: str, label: str, value: str, width: str, late: str) -> DataFrame:
    """Rows and sum of values of each label in tumbling windows; rows later than `late` are left out."""
    w = F.window(F.col(time), width)
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # event time has to be an instant
    out = events.withWatermark(time, late).groupBy(w, label).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), label, "n", "total")


def first_crossings(events: DataFrame, key: str, time: str, value: str, threshold: float) -> DataFrame:
    """Of each key the earliest time seen so far at which the value reaches the threshold, whenever it becomes known or earlier."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        best = known
        for rows in batches:
            hit = rows.loc[rows[value] >= threshold, time]
            if len(hit) and (best is None or hit.min().value < best):
                best = int(hit.min().value)
        if best is not None and best != known:
            state.update((best,))
            yield pd.DataFrame({key: [k[0]], "crossed": [pd.Timestamp(best, unit="ns")]})

    kind = dict(events.dtypes)[key]
    return events.select(key, F.col(time).cast("timestamp_ntz").alias(time), value).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, crossed timestamp_ntz", "best long", "update", "NoTimeout")
