"""Models at Spark's edge: what a model makes of rows, built once for each task, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Makes a model of nothing; the model makes rows of rows.
Factory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def extracted(rows: DataFrame, factory: Factory, schema: str) -> DataFrame:
    """What the model gives for each batch of rows; it may give more or fewer rows than it takes. Empty batches are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if len(batch):
                model = model or factory()
                yield model(batch)

    return rows.mapInPandas(run, schema)
