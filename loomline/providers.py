"""Seams for models: speech recognition, alignment, pitch, readings, separation, synthesis.

A provider is a function from a pandas batch to a pandas batch, made once for each task by a factory, so that a model loads once.
``recorded`` stands in for any of them with a table of its outputs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Factory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def apply(rows: DataFrame, factory: Factory, schema: str, batch: int | None = None) -> DataFrame:
    """The provider's output for all rows; ``batch`` bounds how many rows it gets at once."""

    def run(batches):
        model = factory()
        for b in batches:
            for at in range(0, len(b), batch or max(1, len(b))):
                yield model(b.iloc[at : at + (batch or len(b))])

    return rows.mapInPandas(run, schema)


def recorded(rows: DataFrame, outputs: DataFrame, key: list[str]) -> DataFrame:
    """Outputs that a model gave before, joined by key; rows without any keep NULLs."""
    return rows.join(outputs, key, "left")


def cached(rows: DataFrame, content: str, cache: DataFrame, factory: Factory, schema: str) -> DataFrame:
    """Outputs by content digest: what the cache has isn't computed again. schema begins with digest string."""
    keyed = rows.withColumn("digest", F.sha1(F.col(content).cast("binary")))
    missing = keyed.dropDuplicates(["digest"]).join(cache.select("digest"), "digest", "left_anti")
    return keyed.join(cache.unionByName(apply(missing, factory, schema)), "digest", "left")
