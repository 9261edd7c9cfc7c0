"""Streaming forms: new material by ledger, sessions by event time, and runs that outlive a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest(stream: DataFrame, ledger: str, key: list[str], build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch builds what the ledger doesn't have, and appends results before ledger entries.

    Results carry the batch number: a batch that is run again after a failure overwrites its own part, so nothing is doubled.
    """

    def step(batch: DataFrame, number: int) -> None:
        from loomline.operators.joins import pending
        from loomline.sources.files import open_table

        spark = batch.sparkSession
        names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.select(*key).schema)
        done = open_table(spark, ledger, names + ", batch bigint").filter(F.col("batch") != number)
        fresh = pending(batch.dropDuplicates(key), done, key)
        build(fresh).write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh.select(*key).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def sessions(events: DataFrame, by: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Sessions by event time: events at most ``gap`` apart (exactly that included) belong together; ``late`` bounds disorder."""
    return events.withWatermark(at, late).groupBy(*by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def runs(frames: DataFrame, by: str, index: str, value: str, threshold: float) -> DataFrame:
    """by, start, end: runs of frames above threshold, for frames that arrive in order by key; a run ends when a frame breaks it.

    The state is the open run, two numbers a key, whatever the length.
    """
    kind = frames.schema[by].dataType.simpleString()

    def step(key, batches, state: GroupState):
        begin, last = state.get if state.exists else (-1, -1)
        out = []
        for part in batches:
            part = part.sort_values(index)
            for i, v in zip(part[index], part[value]):
                if begin >= 0 and (not v > threshold or i != last + 1):
                    out.append((key[0], begin, last + 1))
                    begin = -1
                if v > threshold:
                    begin, last = (int(i) if begin < 0 else begin), int(i)
        state.update((begin, last))
        yield pd.DataFrame(out, columns=[by, "start", "end"])

    return frames.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, start bigint, end bigint", "begin bigint, last bigint", "append", GroupStateTimeout.NoTimeout)
