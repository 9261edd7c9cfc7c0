"""Best-fit-decreasing packing of token sequences.

Pieces have whole lengths of at most ``capacity``, so the plan depends on how many pieces have each length and on nothing
else. The driver gets those counts (at most ``capacity`` numbers, however large the corpus), and places lengths in
descending order: a segment tree over remaining capacities finds the tightest open bin in logarithmic time, and runs of
equal pieces and equal bins move in one step. The result is the packing that document-by-document best fit makes. Executors
then give every piece its rank among those of its length (a count per input task, then a running sum), and the rank its place.

Nulls and empty texts hold the end id. Repeated rows are packed each. Ties (pieces of one length) take places in the order of their
tasks. Very long texts are cut into pieces of the whole capacity. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, out_batch, rows_of, stored, texts
from loomline.llm.tokens import default_path, encoder

CAPACITY, END_ID = 1024, 2


class CapacityTree:
    """Number of open bins by remaining capacity; the smallest non-empty capacity >= x in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.bins = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = self.size + capacity
        while i:
            self.bins[i] += n
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that an open bin has."""
        i = self.size + least
        if self.bins[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.bins[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.bins[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass(frozen=True)
class Step:
    """Pieces of one length with ranks from ``first`` fill bins from ``sequence`` on, ``each`` to a bin, from ``offset``."""

    length: int
    first: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Best-fit-decreasing for counts[length] pieces of each length."""
    tree, open_bins, steps, sequences = CapacityTree(capacity), {}, [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit into {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                start, n = sequences, -(-left // each)
                sequences += n
            else:
                each = room // length
                start, n = open_bins[room].pop()
                tree.add(room, -n)
                need = -(-left // each)
                if n > need:  # the rest of the run stays open as it is
                    open_bins[room].append((start + need, n - need))
                    tree.add(room, n - need)
                    n = need
            steps.append(Step(length, rank, each, start, capacity - room))
            full, rest = divmod(min(left, n * each), each)
            for first, bins, used in ((start, full, each), (start + full, min(1, rest), rest)):
                if bins:
                    open_bins.setdefault(room - used * length, []).append((first, bins))
                    tree.add(room - used * length, bins)
            rank += full * each + rest
            left -= full * each + rest
    return steps


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))] if n else []


def _pieces(tokenizer: str, capacity: int, end_id: int):
    kinds = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")
    schema = pa.schema([(k, pa.int64() if k != "piece" else pa.int32()) for k in kinds])

    def encode(batches):
        own, ranks, task = encoder(tokenizer), {}, TaskContext.get().partitionId()
        for batch in batches:
            for part in rows_of(batch, 256):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), own.encode(texts(part, "text"))):
                    ids.append(end_id)
                    data = np.array(ids, "<u4").tobytes()
                    for k, (at, n) in enumerate(cut(len(ids), capacity)):
                        rank = ranks.get(n, 0)
                        ranks[n] = rank + 1
                        rows.append((doc, k, at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), task, rank))
                yield out_batch(schema, zip(*rows) if rows else [()] * 7)

    return encode


def _places(steps: list[Step], capacity: int):
    order = sorted(steps, key=lambda s: (s.length, s.first))
    length, first, each, sequence, offset = (np.array([getattr(s, k) for s in order], "i8") for k in ("length", "first", "each", "sequence", "offset"))
    begins = np.searchsorted(length, np.arange(capacity + 2))

    def place(batches):
        for batch in batches:
            long, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.empty(len(long), "i8")
            for n in np.unique(long):
                own = long == n
                low, high = begins[n], begins[n + 1]
                at[own] = low + np.searchsorted(first[low:high], rank[own], side="right") - 1
            nth = rank - first[at]
            added = {"sequence_id": sequence[at] + nth // each[at], "offset": offset[at] + nth % each[at] * long}
            keep = [k for k in batch.schema.names if k != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(x) for x in added.values())], names=[*keep, *added])

    return place


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give sequence_id and offset to pieces (length, task, rank within length and task, and other columns)."""
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("rank")).drop("base", "task")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_places(plan(counts, capacity), capacity), f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs (doc_id, text) with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint"
    pieces = stored(source.mapInArrow(_pieces(tokenizer or default_path(), capacity, end_id), schema), "pieces")
    return assign(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
