"""Candidate lattices: pruning with rescue of continuations in closed form, and the cheapest path through them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def with_rescue(candidates: DataFrame, song: str, t: str, chain: str, pos: str, rank: str, k: int) -> DataFrame:
    """Candidates of rank <= k, and those that continue, unit by unit in the recording, one that was kept in the column before.

    Along a diagonal (same song, same chain, t - pos) neighbours in t continue each other, so a candidate stays if any row at
    or before it in its unbroken stretch has rank <= k: windows over one sort instead of a recursion over columns. Candidates of
    rank > k that continue no other candidate may be left out beforehand: nothing keeps them, and nothing stays because of them.
    """
    w = Window.partitionBy(song, chain, "__diag").orderBy(t)
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = candidates.withColumn("__diag", F.col(t) - F.col(pos)).withColumn("__new", F.coalesce(F.lag(t).over(w) != F.col(t) - 1, F.lit(True)))
    last = broken.withColumns({"__from": F.max(F.when(F.col("__new"), F.col(t))).over(seen), "__held": F.max(F.when(F.col(rank) <= k, F.col(t))).over(seen)})
    return last.filter(F.col("__held") >= F.col("__from")).drop("__diag", "__new", "__from", "__held")


def cheapest_path(columns: list[dict[str, np.ndarray]], joined: list[bool], weight: float = 1.0) -> tuple[list[int], float]:
    """Row of each column and total cost of the cheapest path; the first of equals, column by column.

    Columns have cost, unit_id, next_id, source, shift and energy; joined: whether a column follows the one before without pause.
    """
    best, back = columns[0]["cost"], []
    for a, b, near in zip(columns, columns[1:], joined[1:]):
        if near:
            gap = np.nan_to_num(np.abs(a["energy"][:, None] - b["energy"]))
            splice = weight * (0.6 + 0.15 * (a["source"][:, None] != b["source"]) + 0.03 * np.abs(a["shift"][:, None] - b["shift"]) + 0.02 * gap)
            total = best[:, None] + np.where(a["next_id"][:, None] == b["unit_id"], 0.0, splice)
            pick = np.argmin(total, axis=0)
            least = total[pick, np.arange(len(pick))]
        else:
            pick = np.full(len(b["cost"]), int(np.argmin(best)))
            least = best.min()
        back.append(pick)
        best = least + b["cost"]
    at = [int(np.argmin(best))]
    for pick in reversed(back):
        at.append(int(pick[at[-1]]))
    return at[::-1], float(best.min())


def select_sequence(lattice: DataFrame, song: str, t: str, order: list[str], weight: float = 1.0, placed: bool = False) -> DataFrame:
    """song, t, unit_id, tier, total_cost: for each song the cheapest sequence of one candidate a target.

    lattice: the pruned candidates with unit_id, next_id, source, shift, energy, cost, tier and joined. Tasks take sorted partitions of
    songs and solve one after the other, so many short songs cost one batch; a song's lattice has at most its targets times the candidates
    kept of each. A target without candidates leaves a pause. placed: the lattice is hash partitioned by song already.
    """
    plain = lattice.select(song, t, *order, *(c for c in (*_FLOATS, *_OTHERS, "tier", "joined") if c not in order))
    names = plain.columns
    kinds = [plain.schema[c].dataType for c in (song, t, "unit_id")]
    schema = StructType([*(StructField(f"c{k}", kind) for k, kind in enumerate(kinds)), StructField("tier", IntegerType()), StructField("total_cost", DoubleType())])

    def solve(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[batch.num_rows - 1]
            if batch.column(0)[0] == last and batch.num_rows > 1:
                continue  # perhaps one song goes on
            rows = pa.Table.from_batches(held).combine_chunks()
            same = rows.column(0).to_pylist()
            cut = next(k for k in range(len(same), 0, -1) if same[k - 1] != same[-1]) if same[0] != same[-1] else 0
            if cut:
                yield from _paths(rows.slice(0, cut), names, song, t, weight)
            held = rows.slice(cut).to_batches()
        if held:
            yield from _paths(pa.Table.from_batches(held), names, song, t, weight)

    sorted_ = (plain if placed else plain.repartition(song)).sortWithinPartitions(song, t, *order)
    return sorted_.mapInArrow(solve, schema).toDF(song, t, "unit_id", "tier", "total_cost")


_FLOATS, _OTHERS = ("cost", "shift", "energy"), ("unit_id", "next_id", "source")


def _paths(rows: pa.Table, names: list[str], song: str, t: str, weight: float):
    """The cheapest path of each of the songs that follow each other in rows, as one batch."""
    column = {c: rows.column(names.index(c)) for c in names}
    array = {c: np.array(column[c].to_pylist(), float) for c in _FLOATS} | {c: np.array(column[c].to_pylist()) for c in (*_OTHERS, t)}
    songs, near = column[song].to_pylist(), column["joined"].to_pylist()
    edges = [0, *(k for k in range(1, len(songs)) if songs[k] != songs[k - 1]), len(songs)]
    picked, totals = [], []
    for lo, hi in zip(edges, edges[1:]):
        place = array[t][lo:hi]
        steps = [lo, *(lo + 1 + np.flatnonzero(place[1:] != place[:-1])).tolist(), hi]
        columns = [{c: array[c][a:b] for c in (*_FLOATS, *_OTHERS)} for a, b in zip(steps, steps[1:])]
        joined = [k > 0 and bool(near[a]) and array[t][a] == array[t][steps[k - 1]] + 1 for k, a in enumerate(steps[:-1])]
        path, total = cheapest_path(columns, joined, weight)
        picked += [a + p for a, p in zip(steps, path)]
        totals += [total] * len(path)
    at = pa.array(picked)
    out = [column[c].take(at).combine_chunks() for c in (song, t, "unit_id")]
    out = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in out]
    tiers = pa.array(column["tier"].take(at).to_pylist(), pa.int32())
    yield pa.RecordBatch.from_arrays([*out, tiers, pa.array(totals, pa.float64())], names=["c0", "c1", "c2", "tier", "total_cost"])
