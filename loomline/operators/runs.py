"""Runs, gaps and links in ordered series. Every function takes grouping columns and an explicit order; ties are settled by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def runs(frames: DataFrame, by: list[str], index: str, flag: Column) -> DataFrame:
    """Maximal stretches of consecutive frame numbers where flag holds: by, start, end (exclusive), n.

    What lies outside a run is filtered before the shuffle.
    """
    held = frames.filter(flag).withColumn("__run", F.col(index) - F.row_number().over(_over(by, [index])))
    return held.groupBy(*by, "__run").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end"), F.count("*").alias("n")).drop("__run")


def run_lengths(frames: DataFrame, by: list[str], index: str, flag: Column, name: str = "run_length") -> DataFrame:
    """frames with the length of the run that each flagged frame lies in (NULL outside): two windows over one shuffle."""
    w = _over(by, [index])
    marked = frames.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    changed = marked.withColumn("__new", (F.col("__flag") != F.lag("__flag", 1, False).over(w)) | (F.col(index) != F.lag(index).over(w) + 1))
    numbered = changed.withColumn("__run", F.sum(F.when(F.col("__new"), 1).otherwise(0)).over(w))
    size = F.count("*").over(Window.partitionBy(*by, "__run"))
    return numbered.withColumn(name, F.when(F.col("__flag"), size)).drop("__flag", "__new", "__run")


def drop_short_runs(frames: DataFrame, by: list[str], index: str, value: str, least: int) -> DataFrame:
    """frames with value NULL in voiced runs (value not NULL) of fewer than ``least`` frames."""
    sized = run_lengths(frames, by, index, F.col(value).isNotNull(), "__length")
    return sized.withColumn(value, F.when(F.col("__length") >= least, F.col(value))).drop("__length")


def close_gaps(spans: DataFrame, by: list[str], start: str, end: str, gap) -> DataFrame:
    """Neighbouring spans merge where the gap between them is less than ``gap``: by, start, end, n."""
    w = _over(by, [start, end])
    opens = F.coalesce(F.col(start) - F.lag(end).over(w) >= gap, F.lit(True)).cast("int")
    grouped = spans.withColumn("__opens", opens).withColumn("__group", F.sum("__opens").over(w))
    return grouped.groupBy(*by, "__group").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__group")


def merge_groups(spans: DataFrame, by: list[str], start: str, end: str, gap, order: list[str] = (), name: str = "phrase") -> DataFrame:
    """spans numbered by group from 0: one joins if it starts at or before the furthest end so far plus ``gap``."""
    w = _over(by, [start, *order])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col(start) > reach + gap, F.lit(False)).cast("int")
    return spans.withColumn("__opens", opens).withColumn(name, F.sum("__opens").over(w)).drop("__opens")


def merge_intervals(spans: DataFrame, by: list[str], start: str, end: str, gap=0) -> DataFrame:
    grouped = merge_groups(spans, by, start, end, gap, [end], "__phrase")
    return grouped.groupBy(*by, "__phrase").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__phrase")


def link_neighbours(units: DataFrame, by: list[str], order: list[str], unit_id: str, start: str, end: str, gap) -> DataFrame:
    """prev_id and next_id: the neighbour in order, where the gap to it is at most ``gap`` (it may be negative)."""
    w = _over(by, order)
    close = lambda a, b: b - a <= gap
    return units.withColumns(
        {
            "prev_id": F.when(close(F.lag(end).over(w), F.col(start)), F.lag(unit_id).over(w)),
            "next_id": F.when(close(F.col(end), F.lead(start).over(w)), F.lead(unit_id).over(w)),
        }
    )


def phrase_flags(targets: DataFrame, by: list[str], order: list[str], start: str, end: str, gap) -> DataFrame:
    """joined: close to the one before; phrase_start: not; phrase_end: nothing close follows."""
    w = _over(by, order)
    joined = F.coalesce(F.col(start) - F.lag(end).over(w) <= gap, F.lit(False))
    last = F.coalesce(F.lead(start).over(w) - F.col(end) > gap, F.lit(True))
    return targets.withColumns({"joined": joined, "phrase_end": last}).withColumn("phrase_start", ~F.col("joined"))


def low_run_boundaries(frames: DataFrame, by: list[str], index: str, value: str, threshold: Column, least: int) -> DataFrame:
    """Edges of runs at or below threshold that last ``least`` frames: their start (unless 0), and their end if frames follow."""
    last = frames.groupBy(*by).agg(F.max(index).alias("__last"))
    low = runs(frames, by, index, F.col(value) <= threshold).filter(F.col("n") >= least).join(last, by)
    edges = F.array_compact(F.array(F.when(F.col("start") > 0, F.col("start")), F.when(F.col("end") <= F.col("__last"), F.col("end"))))
    return low.select(*by, F.explode(edges).alias("at"))


def longest_run(found: DataFrame, by: list[str]) -> DataFrame:
    """The longest of runs(); the first of equals. One partial aggregate, no sort."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("start"), F.col("end")))
    return found.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def extend_while(targets: DataFrame, frames: DataFrame, by: list[str], key: list[str], end: str, limit: str, index: str, voiced: Column, slack: int = 6) -> DataFrame:
    """targets with ``extended``: the frame after the last voiced one that is reached from ``end`` over gaps of at most slack frames.

    Frames in [end, limit) are looked at; where none is reached within slack, end stays.
    """
    near = targets.select(*by, *key, end, limit).join(frames.filter(voiced).select(*by, index), by).filter((F.col(index) >= F.col(end)) & (F.col(index) < F.col(limit)))
    w = _over([*by, *key], [index])
    gap = F.col(index) - F.coalesce(F.lag(index).over(w), F.col(end) - 1) > slack + 1
    broken = near.withColumn("__gap", gap.cast("int")).withColumn("__gaps", F.sum("__gap").over(w))
    reached = broken.filter("__gaps = 0").groupBy(*by, *key).agg((F.max(index) + 1).alias("extended"))
    return targets.join(reached, [*by, *key], "left").withColumn("extended", F.greatest(F.col(end), F.coalesce("extended", F.col(end))))


def consecutive_segments(points: DataFrame, by: list[str], at: str, prefix: str = "seg_") -> DataFrame:
    """Cutpoints to segments between neighbours: by, segment_id (seg_001 ...), start, end."""
    w = _over(by, [at])
    paired = points.select(*by, F.col(at).alias("start"), F.lead(at).over(w).alias("end"), F.row_number().over(w).alias("__n"))
    return paired.filter(F.col("end").isNotNull()).select(*by, F.format_string(prefix + "%03d", "__n").alias("segment_id"), "start", "end")


def keep_words(intervals: DataFrame, by: list[str], order: list[str], text: str, start: str, end: str, silence: tuple[str, ...], long: float = 1.5) -> DataFrame:
    """Intervals that are no silence, without a repeat of the word before that lasts over ``long`` seconds."""
    words = intervals.filter(~F.trim(F.coalesce(F.col(text), F.lit(""))).isin(*silence))
    repeat = (F.lag(text).over(_over(by, order)) == F.col(text)) & (F.col(end) - F.col(start) > long)
    return words.withColumn("__repeat", F.coalesce(repeat, F.lit(False))).filter("NOT __repeat").drop("__repeat")


def concatenate_timelines(pieces: DataFrame, by: list[str], order: list[str], duration: str, pause: float = 0.6) -> DataFrame:
    """pieces with the offset at which each begins when they follow each other with a pause between."""
    before = _over(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum(F.col(duration) + pause).over(before), F.lit(0.0)))
