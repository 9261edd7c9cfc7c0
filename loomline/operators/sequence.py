"""Order-dependent scans of one group, as folds over sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thin(points: Column, duration: Column, gap: Column) -> Column:
    """Cutpoints at least ``gap`` apart: 0 and duration are forced, a point is kept if it is far enough from the last kept one,
    and the last inner one goes if it is too close to the end. points: array of doubles, duplicates and order don't matter."""
    inner = F.array_sort(F.array_distinct(F.transform(F.filter(points, lambda p: (p > 0) & (p < duration)), lambda p: F.bround(p, 6))))
    kept = F.aggregate(inner, F.array(F.lit(0.0)), lambda acc, p: F.when(p - F.element_at(acc, -1) >= gap, F.concat(acc, F.array(p))).otherwise(acc))
    late = (F.size(kept) > 1) & (duration - F.element_at(kept, -1) < gap)
    return F.concat(F.when(late, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept), F.array(F.bround(duration, 6)))


def thin_cutpoints(points: DataFrame, by: list[str], at: str, durations: DataFrame, duration: str, gap: float) -> DataFrame:
    """by, at: the thinned cutpoints of each track."""
    lists = points.groupBy(*by).agg(F.collect_set(F.col(at).cast("double")).alias("__p"))
    held = durations.join(lists, by, "left").withColumn("__p", F.coalesce("__p", F.array().cast("array<double>")))
    return held.select(*by, F.explode(thin(F.col("__p"), F.col(duration).cast("double"), F.lit(float(gap)))).alias("at"))


def group_by_length(lengths: Column, most: float) -> Column:
    """Group numbers for lengths in order: a new group begins where the next would pass ``most`` (a group has one at least)."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        opens = (a["total"] + x > most) & (F.size(a["out"]) > 0)
        group = a["group"] + F.when(opens, 1).otherwise(0)
        return F.struct(F.when(opens, x).otherwise(a["total"] + x).alias("total"), group.alias("group"), F.concat(a["out"], F.array(group)).alias("out"))

    return F.aggregate(lengths, start, step, lambda a: a["out"])


def repair_spans(spans: Column, low: Column, high: Column, least: float = 0.06) -> Column:
    """Spans (array of struct start, end, in order) made monotone; those shorter than ``least`` borrow time.

    A short span takes from the gap on its right, else from the end of the one before if that is over twice ``least``, else from
    the beginning of the next.
    """
    at = lambda a, i, f: F.get(a, i)[f]

    none = F.array().cast("array<struct<start:double,end:double>>")
    ordered = F.aggregate(spans, none, lambda acc, s: _push(acc, s, low))
    n = F.size(spans)

    def mend(acc, i):
        s, e = at(acc, i, "start"), at(acc, i, "end")
        before, after = F.get(acc, F.greatest(i - 1, F.lit(0))), F.get(acc, i + 1)
        right = F.when(i + 1 < n, after["start"]).otherwise(high)
        short = e - s < least
        by_gap = short & (right - s >= least)
        by_before = short & ~by_gap & (i > 0) & (before["end"] - before["start"] > 2 * least)
        by_after = short & ~by_gap & ~by_before & (i + 1 < n) & (after["end"] - after["start"] > 2 * least)
        cut = F.greatest(before["start"] + least, e - least)
        pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

        def new(x, j):
            own = (
                F.when(by_gap, pair(s, F.least(right, s + F.greatest(F.lit(least), (right - s) * 0.5))))
                .when(by_before, pair(cut, F.greatest(e, cut + least)))
                .when(by_after, pair(s, s + least))
                .otherwise(x)
            )
            return (
                F.when(j == i, own)
                .when((j == i - 1) & by_before, pair(x["start"], cut))
                .when((j == i + 1) & by_after, pair(F.greatest(x["start"], s + least), x["end"]))
                .otherwise(x)
            )

        return F.transform(acc, new)

    return F.when(n == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), ordered, mend))


def _push(acc: Column, s: Column, low: Column) -> Column:
    start = F.greatest(s["start"], F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], low))
    return F.concat(acc, F.array(F.struct(start.alias("start"), F.greatest(s["end"], start).alias("end"))))


def pad_positions(spans: Column, n: Column, at: Column) -> Column:
    """Spans cut or filled to n: what is missing has no length, at the given place."""
    filler = F.struct(at.alias("start"), at.alias("end"))
    return F.when(F.size(spans) >= n, F.slice(spans, F.lit(1), n)).otherwise(F.concat(spans, F.array_repeat(filler, (n - F.size(spans)).cast("int"))))


def whole_if_empty(spans: DataFrame, tracks: DataFrame, by: list[str], duration: str) -> DataFrame:
    """spans, and one span over all of each track that has none."""
    lone = tracks.join(spans.select(*by).distinct(), by, "left_anti").select(*by, F.lit(0.0).alias("start"), F.col(duration).cast("double").alias("end"))
    return spans.select(*by, "start", "end").unionByName(lone)
