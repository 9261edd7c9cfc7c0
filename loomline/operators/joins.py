"""Interval, nearest and ledger joins without nested loops.

Intervals are put into levels by length: level k has buckets of width 2**k, and an interval of that level touches two at
most. Levels that occur are drawn together by threes, from the longest down, so a bucket is at most four times as wide as its
interval's own would be. A point, or a shorter interval, looks at the buckets of every level left. So both sides meet in an equi-join that shuffles and splits like any other, and no
interval is copied more than twice by level, however long.

Sides that were copied to levels are never broadcast: Spark judges them by their files, which know nothing of the copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORTEST = -20
TOGETHER = 3


def _level(start: str, end: str) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest((F.col(end) - F.col(start)).cast("double"), F.lit(2.0**SHORTEST)))).cast("int"), F.lit(SHORTEST))


def _bucket(at: Column, level: Column) -> Column:
    return F.floor(at.cast("double") / F.pow(F.lit(2.0), level)).cast("long")


def levels_of(intervals: DataFrame, start: str, end: str) -> list[int]:
    """The levels that occur: at most some eighty numbers, whatever the table."""
    return sorted(r[0] for r in intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(_level(start, end).alias("l")).distinct().collect())


def drawn_together(levels: list[int]) -> list[int]:
    """The levels that stay: the longest, then the longest that is ``TOGETHER`` or more below the last one taken."""
    kept: list[int] = []
    for l in sorted(levels, reverse=True):
        if not kept or l <= kept[-1] - TOGETHER:
            kept.append(l)
    return kept[::-1]


def _kept_level(start: str, end: str, kept: list[int]) -> Column:
    """The shortest kept level that is no shorter than the interval's own."""
    own = _level(start, end)
    return F.coalesce(*(F.when(own <= l, F.lit(l)) for l in kept))


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, closed: bool = False, how: str = "inner") -> DataFrame:
    """Each point with each interval of its group that holds it: start <= at < end, or <= end if closed.

    how: inner or left. Other column names of both sides must differ.
    """
    levels = drawn_together(levels_of(intervals, start, end)) or [0]
    placed = intervals.withColumn("__l", _kept_level(start, end, levels)).withColumn("__b", F.explode(F.sequence(_bucket(F.col(start), F.col("__l")), _bucket(F.col(end), F.col("__l")))))
    asked = points.withColumn("__id", F.monotonically_increasing_id()) if how == "left" else points
    probed = asked.withColumn("__l", F.explode(F.array(*map(F.lit, levels)))).withColumn("__b", _bucket(F.col(at), F.col("__l")))
    within = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    found = probed.join(placed.hint("merge"), [*by, "__l", "__b"]).filter(within).drop("__l", "__b")
    if how == "inner":
        return found
    extra = [c for c in intervals.columns if c not in by]
    lone = points.join(found.select(*by, at).distinct(), [*by, at], "left_anti")
    return found.drop("__id").unionByName(lone.select(*points.columns, *(F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in extra)))


def sharing_buckets(left: DataFrame, right: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs that share a bucket (__b) of the longer one's level, with the first bucket of each (__first_x, __first_y).

    An interval of a level meets those of the other side at that level or below it; left ones go first, then right ones that are longer.
    Two short intervals thus never meet in the bucket of a long one.
    """

    def buckets(side: DataFrame, span: tuple[str, str], tag: str) -> DataFrame:
        first, last = _bucket(F.col(span[0]), F.col("__l")), _bucket(F.col(span[1]), F.col("__l"))
        return side.withColumn(f"__first_{tag}", first).withColumn("__b", F.explode(F.sequence(first, last)))

    found = levels_of(left, *a), levels_of(right, *b)
    kept = drawn_together([*found[0], *found[1]]) or [0]
    lefts, rights = (sorted({min(l for l in kept if l >= x) for x in side}) or [0] for side in found)

    def own(side: DataFrame, span: tuple[str, str], tag: str) -> DataFrame:
        return buckets(side.withColumn("__l", _kept_level(*span, kept)), span, tag)

    def below(side: DataFrame, span: tuple[str, str], tag: str, levels: list[int], equal: bool) -> DataFrame:
        reach = F.filter(F.array(*map(F.lit, levels)), lambda x: (x >= F.col("__own")) if equal else (x > F.col("__own")))
        return buckets(side.withColumn("__own", _kept_level(*span, kept)).withColumn("__l", F.explode(reach)).drop("__own"), span, tag)

    longer = own(left, a, "x").join(below(right, b, "y", lefts, True).hint("merge"), [*by, "__l", "__b"])
    return longer.unionByName(below(left, a, "x", rights, False).join(own(right, b, "y").hint("merge"), [*by, "__l", "__b"]))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of the same group that overlap: a.start < b.end and b.start < a.end. Each pair once."""
    once = F.col("__b") == F.greatest("__first_x", "__first_y")
    meet = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    return sharing_buckets(left, right, by, a, b).filter(once & meet).drop("__l", "__b", "__first_x", "__first_y")


def segment_at(points: DataFrame, segments: DataFrame, by: list[str], at: str, start: str, end: str, order: str) -> DataFrame:
    """points with the number ``order`` of the first segment that holds them, both ends included; the group's last where none does."""
    held = points_in_intervals(points, segments, by, at, start, end, closed=True).groupBy(*by, at).agg(F.min(order).alias(order))
    last = segments.groupBy(*by).agg(F.max(order).alias("__last"))
    return points.join(held.hint("merge"), [*by, at], "left").join(last.hint("merge"), by, "left").withColumn(order, F.coalesce(order, "__last")).drop("__last")


def contained(inner: DataFrame, outer: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str], slack: float = 1e-4) -> DataFrame:
    """Pairs where a lies in b, with a tolerance at both ends."""
    wide = outer.withColumns({"__s": F.col(b[0]) - slack, "__e": F.col(b[1]) + slack})
    return points_in_intervals(inner, wide, by, a[0], "__s", "__e", closed=True).filter(F.col(a[1]) <= F.col("__e")).drop("__s", "__e")


def best_overlap(current: DataFrame, previous: DataFrame, by: list[str], key: str, a: tuple[str, str], b: tuple[str, str], order: str, least: float = 0.55) -> DataFrame:
    """For each of current (key) the previous row with the largest overlap / longer duration, if that is ``least``; the first of equals."""
    pairs = overlapping(current, previous, by, a, b)
    common = F.least(F.col(a[1]), F.col(b[1])) - F.greatest(F.col(a[0]), F.col(b[0]))
    longer = F.greatest(F.col(a[1]) - F.col(a[0]), F.col(b[1]) - F.col(b[0]))
    rated = pairs.withColumn("ratio", common / F.greatest(longer, F.lit(1e-9)))
    nth = F.row_number().over(Window.partitionBy(*by, key).orderBy(F.col("ratio").desc(), F.col(order)))
    return rated.withColumn("__nth", nth).filter((F.col("__nth") == 1) & (F.col("ratio") >= least)).drop("__nth")


def same_bounds(current: DataFrame, previous: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str], slack: float = 0.002) -> DataFrame:
    """Pairs whose bounds both differ by slack at most: buckets of that width, neighbours probed."""
    cell = lambda c: F.floor(F.col(c) / slack).cast("long")
    near = current.withColumn("__c", F.explode(F.array(cell(a[0]) - 1, cell(a[0]), cell(a[0]) + 1)))
    found = near.join(previous.withColumn("__c", cell(b[0])).hint("merge"), [*by, "__c"]).drop("__c")
    return found.filter((F.abs(F.col(a[0]) - F.col(b[0])) <= slack) & (F.abs(F.col(a[1]) - F.col(b[1])) <= slack))


def _beside(points: DataFrame, grid: DataFrame, by: list[str], at: str, grid_at: str, keep: list[str]) -> DataFrame:
    """points with __low and __high: the last grid row at or before them, and the first at or after; both sides in one sort."""
    g = grid.select(*by, F.col(grid_at).alias("__t"), F.struct(F.col(grid_at).alias("at"), *keep).alias("__g"), F.lit(0).alias("__side"), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in by))
    p = points.withColumns({"__t": F.col(at), "__g": F.lit(None).cast(g.schema["__g"].dataType), "__side": F.lit(1)})
    both = g.unionByName(p)
    w = Window.partitionBy(*by).orderBy("__t", "__side")
    down = Window.partitionBy(*by).orderBy(F.col("__t").desc(), "__side")
    run = lambda x: x.rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"__low": F.last("__g", True).over(run(w)), "__high": F.last("__g", True).over(run(down))})
    return seen.filter("__side = 1").drop("__t", "__g", "__side")


def as_of(points: DataFrame, grid: DataFrame, by: list[str], at: str, grid_at: str, keep: list[str]) -> DataFrame:
    """points with the columns ``keep`` of the last grid row at or before them (NULL if there is none)."""
    seen = _beside(points, grid, by, at, grid_at, keep)
    return seen.select(*points.columns, *(F.col(f"__low.{c}").alias(c) for c in keep))


def nearest(points: DataFrame, grid: DataFrame, by: list[str], at: str, grid_at: str, keep: list[str]) -> DataFrame:
    """points with the columns ``keep`` of the nearest grid row; the earlier of two at one distance. Positions in a group's grid must differ."""
    seen = _beside(points, grid, by, at, grid_at, keep)
    low, high = F.col("__low"), F.col("__high")
    pick = F.when(high.isNull() | (F.col(at) - low["at"] <= high["at"] - F.col(at)), low).otherwise(high)
    return seen.withColumn("__pick", pick).select(*points.columns, *(F.col(f"__pick.{c}").alias(c) for c in keep))


def frame_lookup(points: DataFrame, frames: DataFrame, by: list[str], at: str, index: str, value: str, period: float, default=0.0, clamped: bool = False) -> DataFrame:
    """points with the value of the frame nearest in time; outside the grid ``default``, or the end frame if clamped."""
    i = F.bround(F.col(at) / period).cast("long")
    if clamped:
        ends = frames.groupBy(*by).agg(F.max(index).alias("__last"))
        points = points.join(ends, by, "left")
        i = F.least(F.greatest(i, F.lit(0)), F.col("__last"))
    keyed = points.withColumn("__i", i)
    series = frames.select(*by, F.col(index).cast("long").alias("__i"), value)
    return keyed.join(series, [*by, "__i"], "left").withColumn(value, F.coalesce(value, F.lit(default))).drop("__i", "__last")


def frames_in_spans(spans: DataFrame, frames: DataFrame, by: list[str], start: str, end: str, frame_at: str) -> DataFrame:
    """Frames from start to end, both included; a span that holds none gets the first frame after its start."""
    inside = points_in_intervals(frames, spans, by, frame_at, start, end, closed=True)
    bare = spans.join(inside.select(*by, start, end).distinct(), [*by, start, end], "left_anti")
    after = _beside(bare, frames, by, start, frame_at, [c for c in frames.columns if c not in by])
    filled = after.filter(F.col("__high").isNotNull()).select(*spans.columns, *(F.col(f"__high.{c}").alias(c) for c in frames.columns if c not in by))
    return inside.unionByName(filled)


def zip_positions(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str], strict: bool = False) -> DataFrame:
    """Rows of both sides paired by their place in the group, as far as the shorter goes; if strict, groups of unequal size are dropped."""

    def numbered(side, order):
        w = Window.partitionBy(*by)
        out = side.withColumn("__pos", F.row_number().over(w.orderBy(*order)))
        return out.withColumn("__n", F.count("*").over(w)) if strict else out

    return numbered(left, left_order).join(numbered(right, right_order), [*by, "__pos", *(["__n"] if strict else [])]).drop("__pos", "__n")


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What the ledger of finished work doesn't have."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def first_of(rows: DataFrame, sources: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """rows with ``value`` from the first source that has the key (sidecar files in order of preference)."""
    for k, s in enumerate(sources):
        rows = rows.join(s.select(*key, F.col(value).alias(f"__v{k}")), key, "left")
    return rows.withColumn(value, F.coalesce(*(F.col(f"__v{k}") for k in range(len(sources))))).drop(*(f"__v{k}" for k in range(len(sources))))


def pronunciations(tokens: DataFrame, lexicon: DataFrame, token: str, rule: Column) -> DataFrame:
    """One row for each pronunciation (lexicon: token, array phones); where there is none, the one by rule if it has one."""
    known = tokens.join(lexicon.select(F.col(token), F.col("phones").alias("__list")), token, "left")
    listed = F.coalesce(F.when(F.size("__list") > 0, F.col("__list")), F.array_compact(F.array(rule)))
    return known.withColumn("phones", F.explode(listed)).drop("__list")


def agreeing(first: DataFrame, second: DataFrame, key: list[str], start_within: float = 0.12, end_within: float = 0.15) -> DataFrame:
    """first (start, end) refined by second (start, end) wherever both bounds are near enough."""
    other = second.select(*key, F.col("start").alias("__s"), F.col("end").alias("__e"))
    near = (F.abs(F.col("start") - F.col("__s")) <= start_within) & (F.abs(F.col("end") - F.col("__e")) <= end_within)
    near = F.coalesce(near, F.lit(False))
    both = first.join(other, key, "left").withColumn("refined", near)
    pick = lambda a, b: F.when(F.col("refined"), F.col(b)).otherwise(F.col(a))
    return both.withColumns({"start": pick("start", "__s"), "end": pick("end", "__e")}).drop("__s", "__e")
