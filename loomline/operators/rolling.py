"""Windowed statistics with exact edge rules, gap filling and robust scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(by, order):
    return Window.partitionBy(*by).orderBy(*order)


def moving_average_edge(frames: DataFrame, by, order, value: str, size: int, name: str) -> DataFrame:
    """Centred mean with the end values repeated outward. An even or too large size becomes odd and at most the series' length;
    series of fewer than three frames stay as they are."""
    w, whole = _over(by, order), Window.partitionBy(*by)
    n = F.count("*").over(whole)
    k = F.row_number().over(w)
    sized = frames.withColumns({"__n": n, "__k": k})
    odd = F.when(F.col("__n") % 2 == 1, F.col("__n")).otherwise(F.col("__n") - 1)
    half = F.floor(F.least(F.lit(size if size % 2 else size + 1), odd) / 2)
    # the frame differs by series only where the series is shorter than it; running sums serve any width
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumns({"__half": half, "__sum": F.collect_list(value).over(w.rowsBetween(-(size // 2), size // 2)), "__first": F.first(value).over(run), "__last": F.last(value).over(w.rowsBetween(0, Window.unboundedFollowing))})
    low, high = F.greatest(F.lit(1), F.col("__k") - F.col("__half")), F.least(F.col("__n"), F.col("__k") + F.col("__half"))
    begins = F.greatest(F.lit(1), F.col("__k") - size // 2)
    inside = F.slice("__sum", (low - begins + 1).cast("int"), (high - low + 1).cast("int"))
    total = F.aggregate(inside, F.lit(0.0), lambda a, x: a + x)
    missing = lambda x: F.greatest(x, F.lit(0))
    left, right = missing(F.col("__half") + 1 - F.col("__k")), missing(F.col("__k") + F.col("__half") - F.col("__n"))
    mean = (total + left * F.col("__first") + right * F.col("__last")) / (2 * F.col("__half") + 1)
    return summed.withColumn(name, F.when(F.col("__n") < 3, F.col(value)).otherwise(mean)).drop("__n", "__k", "__half", "__sum", "__first", "__last")


def moving_average_zero(frames: DataFrame, by, order, value: str, size: int, name: str) -> DataFrame:
    """Centred sum over ``size`` with zeros outside, divided by size; shorter series stay as they are."""
    w, n = _over(by, order), F.count("*").over(Window.partitionBy(*by))
    mean = F.sum(value).over(w.rowsBetween(-(size // 2), size - 1 - size // 2)) / size
    return frames.withColumn(name, F.when(n < size, F.col(value)).otherwise(mean))


def moving_average_valid(frames: DataFrame, by, order, value: str, size: int, name: str) -> DataFrame:
    """Mean of each full window that begins at a frame; NULL where fewer frames are left."""
    w = _over(by, order).rowsBetween(0, size - 1)
    return frames.withColumn(name, F.when(F.count("*").over(w) == size, F.avg(value).over(w)))


def rolling_median(frames: DataFrame, by, order, value: str, half: int, name: str) -> DataFrame:
    """Median of a centred window that is cut off at the ends."""
    return frames.withColumn(name, F.percentile(value, 0.5).over(_over(by, order).rowsBetween(-half, half)))


def median_filter_zero(frames: DataFrame, by, order, value: str, size: int, name: str) -> DataFrame:
    """Median of a centred window with zeros outside."""
    seen = F.collect_list(value).over(_over(by, order).rowsBetween(-(size // 2), size // 2))
    padded = F.sort_array(F.concat(seen, F.array_repeat(F.lit(0.0), size - F.size(seen))))
    return frames.withColumn("__seen", padded).withColumn(name, F.get("__seen", F.lit(size // 2))).drop("__seen")


def fold_outliers(frames: DataFrame, by, order, pitch: str, name: str, half: int = 20, octave: float = 12.0, within: float = 1.5, longest: int = 12, least: int = 5) -> DataFrame:
    """Pitches an octave off the rolling median come back by one, in runs of fewer than ``longest`` voiced frames.

    NULL pitches are left out of windows and runs; series of fewer than ``least`` voiced frames stay.
    """
    voiced = rolling_median(frames.filter(F.col(pitch).isNotNull()), by, order, pitch, half, "__mid")
    w = _over(by, order)
    gap = F.col(pitch) - F.col("__mid")
    off = voiced.withColumns({"__off": F.abs(F.abs(gap) - octave) < within, "__up": gap > 0, "__n": F.count("*").over(Window.partitionBy(*by))})
    new = (F.col("__off") != F.lag("__off", 1, False).over(w)).cast("int")
    numbered = off.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    short = F.count("*").over(Window.partitionBy(*by, "__run")) < longest
    fixed = F.when(F.col("__off") & short & (F.col("__n") >= least), F.col(pitch) + F.when(F.col("__up"), -octave).otherwise(octave)).otherwise(F.col(pitch))
    folded = numbered.withColumn(name, fixed).drop("__mid", "__off", "__up", "__n", "__new", "__run")
    return folded.unionByName(frames.filter(F.col(pitch).isNull()).withColumn(name, F.col(pitch)))


def interpolate(frames: DataFrame, by, order, at: str, value: str, name: str, log: bool = False) -> DataFrame:
    """NULLs filled linearly in ``at`` (of logarithms, if log), the ends held; a series of NULLs stays."""
    w = _over(by, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.log(value) if log else F.col(value).cast("double")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), v.alias("v")))
    near = frames.withColumn("__known", known).withColumns({"__a": F.last("__known", True).over(back), "__b": F.first("__known", True).over(ahead)})
    a, b = F.col("__a"), F.col("__b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col(at) - a["t"]) / (b["t"] - a["t"])
    filled = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] >= b["t"]), a["v"]).otherwise(line)
    return near.withColumn(name, F.exp(filled) if log else filled).drop("__known", "__a", "__b")


def robust_scale(frames: DataFrame, by, value: str, name: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Clipped to 0..1 between two exact percentiles of its series; 0 where they don't differ.

    The percentiles are a pre-aggregated table that joins back, so a long series is never held in one window.
    """
    p = frames.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__p"))
    spread = F.col("__p")[1] - F.col("__p")[0]
    scaled = F.when(F.col(value).isNull(), F.lit(None)).when(spread > 0, F.least(F.greatest((F.col(value) - F.col("__p")[0]) / spread, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return frames.join(p, by).withColumn(name, scaled).drop("__p")


def rise(frames: DataFrame, by, order, value: str, name: str) -> DataFrame:
    """Positive part of the change from the frame before; 0 first."""
    return frames.withColumn(name, F.greatest(F.coalesce(F.col(value) - F.lag(value).over(_over(by, order)), F.lit(0.0)), F.lit(0.0)))


def vector_flux(frames: DataFrame, by, order, vector: str, name: str, positive: bool = False) -> DataFrame:
    """Mean absolute change of a vector's entries from frame to frame (the first takes the second's), or the sum of rises (first 0)."""
    w = _over(by, order)
    before = frames.withColumn("__before", F.lag(vector).over(w))
    change = F.zip_with(vector, "__before", lambda x, y: x.cast("double") - y.cast("double"))
    if positive:
        total = F.aggregate(change, F.lit(0.0), lambda a, d: a + F.greatest(d, F.lit(0.0)))
        return before.withColumn(name, F.coalesce(total, F.lit(0.0))).drop("__before")
    mean = F.aggregate(change, F.lit(0.0), lambda a, d: a + F.abs(d)) / F.size(vector)
    first = before.withColumn("__flux", F.when(F.col("__before").isNotNull(), mean))
    return first.withColumn(name, F.coalesce("__flux", F.lead("__flux").over(w), F.lit(0.0))).drop("__before", "__flux")


def peak_near(frames: DataFrame, by, order, value: str, name: str, half: int = 1) -> DataFrame:
    return frames.withColumn(name, F.max(value).over(_over(by, order).rowsBetween(-half, half)))


def mean_near(frames: DataFrame, by, order, value: str, name: str, half: int = 2) -> DataFrame:
    return frames.withColumn(name, F.avg(value).over(_over(by, order).rowsBetween(-half, half)))


def steady(frames: DataFrame, by, order, pitch: str, name: str, below: float = 0.03, clear: float | None = None) -> DataFrame:
    """Voiced frames whose mean absolute slope over five frames is below ``below``; a missing slope counts as 1.

    clear: frames whose mean is that near to ``below``, or nearer, are left out: there the order of the sum decides.
    """
    w = _over(by, order)
    slope = frames.withColumn("__slope", F.coalesce(F.abs(F.col(pitch) - F.lag(pitch).over(w)), F.lit(1.0)))
    mean = moving_average_edge(slope, by, order, "__slope", 5, "__mean")
    if clear is not None:
        mean = mean.filter(F.abs(F.col("__mean") - below) > clear)
    return mean.withColumn(name, F.col(pitch).isNotNull() & (F.col("__mean") < below)).drop("__slope", "__mean")


def steepest(frames: DataFrame, by, index: str, order, value: str) -> DataFrame:
    """by, at: the first frame with the largest change from the frame before."""
    w = _over(by, order)
    change = frames.withColumn("__d", F.abs(F.col(value) - F.lag(value).over(w))).filter("__d IS NOT NULL")
    return change.groupBy(*by).agg(F.min(F.struct((-F.col("__d")).alias("d"), F.col(index).alias("at")))["at"].alias("at"))


def jump_share(frames: DataFrame, by, order, cents: str, jump: float = 650.0) -> DataFrame:
    """by, jump_share: of the steps between neighbouring voiced frames those of at least ``jump`` cents."""
    voiced = frames.filter(F.col(cents).isNotNull())
    step = voiced.withColumn("__step", F.abs(F.col(cents) - F.lag(cents).over(_over(by, order))))
    return step.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("__step").isNotNull(), (F.col("__step") >= jump).cast("double"))), F.lit(0.0)).alias("jump_share"))


def running_monotone(spans: DataFrame, by, order, start: str, end: str, low: Column) -> DataFrame:
    """start_fixed and end_fixed: no span starts before the one before ended, nor ends before it starts."""
    w = _over(by, order)
    reach = F.greatest(F.max(F.greatest(F.col(start), F.col(end))).over(w.rowsBetween(Window.unboundedPreceding, 0)), low)
    fixed = spans.withColumn("end_fixed", reach)
    return fixed.withColumn("start_fixed", F.greatest(F.col(start), F.lag("end_fixed").over(w), low))


def strictly_increasing(rows: DataFrame, by, order, value: str, name: str, eps: float = 1e-4) -> DataFrame:
    """Each value at least eps above the one before, in closed form."""
    w = _over(by, order)
    k = F.row_number().over(w)
    shifted = rows.withColumn("__k", k).withColumn("__v", F.col(value) - F.col("__k") * eps)
    return shifted.withColumn(name, F.max("__v").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__k") * eps).drop("__k", "__v")


def ticks_without_overlap(notes: DataFrame, by, order, start: str, end: str, least: int = 15) -> DataFrame:
    """tick_start and tick_end: notes pushed right until none overlaps and each lasts ``least`` ticks, in closed form."""
    w = _over(by, order)
    k = F.row_number().over(w) - 1
    held = notes.withColumns({"__k": k, "__from": F.greatest(F.col(start), F.lit(0))}).withColumn("__a", F.greatest(F.col(end), F.col("__from") + least) - least * F.col("__k"))
    done = held.withColumn("tick_end", F.max("__a").over(w.rowsBetween(Window.unboundedPreceding, 0)) + least * F.col("__k"))
    return done.withColumn("tick_start", F.greatest(F.col("__from"), F.coalesce(F.lag("tick_end").over(w), F.lit(0)))).drop("__k", "__a", "__from")
