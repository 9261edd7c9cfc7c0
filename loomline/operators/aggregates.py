"""Aggregates: exact order statistics, circular means, error reports, apportioning and down-sampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantile(df: DataFrame, value: str, q: float, hold: int = 200_000) -> float | None:
    """The interpolated quantile of a whole column (NULL and NaN left out); None if it is empty.

    A sketch brackets the two ranks, and counting tells whether it is right. While the bracket holds over ``hold`` distinct values it is halved by value
    and the half that holds the ranks is counted again: at most some sixty passes, in practice few. Only rows inside come together.
    F.percentile would gather all distinct values of the table in one task.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    near = F.percentile_approx("v", [max(0.0, q - 1e-3), min(1.0, q + 1e-3)], 10_000)
    n, distinct, bracket, ends = rows.agg(F.count("*"), F.approx_count_distinct("v"), near, F.struct(F.min("v"), F.max("v"))).first()
    if not n:
        return None
    rank, below, inside = q * (n - 1), 0, rows
    first, second = math.floor(rank), math.ceil(rank)
    low, high = ends
    if distinct > hold:
        a, b = bracket
        v, between = F.col("v"), F.col("v").between(a, b)
        less, within, fewer = rows.agg(F.count(F.when(v < a, 1)), F.count(F.when(between, 1)), F.approx_count_distinct(F.when(between, v))).first()
        if less <= first <= second < less + within:
            inside, below, distinct, low, high = rows.filter(between), less, fewer, a, b
    while distinct > hold:
        mid = low + (high - low) / 2
        upto, left, right, last, next_ = inside.agg(
            F.count(F.when(F.col("v") <= mid, 1)), *(F.approx_count_distinct(F.when(c, F.col("v"))) for c in (F.col("v") <= mid, F.col("v") > mid)), F.max(F.when(F.col("v") <= mid, F.col("v"))), F.min(F.when(F.col("v") > mid, F.col("v")))
        ).first()
        if first < below + upto <= second:  # the ranks lie on both sides: their values are the neighbours of mid
            return last + (next_ - last) * (rank - first)
        if second < below + upto:
            inside, distinct, high = inside.filter(F.col("v") <= mid), left, mid
        else:
            inside, distinct, low, below = inside.filter(F.col("v") > mid), right, mid, below + upto
    counted = inside.groupBy("v").agg(F.count("*").alias("c")).toArrow()
    order = np.argsort(v := counted.column("v").to_numpy())
    upto = below + np.cumsum(counted.column("c").to_numpy()[order])
    one, other = (float(v[order][np.searchsorted(upto, k, side="right")]) for k in (first, second))
    return one + (other - one) * (rank - first)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, from the exact error of the product and of the sum; plain where the split would overflow."""
    head = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    ah, bh, p = head(a), head(b), a * b
    al, bl = a - ah, b - bh
    low = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    rest = (p - (s - (s - p))) + (c - (s - p))
    exact = s + (rest + low)
    return F.when(F.isnan(exact) | F.abs(exact).isin(math.inf), s).otherwise(exact)


def quantile_by(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """by, name: the interpolated quantile of each group (NULL left out), to the last bit that of SQL, where low * (1 - d) + high * d is fused.

    F.percentile rounds once more, which shows where the result is rounded or compared. A group is sorted by one task, which spills.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    ranked = known.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__v")) - 1)
    at = known.groupBy(*by).agg(((F.count("*") - 1) * F.lit(q)).alias("__at"))
    near = ranked.join(at.hint("merge"), by).filter((F.col("__r") == F.floor("__at")) | (F.col("__r") == F.ceil("__at")))
    ends = near.groupBy(*by).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.first(F.col("__at") - F.floor("__at")).alias("__d"))
    d = F.col("__d")
    between = F.when(d == 0, F.col("__low")).otherwise(fused(F.col("__low"), 1.0 - d, F.col("__high") * d))
    return ends.select(*by, between.alias(name))


def round_scaled(c: Column, digits: int) -> Column:
    """Rounded as SQL rounds doubles: the scaled number half away from zero; F.round takes the shortest decimal of the number itself."""
    return F.round(c * 10.0**digits, 0) / 10.0**digits


def index_by(units: DataFrame, keys: list[str], members: list[str], order: list[str]) -> DataFrame:
    """keys with the ordered list of their members (for small groups; large ones stay rows)."""
    return units.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[m for m in members if m not in order]))).alias("members"))


def voiced_summary(frames: DataFrame, by: list[str], pitch: str, energy: str) -> DataFrame:
    """Share of voiced frames, mean energy, and median and population deviation of the pitch (NULL under two voiced frames)."""
    few = F.count(pitch) < 2
    return frames.groupBy(*by).agg(
        F.avg(F.col(pitch).isNotNull().cast("double")).alias("voiced_ratio"),
        F.avg(energy).alias("energy_db"),
        F.when(~few, F.percentile(pitch, 0.5)).alias("f0_midi"),
        F.when(~few, F.stddev_pop(pitch)).alias("f0_std"),
    )


def weighted_mean(value, weight, least: float = 1e-3) -> Column:
    w = F.greatest(weight, F.lit(least))
    return F.sum(w * value) / F.sum(w)


def circular_offset(df: DataFrame, by: list[str], pitch: str, steady: Column, least: int = 50, concentration: float = 0.35) -> DataFrame:
    """Mean distance to the semitone grid (-0.5..0.5), as a mean of angles; 0 with few or scattered votes."""
    angle = (F.col(pitch) - F.bround(pitch)) * (2 * math.pi)
    votes = df.groupBy(*by).agg(F.count(F.when(steady, 1)).alias("n"), F.avg(F.when(steady, F.cos(angle))).alias("x"), F.avg(F.when(steady, F.sin(angle))).alias("y"))
    clear = (F.col("n") >= least) & (F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) >= concentration)
    return votes.select(*by, "n", F.when(clear, F.atan2("y", "x") / (2 * math.pi)).otherwise(F.lit(0.0)).alias("tuning"))


def spread_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, median distance from it, and deviation over mean."""
    mid = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"), (F.stddev_pop(value) / F.greatest(F.avg(value), F.lit(1e-5))).alias("variation"))
    gap = df.join(mid, by).withColumn("__gap", F.abs(F.col(value) - F.col("median")))
    return gap.groupBy(*by).agg(F.first("median").alias("median"), F.percentile("__gap", 0.5).alias("mad"), F.first("variation").alias("variation"))


def error_report(df: DataFrame, error: Column, by: list[str] = (), limits: tuple[float, ...] = (0.020, 0.050)) -> DataFrame:
    """Bias, mean and median absolute error, and the share below each limit."""
    e = df.withColumn("__e", error).filter("__e IS NOT NULL")
    shares = [F.avg((F.abs("__e") < x).cast("double")).alias(f"below_{round(x * 1000)}ms") for x in limits]
    mid = F.percentile(F.abs("__e"), 0.5) if by else F.lit(exact_quantile(e.select(F.abs("__e").alias("a")), "a", 0.5)).cast("double")
    return e.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__e").alias("bias"), F.avg(F.abs("__e")).alias("mean_abs"), mid.alias("median_abs"), *shares)


def note_accuracy(df: DataFrame, found: str, truth: str) -> DataFrame:
    """Shares of frames with both pitches that agree, are within a semitone, or an octave or so off."""
    gap = F.abs(F.bround(found) - F.bround(truth))
    both = df.filter(F.col(found).isNotNull() & F.col(truth).isNotNull())
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    return both.agg(F.count("*").alias("n"), share(gap == 0, "exact"), share(gap <= 1, "within_semitone"), share(gap >= 11, "octave_off"))


def pitch_error(df: DataFrame, left_cents: str, right_cents: str) -> DataFrame:
    gap = F.abs(F.col(left_cents) - F.col(right_cents))
    both = df.filter(F.col(left_cents).isNotNull() & F.col(right_cents).isNotNull())
    mid = F.lit(exact_quantile(both.select(gap.alias("a")), "a", 0.5)).cast("double")
    return both.agg(mid.alias("median_cents"), F.avg((gap > 50).cast("double")).alias("over_50"))


def pooled_rate(df: DataFrame, errors: str, size: str) -> DataFrame:
    """Errors over tokens, summed before they are divided."""
    return df.agg(F.sum(errors).alias("errors"), F.sum(size).alias("tokens"), (F.sum(errors) / F.greatest(F.sum(size), F.lit(1))).alias("rate"))


def bucket_extremes(df: DataFrame, by: list[str], index: str, value: str, step: int) -> DataFrame:
    """Lowest and highest value of each full bucket of ``step`` frames, as two rows; what is left over at the end goes."""
    cells = df.withColumn("bucket", F.floor(F.col(index) / step)).groupBy(*by, "bucket").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("__n"))
    return cells.filter(F.col("__n") == step).select(*by, "bucket", F.posexplode(F.array("lo", "hi"))).withColumnsRenamed({"pos": "side", "col": "value"})


def apportion(groups: DataFrame, by: list[str], order: list[str], weight: str, items: Column) -> DataFrame:
    """How many of ``items`` each group gets: differences of rounded cumulative shares, so they add up."""
    w = Window.partitionBy(*by).orderBy(*order)
    share = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy(*by))
    upto = groups.withColumn("__upto", F.bround(share * items).cast("long"))
    return upto.withColumn("n_items", F.col("__upto") - F.coalesce(F.lag("__upto").over(w), F.lit(0))).drop("__upto")


def common_readings(readings: DataFrame, key: str, variant: str, order: str, agrees: Column, top: int = 2) -> DataFrame:
    """The most counted variants of a key that agree with its rule, the earliest first among equals."""
    counted = readings.groupBy(key, variant).agg(F.count("*").alias("n"), F.min(order).alias("__first")).filter(agrees)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "__first"))
    return counted.withColumn("rank", nth).filter(F.col("rank") <= top).drop("__first")


def selection_summary(chosen: DataFrame, by: list[str], order: list[str], tier: str, unit_id: str, next_id: str, cost: str) -> DataFrame:
    """Targets, share with an exact unit, joins that follow the recording, and total cost of each sequence."""
    w = Window.partitionBy(*by).orderBy(*order)
    held = chosen.withColumn("__joined", F.coalesce(F.col(next_id) == F.lead(unit_id).over(w), F.lit(False)).cast("int"))
    return held.groupBy(*by).agg(F.count("*").alias("targets"), F.avg((F.col(tier) == 0).cast("double")).alias("exact"), F.sum("__joined").alias("contiguous"), F.sum(cost).alias("cost"))


def reference_level(placements: DataFrame, by: list[str], energy: str, frames: DataFrame, loudness: str, voiced: Column) -> DataFrame:
    """by, energy_level, loudness_level: medians of the placed units' energies and of the song's loudness in voiced frames."""
    own = placements.groupBy(*by).agg(F.percentile(energy, 0.5).alias("energy_level"))
    return own.join(frames.filter(voiced).groupBy(*by).agg(F.percentile(loudness, 0.5).alias("loudness_level")), by, "left")


def normalise_peak(samples: Column, peak: float = 10 ** (-1 / 20)) -> Column:
    """An array scaled so that its largest magnitude is ``peak``; silence stays."""
    top = F.array_max(F.transform(samples, F.abs))
    return F.when(top > 0, F.transform(samples, lambda x: x * (F.lit(peak) / top))).otherwise(samples)


def mix(tracks: DataFrame, by: list[str], samples: str, gain_db: str, limit: float = 0.89) -> DataFrame:
    """Tracks of a group summed sample by sample with their gains, padded to the longest, and limited in level."""
    long = tracks.select(*by, F.pow(F.lit(10.0), F.col(gain_db) / 20.0).alias("__g"), F.posexplode(samples))
    summed = long.groupBy(*by, "pos").agg(F.sum(F.col("col") * F.col("__g")).alias("v"))
    top = summed.groupBy(*by).agg(F.max(F.abs("v")).alias("__top"))
    scaled = F.col("v") * F.when(F.col("__top") > limit, F.lit(limit) / F.col("__top")).otherwise(F.lit(1.0))
    return summed.join(top, by).select(*by, "pos", scaled.alias("v"))
