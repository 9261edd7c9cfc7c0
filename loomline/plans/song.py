"""The song flow: syllables and notes of songs from frames, lyrics and the recorded outputs of aligners.

Every step works on all songs at once. What needs a model comes in as a table: timings of characters (an aligner's tokens), and for pause-separated
lines timings of syllables (a phone aligner's, in seconds from the line's start).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import pitch, scores
from loomline.operators import aggregates, joins, rolling, runs, segmentation, sequence

S = ["song_id"]


@dataclass(frozen=True)
class SongOptions:
    period: float = 0.01
    least: float = 0.06
    start_within: float = 0.12
    end_within: float = 0.15
    slack: int = 6


def timed_syllables(syllables: DataFrame, tokens: DataFrame, durations: DataFrame, least: float = 0.06) -> DataFrame:
    """syllables (song_id, idx, ...) with start and end: the tokens (song_id, idx, start, end) in order, missing ones at the end without length, repaired.

    durations: song_id, duration.
    """
    lists = tokens.groupBy(*S).agg(F.sort_array(F.collect_list(F.struct("idx", "start", "end"))).alias("__t"))
    counts = syllables.groupBy(*S).agg(F.count("*").alias("__n"))
    held = counts.join(durations, S).join(lists, S, "left")
    spans = F.coalesce(F.transform("__t", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), F.array().cast("array<struct<start:double,end:double>>"))
    padded = held.withColumn("__s", sequence.pad_positions(spans, F.col("__n"), F.col("duration")))
    fixed = padded.select(*S, F.posexplode(sequence.repair_spans(F.col("__s"), F.lit(0.0), F.col("duration"), least)).alias("idx", "span"))
    return syllables.join(fixed.select(*S, F.col("idx").cast(syllables.schema["idx"].dataType).alias("idx"), "span.start", "span.end"), [*S, "idx"])


def with_vowels(timed: DataFrame, frames: DataFrame, period: float = 0.01) -> DataFrame:
    """timed with vowel_start: by rule, from the longest voiced run within the syllable. frames: song_id, i, hz."""
    placed = frames.filter("hz > 0").select(*S, "i", (F.col("i") * period).alias("__at"))
    inside = joins.points_in_intervals(placed, timed.select(*S, "idx", "start", "end"), S, "__at", "start", "end")
    longest = runs.longest_run(runs.runs(inside.select(*S, "idx", "i"), [*S, "idx"], "i", F.lit(True)), [*S, "idx"])
    first = timed.join(longest.select(*S, "idx", F.col("start").alias("__run")), [*S, "idx"], "left")
    voiced = F.greatest(F.col("__run") * period - F.col("start"), F.lit(0.0))
    guess = scores.cv_boundary_guess("initial", "start", "end", F.when(F.col("__run").isNotNull(), voiced))
    return first.withColumn("vowel_start", guess).drop("__run")


def refine_by_lines(timed: DataFrame, lines: DataFrame, line_timings: DataFrame, options: SongOptions = SongOptions()) -> DataFrame:
    """timed with the bounds of a phone aligner where it agrees.

    A syllable belongs to the first line (song_id, line, start, end) that holds its middle. line_timings: song_id, line, pos, start, boundary, end; a line
    whose number of timings differs from that of its syllables is left as it is.
    """
    spans = lines.select(*S, "line", F.col("start").alias("__ls"), F.col("end").alias("__le"))
    middle = timed.select(*S, "idx", ((F.col("start") + F.col("end")) / 2).alias("__mid"))
    held = joins.points_in_intervals(middle, spans, S, "__mid", "__ls", "__le")
    member = held.groupBy(*S, "idx").agg(F.min(F.struct("line", "__ls")).alias("__l")).select(*S, "idx", "__l.line", F.col("__l.__ls").alias("__from"))
    found = joins.zip_positions(member, line_timings, [*S, "line"], ["idx"], ["pos"], strict=True)
    refined = found.filter(F.col("start").isNotNull()).select(*S, "idx", *((F.col("__from") + F.col(c)).alias(c) for c in ("start", "end", "boundary")))
    out = joins.agreeing(timed, refined, [*S, "idx"], options.start_within, options.end_within)
    own = refined.select(*S, "idx", F.col("boundary").alias("__b"))
    vowel = F.when(F.col("initial") != "", F.col("__b")).otherwise(F.col("start"))
    return out.join(own, [*S, "idx"], "left").withColumn("vowel_start", F.when(F.col("refined"), vowel).otherwise(F.col("vowel_start"))).drop("__b", "refined")


def settle_ends(timed: DataFrame, frames: DataFrame, options: SongOptions = SongOptions()) -> DataFrame:
    """Syllables that don't overlap, each as long as its voicing lasts."""
    last = frames.groupBy(*S).agg(((F.max("i") + 1) * options.period).alias("__whole"))
    w = Window.partitionBy(*S).orderBy("idx")
    limited = timed.join(last, S).withColumn("__limit", F.coalesce(F.lead("start").over(w), "__whole"))
    cut = limited.withColumn("end", F.least("end", "__limit"))
    at = lambda c: (F.col(c) / options.period + 1e-9).cast("int")
    marked = cut.withColumns({"__end": at("end"), "__stop": at("__limit")})
    grown = runs.extend_while(marked, frames.select(*S, F.col("i").cast("int").alias("i"), "hz"), S, ["idx"], "__end", "__stop", "i", F.col("hz") > 0, options.slack)
    reach = F.when(F.col("extended") > F.col("__end"), F.col("extended") * options.period).otherwise((F.col("__end") + 1) * options.period)
    end = F.greatest("end", F.least("__limit", reach))
    vowel = F.least(F.greatest("vowel_start", "start"), F.col("end") - 0.02)
    return grown.withColumn("end", end).withColumn("vowel_start", vowel).drop("__whole", "__limit", "__end", "__stop", "extended")


def tuning_of(frames: DataFrame) -> DataFrame:
    """song_id, tuning: the singer's distance from the semitone grid."""
    midi = frames.withColumn("__midi", pitch.hz_to_midi("hz"))
    steady = rolling.steady(midi, S, ["i"], "__midi", "__steady")
    return aggregates.circular_offset(steady, S, "__midi", F.col("__steady")).select(*S, "tuning")


def notes_of_song(timed: DataFrame, frames: DataFrame, options: SongOptions = SongOptions()) -> DataFrame:
    """song_id, n, start, end, pitch, syllable, slur: notes of each syllable's vowel; one without pitch takes the last note's before it, else 60."""
    placed = frames.select(*S, F.col("i").cast("long").alias("i"), "hz", ((F.col("i") + 0.5) * options.period).alias("__at"))
    bounds = timed.select(*S, "idx", F.col("vowel_start").alias("a"), F.col("end").alias("b")).join(tuning_of(frames), S)
    held = joins.points_in_intervals(placed, bounds, S, "__at", "a", "b")
    found = segmentation.segment_notes(held.select(*S, "idx", "i", "hz", "a", "b", "tuning"), [*S, "idx"], "i", "hz", "a", "b", "tuning", options.period)
    bare = timed.join(found.select(*S, "idx").distinct(), [*S, "idx"], "left_anti")
    rest = bare.select(*S, "idx", F.lit(0).alias("n"), F.col("vowel_start").alias("start"), "end", F.lit(None).cast("int").alias("pitch"), F.lit(False).alias("slur"))
    w = Window.partitionBy(*S).orderBy("idx", "n")
    known = F.coalesce("pitch", F.last("pitch", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(60))
    both = found.unionByName(rest)
    return both.select(*S, (F.row_number().over(w) - 1).alias("n"), "start", "end", known.alias("pitch"), F.col("idx").alias("syllable"), "slur")


def analyze_song(frames: DataFrame, syllables: DataFrame, tokens: DataFrame, line_timings: DataFrame | None = None, options: SongOptions = SongOptions()) -> tuple[DataFrame, DataFrame]:
    """(syllables with start, vowel_start and end; notes) of songs.

    frames: song_id, i, hz (0 or NULL unvoiced), db; syllables: song_id, idx, char, pinyin, tone, initial, final; tokens: song_id, idx, start, end.
    """
    durations = frames.groupBy(*S).agg(((F.max("i") + 1) * options.period).alias("duration"))
    timed = with_vowels(timed_syllables(syllables, tokens, durations, options.least), frames, options.period)
    if line_timings is not None:
        spans = segmentation.split_on_silence(frames, S, "i", "db", options.period, max_chunk=20.0, min_silence=0.3, pad=0.12)
        lines = sequence.whole_if_empty(spans, durations, S, "duration").withColumn("line", F.row_number().over(Window.partitionBy(*S).orderBy("start")) - 1)
        timed = refine_by_lines(timed, lines, line_timings, options)
    settled = settle_ends(timed.drop("duration"), frames, options)
    return settled, notes_of_song(settled, frames, options)
