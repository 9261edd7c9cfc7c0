"""Whole flows: building a bank step by step, exporting a voicebank, choosing and planning units for a song, editing segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline import schema
from loomline.functions import scores, text
from loomline.operators import aggregates, joins, lattice, ranking, rendering, runs
from loomline.sources import files


@dataclass(frozen=True)
class BuildOptions:
    use_labels: bool = True
    longest_label: float = 60.0
    force: bool = False


def ingest(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Rows for sources of a listing (path, duration, label) that the bank doesn't have."""
    named = listing.withColumn("source_id", text.source_id("path"))
    return schema.conform(joins.pending(named, known, ["source_id"]), schema.SOURCES)


def utterances(sources: DataFrame, speech: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """One utterance for a labelled source that isn't too long, else one for each speech span (source_id, start, end)."""
    labelled = F.col("label").isNotNull() & (F.col("duration") <= options.longest_label) & F.lit(options.use_labels)
    whole = sources.filter(labelled).select("source_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.col("label").alias("text"), F.lit("label").alias("text_origin"))
    rest = sources.filter(~F.coalesce(labelled, F.lit(False))).select("source_id", "duration")
    spans = speech.join(rest, "source_id", "left_semi").select("source_id", "start", "end", F.lit("").alias("text"), F.lit("").alias("text_origin"))
    both = whole.unionByName(spans)
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("start")) - 1
    return schema.conform(both.withColumn("utt_id", F.format_string("%s_u%03d", "source_id", n)), schema.UTTERANCES)


def number_units(units: DataFrame, first: int, order: list[str], path: str) -> DataFrame:
    """unit_id u000000 on, counting on from ``first``, in the order given.

    Ids are dense without one task sorting all rows: rows are range-partitioned and stored at ``path`` with their partition and place in it
    (range bounds are sampled, so they must not be drawn twice), then each partition's offset is added.
    """
    at = F.monotonically_increasing_id()
    ranged = units.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.shiftright(at, 33), "__nth": at.bitwiseAND((1 << 33) - 1)})
    ranged.write.mode("overwrite").parquet(path)
    stored = units.sparkSession.read.parquet(path)
    sizes = stored.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    numbered = stored.join(F.broadcast(bases), "__part")
    return numbered.withColumn("unit_id", F.format_string("u%06d", first + F.col("__base") + F.col("__nth"))).drop("__part", "__nth", "__base")


def build_bank(spark: SparkSession, folder: str, listing: DataFrame, speech: DataFrame, aligned: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """Extends the bank in folder by new sources and returns its units.

    aligned: recorded outputs of an aligner (source_id, start, end, cv_boundary, char, pinyin, tone, features ...). Only utterances
    that the ledger lacks are taken, and they enter it whether or not they gave units; ``force`` begins with an empty ledger.
    A run appends its own rows to each table as a version; readers take the versions that are finished, from the last forced one on. A
    version's folder can be made once, so of two writers at a time one fails.
    """
    versions = files.open_table(spark, f"{folder}/versions", "v bigint, base bigint")
    last = versions.agg(F.max(F.struct("v", "base")).alias("m")).select("m.*").first()
    v, base = (last["v"], last["base"]) if last["v"] is not None else (0, 1)
    base = v + 1 if options.force else base

    def finished(name: str, ddl: str, upto: int) -> DataFrame:
        held = files.open_table(spark, f"{folder}/{name}", f"{ddl}, v bigint")
        return held.filter(F.col("v").between(base, upto)).drop("v")

    kinds = {"sources": schema.SOURCES, "utterances": schema.UTTERANCES, "units": schema.UNITS, "ledger": "utt_id string"}
    sources, utts, units, ledger = (finished(name, ddl, v) for name, ddl in kinds.items())
    new = ingest(listing, sources)
    fresh = utterances(new, speech, options)
    todo = joins.pending(joins.pending(utts.unionByName(fresh), ledger, ["utt_id"]), units, ["utt_id"])
    cut = todo.select("utt_id", "source_id", F.col("start").alias("__s"), F.col("end").alias("__e"))
    inside = joins.points_in_intervals(aligned, cut, ["source_id"], "start", "__s", "__e").drop("__s", "__e")
    parts = inside.withColumns({"initial": text.initial_of("pinyin"), "final": text.final_of("pinyin")})
    judged = parts.withColumn("rejected", scores.reject_reason(F.col("end") - F.col("start"), F.col("end") - F.col("cv_boundary"), "voiced_ratio", "align_error"))
    numbered = number_units(judged, units.count(), ["source_id", "utt_id", "start"], f"{folder}/numbering/v={v + 1}")
    linked = runs.link_neighbours(numbered, ["source_id", "utt_id"], ["start", "unit_id"], "unit_id", "start", "end", 0.03)
    for name, df in (("sources", new), ("utterances", fresh), ("units", schema.conform(linked, schema.UNITS)), ("ledger", todo.select("utt_id"))):
        schema.rounded(df, 5).write.mode("errorifexists").parquet(f"{folder}/{name}/v={v + 1}")
    spark.createDataFrame([(v + 1, base)], "v bigint, base bigint").write.mode("append").parquet(f"{folder}/versions")
    return finished("units", schema.UNITS, v + 1)


def voicebank(units: DataFrame) -> DataFrame:
    """alias, unit_id, right_id, source_id and timing of the entries: best unit of each syllable, best phrase-initial one ('- x'),
    best transition ('vowel consonant') and best ending ('vowel R')."""
    usable = units.filter((F.col("rejected") == "") | F.col("rejected").isNull())
    median = aggregates.exact_quantile(usable, "f0_midi", 0.5)
    final, nucleus = F.col("end") - F.col("cv_boundary"), F.col("nucleus_end") - F.col("nucleus_start")
    rated = usable.withColumns(
        {
            "quality": F.round(scores.unit_quality(final, "f0_std", nucleus, "f0_midi", F.lit(median).cast("double"), "energy_db", "tone", "voiced_ratio", F.lit(False)), 9),
            "syllable": text.voicebank_spelling("pinyin"),
            "vowel": text.vowel_group("pinyin"),
            "consonant": text.consonant_group("pinyin"),
        }
    )
    cv = ranking.best_by(rated.withColumn("alias", F.col("syllable")), ["alias"], -F.col("quality"), ["unit_id"], ["unit_id"])
    first = ranking.best_by(rated.filter("prev_id IS NULL").withColumn("alias", F.concat(F.lit("- "), "syllable")), ["alias"], -F.col("quality"), ["unit_id"], ["unit_id"])
    # neighbours that were rejected keep their place: such a unit gives neither a transition nor an ending
    pairs, ends = ranking.best_pairs(rated, "unit_id", "next_id", "vowel", "consonant", "quality", ["unit_id"], F.lit(True))
    bounds = usable.select("unit_id", "source_id", "start", "cv_boundary", "end", "nucleus_start", "nucleus_end")
    timing = lambda df, cols: df.withColumns(cols).select("alias", "unit_id", "right_id", "source_id", *cols)
    none = F.lit(None).cast("string")
    heads = cv.unionByName(first).withColumn("right_id", none).join(bounds, "unit_id")
    right = usable.select(F.col("unit_id").alias("right_id"), F.col("start").alias("__rs"), F.col("cv_boundary").alias("__rb"))
    across = pairs.join(bounds, "unit_id").join(right, "right_id")
    tails = ends.withColumn("right_id", none).join(bounds, "unit_id")
    own = F.col("end") - F.col("cv_boundary")
    out = timing(heads, scores.cv_timing("start", "cv_boundary", "nucleus_start", "nucleus_end", "end"))
    out = out.unionByName(timing(across, scores.transition_timing("end", own, "__rs", "__rb")))
    return out.unionByName(timing(tails, scores.ending_timing("end", own)))


@dataclass(frozen=True)
class SelectOptions:
    keep: int = 40
    join_weight: float = 1.0
    max_shift: int = 36
    any_key: bool = False


def targets_of(syllables: DataFrame, notes: DataFrame) -> DataFrame:
    """Syllables with the duration-weighted pitch of their notes, vowel length and phrase flags."""
    pitch = notes.groupBy("song_id", "syllable").agg(aggregates.weighted_mean(F.col("pitch"), F.col("end") - F.col("start")).alias("pitch"))
    joined = syllables.join(pitch.withColumnRenamed("syllable", "idx"), ["song_id", "idx"], "left")
    flagged = runs.phrase_flags(joined, ["song_id"], ["idx"], "start", "end", 0.15)
    return flagged.withColumn("vowel", F.col("end") - F.col("vowel_start"))


def select_units(targets: DataFrame, units: DataFrame, options: SelectOptions = SelectOptions()) -> DataFrame:
    """song_id, idx, unit_id, tier, total_cost, transpose: the cheapest sequence of units for each song."""
    usable = units.filter((F.col("rejected") == "") & F.col("f0_midi").isNotNull())
    median = F.lit(aggregates.exact_quantile(usable, "f0_midi", 0.5)).cast("double")
    step = 1 if options.any_key else 12
    shifts = range(-options.max_shift, options.max_shift + 1, step)
    weight = F.greatest(F.col("vowel"), F.lit(1e-3))
    shift = ranking.best_shift(targets.filter("pitch IS NOT NULL"), ["song_id"], lambda s: scores.transpose_cost(F.col("pitch") + s - median, weight), shifts).select("song_id", F.col("shift").alias("transpose"))
    wanted = targets.join(shift, "song_id").select("song_id", "idx", "pinyin", F.col("final").alias("final_"), text.vowel_nucleus("final").alias("vowel_"), "pitch", "vowel", "joined", "phrase_start", "phrase_end", "transpose")
    w = Window.partitionBy("source_id", "utt_id").orderBy("start", "unit_id")
    placed = units.withColumn("__pos", F.row_number().over(w))  # rejected units count, and break diagonals
    final = F.col("end") - F.col("cv_boundary")
    nucleus = F.col("nucleus_end") - F.col("nucleus_start")
    offered = placed.filter((F.col("rejected") == "") & F.col("f0_midi").isNotNull()).select(
        "pinyin", F.col("final").alias("final_"), text.vowel_nucleus("final").alias("vowel_"), "unit_id", "prev_id", "next_id", F.col("source_id").alias("source"), F.col("utt_id").alias("chain"), F.col("__pos").alias("pos"),
        "f0_midi", F.col("energy_db").alias("energy"), F.col("tone").alias("unit_tone"), final.alias("unit_final"),
        F.round(scores.unit_quality(final, "f0_std", nucleus, "f0_midi", median, "energy_db", "tone", "voiced_ratio", F.lit(False)), 9).alias("quality"),
    )
    found = ranking.tiered_candidates(wanted, offered, ["pinyin", "final_", "vowel_"], offered)
    gap = F.col("pitch") + F.col("transpose") - F.col("f0_midi")
    edges = (F.col("phrase_start") & F.col("prev_id").isNull()).cast("int") + (F.col("phrase_end") & F.col("next_id").isNull()).cast("int")
    cost = F.round(scores.target_cost(F.coalesce(gap, F.lit(0.0)), "vowel", "unit_final", "quality", "unit_tone", edges, "tier"), 9)
    costed = found.withColumns({"cost": cost, "shift": F.coalesce(gap, F.lit(0.0))})
    ranked = costed.withColumn("rank", F.row_number().over(Window.partitionBy("song_id", "idx").orderBy("cost", "unit_id")))
    pruned = lattice.with_rescue(ranked, "song_id", "idx", "chain", "pos", "rank", options.keep)
    chosen = lattice.select_sequence(pruned.select("song_id", "idx", "unit_id", "next_id", "source", "shift", "energy", "cost", "tier", "joined", "rank"), "song_id", "idx", ["rank"], options.join_weight)
    return chosen.join(shift, "song_id")


def plan_render(syllables: DataFrame, chosen: DataFrame, units: DataFrame, max_stretch: float = 2.5) -> DataFrame:
    """Placements of the chosen units with phrases that can be rendered apart."""
    own = units.select("unit_id", F.col("start").alias("unit_start"), F.col("cv_boundary").alias("boundary"), F.col("end").alias("unit_end"), "nucleus_start", "nucleus_end", "source_id")
    syl = syllables.select("song_id", "idx", F.col("start").alias("syl_start"), "vowel_start", F.col("end").alias("syl_end"))
    placed = rendering.plan_placements(syl.join(chosen, ["song_id", "idx"]).join(own, "unit_id"), "song_id", "idx", max_stretch)
    return runs.merge_groups(placed, ["song_id"], "out_start", "out_end", 0.08, ["idx"])


def carry_over(segments: DataFrame, previous: DataFrame, by: list[str]) -> DataFrame:
    """New segments (segment_id, start, end) with alias and notes of the previous one they overlap most, and with its regions and
    score too if its bounds are the same; ``pending`` marks those that need analysis."""
    names = ["alias", "notes", "regions", "score"]
    old = previous.select(*by, F.col("segment_id").alias("old_id"), F.col("start").alias("old_start"), F.col("end").alias("old_end"), *names)
    matched = joins.best_overlap(segments, old, by, "segment_id", ("start", "end"), ("old_start", "old_end"), "old_id")
    same = (F.abs(F.col("start") - F.col("old_start")) <= 0.002) & (F.abs(F.col("end") - F.col("old_end")) <= 0.002)
    found = matched.select(*by, "segment_id", "alias", "notes", F.when(same, F.col("regions")).alias("regions"), F.when(same, F.col("score")).alias("score"))
    out = segments.join(found, [*by, "segment_id"], "left").withColumns({"alias": F.coalesce("alias", F.lit("")), "notes": F.coalesce("notes", F.lit(""))})
    return out.withColumn("pending", F.col("regions").isNull() | F.col("score").isNull())


class History:
    """Undo and redo over versions of a small document; a new version ends what could be redone."""

    def __init__(self, depth: int = 100):
        self.depth, self.past, self.future = depth, [], []

    def push(self, state) -> None:
        self.past, self.future = [*self.past, state][-self.depth :], []

    def undo(self, current):
        if not self.past:
            return current
        self.future.append(current)
        return self.past.pop()

    def redo(self, current):
        if not self.future:
            return current
        self.past.append(current)
        return self.future.pop()
