"""Documents of whole songs and voicebanks, and settings: JSON and text that other programs read."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.sources import sinks

S = ["song_id"]


def _listed(rows: DataFrame, order: str, columns: list[str], name: str) -> DataFrame:
    """song_id and the rows of each song in order, as an array of structs with these columns."""
    held = F.sort_array(F.collect_list(F.struct(order, F.struct(*columns).alias("__row"))))
    return rows.groupBy(*S).agg(F.transform(held, lambda x: x["__row"]).alias(name))


def score_documents(songs: DataFrame, syllables: DataFrame, notes: DataFrame, frames: DataFrame) -> DataFrame:
    """song_id and text: one JSON document a song with its syllables, notes, pitch and loudness (two decimals).

    songs: song_id, source, duration, tempo, frame_period; a song without rows of a kind has an empty list.
    """
    columns = ["char", "pinyin", "tone", "initial", "final", "start", "vowel_start", "end"]
    held = songs.join(_listed(syllables, "idx", columns, "syllables"), S, "left").join(_listed(notes, "n", ["start", "end", "pitch", "syllable", "slur"], "notes"), S, "left")
    curves = frames.groupBy(*S).agg(F.sort_array(F.collect_list(F.struct("i", F.bround("hz", 2).alias("hz"), F.bround("db", 2).alias("db")))).alias("__f"))
    pick = lambda c: F.transform("__f", lambda x: F.coalesce(x[c], F.lit(0.0)))
    full = held.join(curves.select(*S, pick("hz").alias("f0_hz"), pick("db").alias("loudness_db")), S, "left")
    lists = {c: F.coalesce(c, F.array().cast(full.schema[c].dataType)) for c in ("syllables", "notes", "f0_hz", "loudness_db")}
    body = F.struct("source", "duration", "tempo", "frame_period", *(v.alias(k) for k, v in lists.items()))
    return full.select(*S, F.to_json(body, {"ignoreNullFields": "false"}).alias("text"))


_SCORE = (
    "source string, duration double, tempo double, frame_period double, syllables array<struct<char:string,pinyin:string,tone:int,initial:string,final:string,start:double,vowel_start:double,end:double>>, "
    "notes array<struct<start:double,end:double,pitch:int,syllable:int,slur:boolean>>, f0_hz array<double>, loudness_db array<double>"
)


def read_scores(documents: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """songs, syllables, notes and frames from documents (song_id, text); a missing tempo is 120, a missing frame period 0.01, a missing source ''."""
    found = documents.select(*S, F.from_json(text, _SCORE).alias("d"))
    default = lambda c, x: F.coalesce(F.col(f"d.{c}"), F.lit(x)).alias(c)
    songs = found.select(*S, default("source", ""), F.col("d.duration").alias("duration"), default("tempo", 120.0), default("frame_period", 0.01))
    rows = lambda c, n: found.select(*S, F.posexplode(f"d.{c}").alias(n, "x")).select(*S, n, "x.*")
    zipped = F.arrays_zip(F.col("d.f0_hz").alias("hz"), F.col("d.loudness_db").alias("db"))
    frames = found.select(*S, F.posexplode(zipped).alias("i", "x")).select(*S, "i", "x.hz", "x.db")
    return {"songs": songs, "syllables": rows("syllables", "idx"), "notes": rows("notes", "n"), "frames": frames}


def render_reports(chosen: DataFrame, syllables: DataFrame, notes: DataFrame, units: DataFrame) -> DataFrame:
    """song_id and text: one JSON report a song of what was chosen (song_id, idx, unit_id, tier, transpose) for each syllable.

    A syllable without notes counts as pitch 0, a unit without pitch has no shift.
    """
    own = units.select("unit_id", F.col("char").alias("unit_char"), F.col("pinyin").alias("unit_pinyin"), F.col("source_id").alias("source"), F.bround("start", 3).alias("source_time"), "f0_midi")
    mean = notes.groupBy(*S, F.col("syllable").alias("idx")).agg(F.avg("pitch").alias("__p"))
    rows = syllables.join(chosen, [*S, "idx"]).join(own, "unit_id").join(mean, [*S, "idx"], "left")
    shift = F.bround(F.coalesce("__p", F.lit(0.0)) + F.col("transpose") - F.col("f0_midi"), 2)
    flat = rows.select(*S, "idx", "transpose", "char", "pinyin", F.bround("vowel_start", 3).alias("time"), F.col("unit_id").alias("unit"), "unit_char", "unit_pinyin", "source", "source_time", "tier", shift.alias("shift_st"))
    columns = ["char", "pinyin", "time", "unit", "unit_char", "unit_pinyin", "source", "source_time", "tier", "shift_st"]
    head = flat.groupBy(*S).agg(F.min("transpose").alias("transpose"), F.count("*").alias("targets"), F.avg((F.col("tier") == 0).cast("double")).alias("exact"))
    body = F.struct("transpose", F.struct("targets", "exact").alias("summary"), "syllables")
    return head.join(_listed(flat, "idx", columns, "syllables"), S).select(*S, F.to_json(body, {"ignoreNullFields": "false"}).alias("text"))


def voicebank_entries(entries: DataFrame) -> DataFrame:
    """file_name and timing in ms of voicebank entries (alias, clip_start, clip_end, fixed, preutter, overlap in seconds), as lines want them.

    Clips are written with 50 ms before them where the recording has as much, so their offset is at most that.
    """
    length = (F.col("clip_end") - F.col("clip_start")) * 1000.0
    timing = {
        "offset_ms": F.least(F.lit(50.0), F.greatest(F.col("clip_start"), F.lit(0.0)) * 1000.0),
        "consonant_ms": F.least(F.col("fixed") * 1000.0, length),
        "cutoff_ms": -length,
        "preutterance_ms": F.col("preutter") * 1000.0,
        "overlap_ms": F.col("overlap") * 1000.0,
    }
    return sinks.oto_file_names(entries).withColumns(timing)


def voicebank_texts(entries: DataFrame, name: str, groups: DataFrame, phonemizer: str) -> DataFrame:
    """file, n, line: the lines of a voicebank's text files: timing (one decimal), groups of vowels and consonants, and descriptions.

    groups: section, key, members: an array of syllables.
    """
    spark = entries.sparkSession
    n = F.row_number().over(Window.orderBy("alias"))
    timed = voicebank_entries(entries)
    oto = timed.select(F.lit("oto.ini").alias("file"), n.alias("n"), sinks.oto_line(timed, digits=1).alias("line"))
    sections = groups.groupBy("section").agg(F.sort_array(F.collect_list(F.concat("key", F.lit("="), F.array_join("members", ",")))).alias("rows"))
    lines = sections.select("section", F.posexplode(F.concat(F.array(F.concat(F.lit("["), "section", F.lit("]"))), "rows")).alias("k", "line"))
    presamp = lines.select(F.lit("presamp.ini").alias("file"), F.row_number().over(Window.orderBy("section", "k")).alias("n"), "line")
    about = [("character.txt", [f"name={name}"]), ("character.yaml", [f"name: {name}", "text_file_encoding: utf-8", f"default_phonemizer: {phonemizer}", "singer_type: utau"]), ("readme.txt", [f"{name}: lyrics are toneless pinyin, v for ü"])]
    fixed = spark.createDataFrame([(f, k + 1, x) for f, rows in about for k, x in enumerate(rows)], "file string, n int, line string")
    return oto.unionByName(presamp).unionByName(fixed)


def load_settings(text: str | None, defaults):
    """Settings (a dataclass whose fields may be dataclasses) from a JSON text: unknown keys go, missing ones keep their default."""
    data = json.loads(text) if text else {}

    def merged(own, values: dict):
        known = {f.name: getattr(own, f.name) for f in fields(own)}
        given = {k: merged(known[k], v or {}) if is_dataclass(known[k]) else v for k, v in values.items() if k in known}
        return type(own)(**(known | given))

    return merged(defaults, data)


def save_settings(settings) -> str:
    return json.dumps(asdict(settings), ensure_ascii=False)


def report_progress(callback: Callable[[int, str], None] | None, value: float, message: str) -> None:
    """Progress in whole per cent, clipped to 0..100, to whoever listens."""
    if callback is not None:
        callback(int(min(max(value, 0), 100)), message)
