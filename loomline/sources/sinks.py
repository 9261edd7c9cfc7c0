"""Writers: tables, label tiers, voicebank lines, project text, MIDI and audio.

Text formats are made one row a document or line by expressions and written by Spark; binary files are written by executors
through the same file systems.
"""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline import schema
from loomline.functions.text import quoted, safe_name, voicebank_spelling


def save_table(df: DataFrame, path: str, digits: int = 5) -> None:
    schema.rounded(df, digits).write.mode("overwrite").parquet(path)


def save_json(df: DataFrame, path: str, digits: int = 6) -> None:
    schema.rounded(df, digits).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, for an empty table too."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def lines(df: DataFrame, order: list[str], line, path: str) -> None:
    """One text file of lines in order (formats that one reader takes as a whole)."""
    df.orderBy(*order).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def flat_segments(segments: DataFrame) -> DataFrame:
    """Segments with nested regions and scores as flat columns; the id stands in for an empty alias."""
    out = {"alias": F.coalesce(F.nullif(F.trim("alias"), F.lit("")), F.col("segment_id")), "duration": F.bround(F.col("end") - F.col("start"), 6)}
    for r in ("onset", "nucleus", "tail"):
        for edge in ("start", "end"):
            out[f"{r}_{edge}"] = F.bround(F.col(f"regions.{r}.{edge}"), 6)
    for s in ("clarity_score", "stability_score", "onset_strength", "voiced_ratio", "noise_penalty"):
        out[s] = F.bround(F.col(f"score.{s}"), 4)
    out["recommended_role"] = F.col("score.recommended_role")
    return segments.withColumns(out).drop("regions", "score")


def oto_line(df: DataFrame, fields: tuple[str, ...] = ("offset_ms", "consonant_ms", "cutoff_ms", "preutterance_ms", "overlap_ms"), digits: int = 2):
    """file=alias,a,b,c,d,e"""
    return F.concat(F.format_string("%s=%s,", "file_name", "alias"), F.format_string(",".join([f"%.{digits}f"] * len(fields)), *fields))


def oto_file_names(aliases: DataFrame) -> DataFrame:
    return aliases.withColumn("file_name", F.concat(safe_name("alias"), F.lit(".wav")))


def export_segments(segments: DataFrame, folder: str) -> None:
    """metadata (JSON lines and CSV) and oto lines of edited segments."""
    from loomline.functions.scores import oto_from_regions

    long = lambda r: F.col(f"regions.{r}.end") - F.col(f"regions.{r}.start")
    timing = segments.withColumns(oto_from_regions(F.col("end") - F.col("start"), long("onset"), long("nucleus"), long("tail")))
    rows = flat_segments(timing).withColumn("file_name", F.concat("segment_id", F.lit(".wav")))
    save_json(rows, f"{folder}/metadata.json")
    save_csv(rows, f"{folder}/metadata.csv")
    save_csv(rows.select("file_name", "alias", "offset_ms", "consonant_ms", "cutoff_ms", "preutterance_ms", "overlap_ms", "recommended_role"), f"{folder}/labels.csv")
    lines(rows, ["segment_id"], oto_line(rows), f"{folder}/oto")


def tier_documents(intervals: DataFrame, key: str = "path") -> DataFrame:
    """key and text: label tiers in the long format, quotes doubled."""
    number = lambda c: F.format_string("%s", F.col(c).cast("string"))
    per = Window.partitionBy(key, "tier_ord").orderBy("i")
    item = F.concat_ws("\n", F.format_string("        intervals [%d]:", F.row_number().over(per)), F.concat(F.lit("            xmin = "), number("start")), F.concat(F.lit("            xmax = "), number("end")), F.concat(F.lit("            text = "), quoted("text", '"')))
    items = intervals.withColumns({"__item": item, "__n": F.row_number().over(per)})
    tiers = items.groupBy(key, "tier_ord").agg(F.first("tier").alias("tier"), F.min("start").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__item"))), lambda e: e["__item"]), "\n").alias("items"))
    k = F.row_number().over(Window.partitionBy(key).orderBy("tier_ord"))
    head = F.concat_ws("\n", F.format_string("    item [%d]:", k), F.lit('        class = "IntervalTier"'), F.concat(F.lit("        name = "), quoted("tier", '"')), F.concat(F.lit("        xmin = "), number("lo")), F.concat(F.lit("        xmax = "), number("hi")), F.format_string("        intervals: size = %d", "n"), F.col("items"))
    blocks = tiers.withColumns({"__block": head, "__k": k})
    docs = blocks.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__k", "__block"))), lambda e: e["__block"]), "\n").alias("body"))
    top = F.concat_ws("\n", F.lit('File type = "ooTextFile"'), F.lit('Object class = "TextGrid"'), F.lit(""), F.concat(F.lit("xmin = "), number("lo")), F.concat(F.lit("xmax = "), number("hi")), F.lit("tiers? <exists>"), F.format_string("size = %d", "n"), F.lit("item []:"), F.col("body"), F.lit(""))
    return docs.select(key, top.alias("text"))


def project_text(notes: DataFrame, curves: DataFrame, song: str, tempo: float, singer: str) -> DataFrame:
    """song and text: a project document with notes (n, tick_start, tick_end, tone, slur, pinyin) and pitch curves (x, y)."""
    lyric = quoted(F.when(F.col("slur"), F.lit("+")).otherwise(voicebank_spelling("pinyin")), "'")
    note = F.concat_ws("\n", F.format_string("  - position: %d", "tick_start"), F.format_string("    duration: %d", F.col("tick_end") - F.col("tick_start")), F.format_string("    tone: %d", "tone"), F.concat(F.lit("    lyric: "), lyric))
    body = notes.withColumn("__t", note).groupBy(song).agg(F.max("tick_end").alias("__end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "__t"))), lambda e: e["__t"]), "\n").alias("__notes"))
    points = curves.groupBy(song).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("__p"))
    joined = lambda f: F.array_join(F.transform("__p", lambda p: p[f].cast("string")), ", ")
    curve = F.when(F.size("__p") > 0, F.concat(F.lit("  curves:\n  - abbr: pitd\n    xs: ["), joined("x"), F.lit("]\n    ys: ["), joined("y"), F.lit("]"))).otherwise(F.lit("  curves: []"))
    head = F.concat(F.lit("ustx_version: '0.6'\nresolution: 480\n"), F.lit(f"bpm: {tempo}\ntracks:\n- singer: "), quoted(F.lit(singer), "'"), F.lit("\nvoice_parts:\n- position: 0\n  duration: "), F.col("__end").cast("string"), F.lit("\n  notes:\n"))
    return body.join(points, song, "left").select(song, F.concat(head, "__notes", F.lit("\n"), curve, F.lit("\nwave_parts: []\n")).alias("text"))


def midi_bytes(notes: list[tuple[int, int, int, str]], tempo: float, resolution: int = 480) -> bytes:
    """A one-track MIDI file of (tick_start, tick_end, pitch, lyric) in order; no lyric event for '+'; pitches clamped to 0..127."""

    def varint(n: int) -> bytes:
        out = [n & 127]
        while n := n >> 7:
            out.append(n & 127 | 128)
        return bytes(reversed(out))

    meta = lambda kind, data: bytes([255, kind]) + varint(len(data)) + data
    track, at = b"\0" + meta(0x51, round(60_000_000 / tempo).to_bytes(3, "big")), 0
    for start, end, pitch, lyric in notes:
        key, gap = max(0, min(127, pitch)), max(0, start - at)
        if lyric != "+":
            track += varint(gap) + meta(5, lyric.encode())
            gap = 0
        track += varint(gap) + bytes([0x90, key, 100]) + varint(end - start) + bytes([0x80, key, 0])
        at = end
    track += b"\0" + meta(0x2F, b"")
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, resolution) + b"MTrk" + struct.pack(">I", len(track)) + track


def midi_documents(notes: DataFrame, song: str, tempo: float) -> DataFrame:
    """song and data: MIDI files of notes (tick_start, tick_end, tone, slur, pinyin)."""
    kind = notes.schema[song].dataType.simpleString()

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("tick_start", kind="stable")
        rows = [(int(a), int(b), int(p), "+" if s else str(w)) for a, b, p, s, w in zip(part["tick_start"], part["tick_end"], part["tone"], part["slur"], part["pinyin"])]
        return pd.DataFrame({song: [part[song].iloc[0]], "data": [midi_bytes(rows, tempo)]})

    return notes.groupBy(song).applyInPandas(encode, f"`{song}` {kind}, data binary")


def wav_bytes(samples, rate: int, width: int = 2) -> bytes:
    """PCM audio of samples clipped to -1..1."""
    x = np.clip(np.asarray(samples, float), -1, 1)
    full = (1 << 8 * width - 1) - 1
    data = np.round(x * full).astype("<i4")
    raw = data.astype("<i2").tobytes() if width == 2 else data.view("u1").reshape(-1, 4)[:, :3].tobytes() if width == 3 else data.tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, width, rate, len(x), "NONE", ""))
        f.writeframes(raw)
    return out.getvalue()


def write_audio(clips: DataFrame, folder: str, name: str, samples: str, rate: str, width: int = 2) -> DataFrame:
    """Writes one audio file a row; returns the paths. A retried task overwrites its own files."""

    def write(batches):
        fs, at = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(at, recursive=True)
        for b in batches:
            for n, x, r in zip(b[name], b[samples], b[rate]):
                with fs.open_output_stream(f"{at}/{n}") as f:
                    f.write(wav_bytes(x, int(r), width))
            yield pd.DataFrame({"path": [f"{folder}/{n}" for n in b[name]]})

    return clips.select(name, samples, rate).mapInPandas(write, "path string")


def aligner_corpus(items: DataFrame, lexicon: DataFrame, rule, folder: str) -> None:
    """Label files and the dictionary of distinct tokens that an outside aligner takes. items: utt_id, tokens (array)."""
    from loomline.operators.joins import pronunciations

    tokens = items.select(F.explode("tokens").alias("token")).distinct()
    spoken = pronunciations(tokens, lexicon, "token", rule).select("token", "phones").distinct()
    lines(spoken, ["token", "phones"], F.concat_ws("\t", "token", "phones"), f"{folder}/dictionary")
    items.select("utt_id", F.array_join("tokens", " ").alias("value")).write.mode("overwrite").partitionBy("utt_id").text(f"{folder}/labels")
