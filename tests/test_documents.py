"""Score documents, reports, voicebank texts and settings: written, read back, compared."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from loomline.sources import documents


def test_score_round_trip(spark):
    songs = spark.createDataFrame([("a", "x.wav", 1.5, 100.0, 0.01), ("b", "", 0.0, 120.0, 0.01)], "song_id string, source string, duration double, tempo double, frame_period double")
    syllables = spark.createDataFrame([("a", 1, "安", "an", 1, "", "an", 0.5, 0.5, 1.0), ("a", 0, "好", "hao", 3, "h", "ao", 0.0, 0.1, 0.5)], "song_id string, idx int, char string, pinyin string, tone int, initial string, final string, start double, vowel_start double, end double")
    notes = spark.createDataFrame([("a", 0, 0.1, 0.5, 60, 0, False)], "song_id string, n int, start double, end double, pitch int, syllable int, slur boolean")
    frames = spark.createDataFrame([("a", 1, 220.126, -20.0), ("a", 0, None, -70.123)], "song_id string, i int, hz double, db double")
    texts = documents.score_documents(songs, syllables, notes, frames)
    got = {r["song_id"]: json.loads(r["text"]) for r in texts.collect()}
    assert got["a"]["f0_hz"] == [0.0, 220.13] and got["a"]["loudness_db"] == [-70.12, -20.0] and [s["char"] for s in got["a"]["syllables"]] == ["好", "安"]
    assert got["b"]["notes"] == [] and got["b"]["f0_hz"] == []
    back = documents.read_scores(texts)
    assert sorted(map(tuple, back["syllables"].select(syllables.columns).collect())) == sorted(map(tuple, syllables.collect()))
    assert sorted(map(tuple, back["notes"].select(notes.columns).collect())) == sorted(map(tuple, notes.collect()))
    assert sorted(map(tuple, back["songs"].select(songs.columns).collect())) == sorted(map(tuple, songs.collect()))
    assert sorted((r["i"], r["hz"], r["db"]) for r in back["frames"].collect()) == [(0, 0.0, -70.12), (1, 220.13, -20.0)]
    short = documents.read_scores(spark.createDataFrame([("c", '{"duration": 2.0, "other": 1}')], "song_id string, text string"))
    assert tuple(short["songs"].first()) == ("c", "", 2.0, 120.0, 0.01)


def test_report(spark):
    chosen = spark.createDataFrame([("a", 0, "u1", 0, 12), ("a", 1, "u2", 1, 12)], "song_id string, idx int, unit_id string, tier int, transpose int")
    syllables = spark.createDataFrame([("a", 0, "好", "hao", 0.12345), ("a", 1, "安", "an", 0.5)], "song_id string, idx int, char string, pinyin string, vowel_start double")
    notes = spark.createDataFrame([("a", 0, 60), ("a", 0, 62)], "song_id string, syllable int, pitch int")
    units = spark.createDataFrame([("u1", "好", "hao", "s", 1.23456, 70.5), ("u2", "案", "an", "s", 2.0, None)], "unit_id string, char string, pinyin string, source_id string, start double, f0_midi double")
    report = json.loads(documents.render_reports(chosen, syllables, notes, units).first()["text"])
    assert report["transpose"] == 12 and report["summary"] == {"targets": 2, "exact": 0.5}
    assert [(r["time"], r["unit"], r["source_time"], r["shift_st"]) for r in report["syllables"]] == [(0.123, "u1", 1.235, 2.5), (0.5, "u2", 2.0, None)]


def test_voicebank_texts(spark):
    entries = spark.createDataFrame([("ba", 1.0, 1.5, 0.2, 0.1, 0.05), ("- ba", 0.02, 0.4, 0.9, 0.1, 0.05)], "alias string, clip_start double, clip_end double, fixed double, preutter double, overlap double")
    groups = spark.createDataFrame([("VOWEL", "a", ["ba", "pa"]), ("CONSONANT", "b", ["ba"])], "section string, key string, members array<string>")
    files: dict[str, list] = {}
    for r in documents.voicebank_texts(entries, "tenor", groups, "zh").orderBy("file", "n").collect():
        files.setdefault(r["file"], []).append(r["line"])
    assert files["oto.ini"] == ["head_ba.wav=- ba,20.0,380.0,-380.0,100.0,50.0", "ba.wav=ba,50.0,200.0,-500.0,100.0,50.0"]
    assert files["presamp.ini"] == ["[CONSONANT]", "b=ba", "[VOWEL]", "a=ba,pa"] and files["character.yaml"][0] == "name: tenor"


@dataclass
class Inner:
    a: int = 1
    b: str = "x"


@dataclass
class Outer:
    rate: int | None = None
    inner: Inner = field(default_factory=Inner)


def test_settings_and_progress():
    assert documents.load_settings(None, Outer()) == Outer()
    found = documents.load_settings('{"rate": 8, "gone": 1, "inner": {"b": "y", "c": 2}}', Outer())
    assert found == Outer(8, Inner(1, "y")) and documents.load_settings(documents.save_settings(found), Outer()) == found
    said = []
    documents.report_progress(lambda v, m: said.append((v, m)), 130.5, "done")
    documents.report_progress(None, 3, "x")
    assert said == [(100, "done")]
