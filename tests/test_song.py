"""The song flow on a small song whose answers can be read off."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomline.plans import song


@pytest.fixture(scope="module")
def parts(spark):
    hz = [0.0] * 20 + [220.0] * 60 + [0.0] * 3 + [220.0] * 12 + [0.0] * 30 + [440.0] * 50 + [0.0] * 45
    frames = spark.createDataFrame([("s", i, x, -20.0 if x else -70.0) for i, x in enumerate(hz)], "song_id string, i int, hz double, db double")
    rows = [("s", 0, "好", "hao", 3, "h", "ao"), ("s", 1, "安", "an", 1, "", "an"), ("s", 2, "了", "le", 5, "l", "e")]
    syllables = spark.createDataFrame(rows, "song_id string, idx int, char string, pinyin string, tone int, initial string, final string")
    tokens = spark.createDataFrame([("s", 0, 0.15, 0.6), ("s", 1, 1.25, 1.6)], "song_id string, idx int, start double, end double")
    return frames, syllables, tokens


def test_syllables_and_notes(parts):
    timed, notes = song.analyze_song(*parts)
    got = {r["idx"]: r for r in timed.collect()}
    assert len(got) == 3 and all(r["start"] <= r["vowel_start"] < r["end"] for r in got.values())
    assert got[0]["vowel_start"] == pytest.approx(0.20) and got[0]["end"] == pytest.approx(0.95)  # over a gap of three frames to the end of voicing
    assert got[1]["vowel_start"] == pytest.approx(1.25) and got[1]["end"] == pytest.approx(2.14)  # the third, without a token, borrowed the rest
    assert all(a["end"] <= b["start"] + 1e-9 for a, b in ((got[0], got[1]), (got[1], got[2])))
    found = notes.orderBy("n").collect()
    assert [(r["pitch"], r["syllable"], r["slur"]) for r in found] == [(57, 0, False), (69, 1, False), (69, 2, False)]
    assert found[0]["start"] == pytest.approx(0.20) and found[0]["end"] == pytest.approx(0.95)


def test_lines_refine_what_agrees(spark, parts):
    frames, syllables, tokens = parts
    spans = song.segmentation.split_on_silence(frames, ["song_id"], "i", "db", 0.01, max_chunk=20.0, min_silence=0.3, pad=0.12).orderBy("start").collect()
    first = spans[0]["start"]
    near = [("s", 0, 0, 0.20 - first, 0.30 - first, 0.62 - first), ("s", 1, 0, 9.0, 9.1, 9.2)]
    lines = spark.createDataFrame(near, "song_id string, line int, pos int, start double, boundary double, end double")
    got = {r["idx"]: r for r in song.analyze_song(frames, syllables, tokens, lines)[0].collect()}
    assert got[0]["start"] == pytest.approx(0.20) and got[0]["vowel_start"] == pytest.approx(0.30)
    assert got[1]["start"] == pytest.approx(1.25)  # too far off to be taken
    empty = frames.limit(0)
    assert song.analyze_song(empty, syllables.limit(0), tokens.limit(0))[1].filter(F.lit(True)).collect() == []
