"""Scalar, text and score functions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import pitch, scores, text


@pytest.fixture(scope="module")
def one(spark):
    """Values of expressions, evaluated in one row."""

    def values(*cols):
        return [x for x in spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()]

    return values


def test_pitch(one):
    null = F.lit(None).cast("double")
    got = one(pitch.hz_to_midi(F.lit(880.0)), pitch.hz_to_midi(F.lit(0.0)), pitch.midi_to_hz(F.lit(57.0)), pitch.midi_to_hz(null), pitch.hz_to_cents(F.lit(110.0)), pitch.hz_to_cents(null), pitch.cents_to_hz(F.lit(2400.0)), pitch.db_to_gain(F.lit(20.0)))
    assert got == pytest.approx([81.0, None, 220.0, 0.0, 1200.0, None, 220.0, 10.0])
    assert one(pitch.seconds_to_ticks(F.lit(1.0), 120.0), pitch.frame_nearest(F.lit(0.025), 0.01), pitch.frame_floor(F.lit(0.029), 0.01), pitch.midi_clamp(F.lit(300)), pitch.midi_clamp(F.lit(None).cast("int")), pitch.next_power_of_two(F.lit(1000))) == [960, 2, 2, 127, None, 1024]
    arr = F.array(*(F.lit(float(x)) for x in range(10)))
    assert one(pitch.slice_span(arr, F.lit(0.25), F.lit(0.55), 10), pitch.slice_span(arr, F.lit(0.9), F.lit(0.1), 10), pitch.slice_span_truncated(arr, F.lit(0.29), F.lit(5.0), 10)) == [[2.0, 3.0, 4.0, 5.0], [], [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]]
    assert one(*(pitch.triangle(F.lit(x)) for x in (0.0, 0.5, 1.0, 1.5, 2.0, 3.25))) == [0.0, 0.5, 1.0, 0.5, 0.0, 0.75]
    kx, ky = F.array(*map(F.lit, (0.0, 1.0, 3.0))), F.array(*map(F.lit, (10.0, 20.0, 0.0)))
    assert one(*(pitch.piecewise_linear(F.lit(x), kx, ky) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 9.0))) == [10.0, 10.0, 15.0, 20.0, 10.0, 0.0]
    assert one(*(pitch.trapezoid(F.lit(t), F.lit(1.0), F.lit(2.0), F.lit(0.1), F.lit(0.2)) for t in (0.5, 1.05, 1.5, 1.9, 2.5))) == pytest.approx([0.0, 0.5, 1.0, 0.5, 0.0])
    assert one(pitch.crossfade(F.array(*map(F.lit, (1.0, 1.0, 1.0))), F.array(*map(F.lit, (0.0, 0.0, 5.0))), 2))[0] == [1.0, 1.0, 0.5, 5.0]
    assert one(pitch.level_gain(F.lit(-20.0), F.lit(0.0), null), pitch.level_gain(F.lit(-20.0), F.lit(-50.0), F.lit(10.0)), pitch.follow_pitch(F.lit(60.0), F.lit(62.0), 0.5, F.lit(-12.0)), pitch.follow_pitch(F.lit(60.0), null, 0.5, F.lit(0.0))) == [0.0, 18.0, 49.0, 60.0]


def test_unit_quality(one):
    null = F.lit(None).cast("double")

    def plain(fd, std, nuc, f0, med, e, tone, v):
        clip = lambda x: min(1.0, max(0.0, x))
        return (0.25 * min(fd, 0.35) / 0.35 + 0.2 * math.exp(-(std or 2.0)) + (0.15 * min(nuc, 0.25) / 0.25 if nuc is not None else 0) + 0.15 * (0.5 if f0 is None else math.exp(-abs(f0 - med) / 4))
                + 0.1 * (0.5 if e is None else clip((e + 45) / 30)) + 0.1 * {1: 1.0, 2: 0.8, 3: 0.55, 4: 0.85, 5: 0.5}.get(tone, 0.5) + 0.05 * v)

    r = random.Random(1)
    for _ in range(6):
        args = [r.random(), r.choice([None, 0.0, r.random()]), r.choice([None, r.random()]), r.choice([None, 50 + r.random()]), 51.0, r.choice([None, -50 * r.random()]), r.randint(0, 6), r.random()]
        cols = [null if a is None else F.lit(a) for a in args]
        assert one(scores.unit_quality(*cols, F.lit(False)))[0] == pytest.approx(plain(*args))
    assert one(scores.unit_quality(*cols, F.lit(True))) == [-1.0]


def test_costs(one):
    lit = F.lit
    got = one(
        scores.target_cost(lit(5.0), lit(0.6), lit(0.3), lit(0.5), lit(3), lit(1), lit(1)),
        scores.join_cost(lit(True), lit(False), lit(False), lit(2.0), lit(-3.0)),
        scores.join_cost(lit(True), lit(True), lit(False), lit(2.0), lit(-3.0)),
        scores.join_cost(lit(False), lit(False), lit(False), lit(2.0), lit(None).cast("double")),
        scores.transpose_cost(lit(-6.0), lit(2.0)),
    )
    want = 0.15 * 5 + 0.15 * 4 + 0.6 * math.log(2) ** 2 + 1.5 * 0.5 + 0.3 - 0.15 + 2.5
    assert got == pytest.approx([want, 0.6 + 0.15 + 0.06 + 0.06, 0.0, 0.0, 2 * (0.6 + 4)])


def test_roles_reasons_and_guesses(one):
    lit = F.lit
    none = lit(None).cast("double")
    assert one(scores.reject_reason(lit(0.05), lit(0.1), lit(0.1), none), scores.reject_reason(lit(0.1), lit(0.1), lit(0.3), lit(0.09)), scores.reject_reason(lit(0.1), lit(0.1), lit(0.3), none)) == ["too_short", "misaligned", ""]
    assert one(*(scores.recommended_role(*map(lit, x)) for x in ((0.04, 90.0, 90.0, 0.0, 1.0), (0.2, 50.0, 60.0, 0.6, 0.0), (0.2, 50.0, 70.0, 0.1, 0.5), (0.2, 50.0, 10.0, 0.1, 0.5)))) == ["weak", "onset", "sustain", "general"]
    assert one(*(scores.cv_boundary_guess(lit(i), lit(1.0), lit(2.0), f) for i, f in (("", none), ("m", none), ("b", none), ("b", lit(0.1)), ("b", lit(0.9))))) == pytest.approx([1.0, 1.06, 1.3, 1.1, 1.7])
    oto = scores.oto_from_regions(lit(0.25), none, none, none)
    assert one(*(oto[k] for k in ("consonant_ms", "cutoff_ms", "preutterance_ms", "overlap_ms"))) == pytest.approx([50.0, -37.5, 35.0, 15.75])
    cv = scores.cv_timing(lit(1.0), lit(1.0), none, none, lit(1.5))
    assert one(*(cv[k] for k in ("clip_start", "clip_end", "fixed", "preutter", "overlap"))) == pytest.approx([0.98, 1.5, 0.04, 0.02, 0.01])


def test_pinyin_split(one):
    cases = {"ba": ("b", "a"), "zhi": ("zh", "ir"), "zi": ("z", "i0"), "ju": ("j", "v"), "quan": ("q", "van"), "yuan": ("", "van"), "wei": ("", "uei"), "liu": ("l", "iou"), "dui": ("d", "uei"), "lun": ("l", "uen"), "lv": ("l", "v"), "er": ("", "er"), "a": ("", "a")}
    got = one(*(F.struct(text.initial_of(F.lit(p)), text.final_of(F.lit(p))) for p in cases))
    assert [tuple(g) for g in got] == list(cases.values())


def test_groups_spelling_and_names(one):
    lit = F.lit
    assert one(*(text.vowel_group(lit(p)) for p in ("ni", "yuan", "jia", "zhi", "lue"))) == ["i", "en0", "a", "ir", "e0"]
    assert one(*(text.consonant_group(lit(p)) for p in ("jia", "shuo", "hong", "hu", "mian", "mang", "a", "yu", "you", "wo", "xue", "su", "song"))) == ["jy", "shw", "h", "hw", "my", "m", "ou", "v", "y", "w", "xw", "sw", "s"]
    assert one(text.voicebank_spelling(lit("lve")), text.voicebank_spelling(lit("ma"))) == ["lue", "ma"]
    assert one(*(text.vowel_nucleus(lit(f)) for f in ("iao", "in", "ir", "i0", "uei", "v", "iou"))) == ["a", "n", "r", "0", "e", "v", "o"]
    names = one(*(text.safe_name(lit(n)) for n in ("ba", "- ba", "a b", "a R", "ai b", "a ba", "??")))
    assert len(set(names)) == 7 and names[0] == "ba" and names[-1] == "x"
    assert one(text.main_vowel_position(lit("ai")), text.main_vowel_position(lit("uo")), text.main_vowel_position(lit("ang"))) == [0.3, 0.7, 0.35]
    sid = one(text.source_id(lit("/m/My Song (1).wav")))[0]
    assert sid.startswith("My_Song_1_") and len(sid) == len("My_Song_1_") + 8


def test_phones(one):
    lit = F.lit
    words = lambda s: F.split(lit(s), " ")
    assert one(text.split_phones(words("n j ow˧˥ n aj˨˩˦"), F.array(lit("niu"), lit("nai"))), text.split_phones(words("i˥ n w ej˥˩"), F.array(lit("yin"), lit("wei"))), text.split_phones(words("a˥"), F.array(lit("a"), lit("a")))) == [[["n", "j", "ow˧˥"], ["n", "aj˨˩˦"]], [["i˥", "n"], ["w", "ej˥˩"]], None]
    assert one(*(text.rule_pronunciation(lit(x)) for x in ("ni3", "xue2", "ri4", "guang1", "x9"))) == ["n i˨˩˦", "ɕ e˧˥", "ʐ̩˥˩", "k w a˥ ŋ", None]
    assert tuple(one(text.phone_signature(lit("ɲ i˨˩˦")))[0]) == ("n", "i") and one(text.is_consonant(lit("tsʰ")), text.is_consonant(lit("a˥"))) == [True, False]
    assert tuple(one(text.toned(lit("lv4")))[0]) == ("lv", 4)


def test_plain_text(one):
    assert one(text.normalize_text(F.lit("Ａ 2 个　x")), text.strip_time_tags(F.lit("[00:1]a[b]c")), text.quoted(F.lit("a'b"), "'"), text.is_hanzi(F.lit("银")), text.is_hanzi(F.lit("A"))) == ["A二个x", "ac", "'a''b'", True, False]


def test_token_distance(spark):
    r = random.Random(3)

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    pairs = [([f"w{r.randint(0, 150)}" for _ in range(r.randint(0, 60))], [f"w{r.randint(0, 150)}" for _ in range(r.randint(0, 60))]) for _ in range(30)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = [x[0] for x in df.select(text.token_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [brute(a, b) for a, b in pairs]
