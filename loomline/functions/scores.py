"""Quality, cost and class expressions over unit, target and segment columns: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.pitch import _c, clamp

# Preference of tones for sung units, cost of fallback tiers, cost of tones on long notes.
TONE_PREFERENCE = {1: 1.0, 2: 0.8, 3: 0.55, 4: 0.85, 5: 0.5}
TIER_PENALTY = {0: 0.0, 1: 2.5, 2: 5.0, 3: 15.0}
LONG_NOTE_TONE_COST = {3: 0.3, 5: 0.4}
LONG_NOTE_SECONDS = 0.5


def lookup(key, values: dict, default=None) -> Column:
    """values[key] as a CASE; default where the key is unknown."""
    key, out = _c(key), None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def truthy(x, default) -> Column:
    """x, with NULL and zero replaced."""
    return F.coalesce(F.nullif(_c(x).cast("double"), F.lit(0.0)), _c(default).cast("double"))


def unit_quality(final, f0_std, nucleus, f0, median, energy, tone, voiced_ratio, rejected) -> Column:
    """How well a unit holds up alone, up to 1; -1 for rejected units."""
    parts = (
        0.25 * F.least(_c(final), F.lit(0.35)) / 0.35
        + 0.20 * F.exp(-truthy(f0_std, F.lit(2.0)))
        + 0.15 * F.when(_c(nucleus).isNull(), F.lit(0.0)).otherwise(F.least(_c(nucleus), F.lit(0.25)) / 0.25)
        + 0.15 * F.coalesce(F.exp(-F.abs(_c(f0) - _c(median)) / 4.0), F.lit(0.5))
        + 0.10 * F.coalesce(clamp((_c(energy) + 45.0) / 30.0, 0.0, 1.0), F.lit(0.5))
        + 0.10 * lookup(tone, TONE_PREFERENCE, 0.5)
        + 0.05 * F.coalesce(_c(voiced_ratio), F.lit(0.0))
    )
    return F.when(_c(rejected), F.lit(-1.0)).otherwise(parts)


def target_cost(pitch_gap, vowel, final, quality, tone, phrase_matches, tier, pitch_weight: float = 1.0, stretch_weight: float = 1.0) -> Column:
    """Cost of singing a target with a unit. pitch_gap: semitones apart; phrase_matches: how many phrase edges agree."""
    return target_cost_of(F.abs(_c(pitch_gap)), log_stretch(vowel, final), vowel, quality, tone, phrase_matches, tier, pitch_weight, stretch_weight)


def log_stretch(vowel, final) -> Column:
    return F.log(F.greatest(_c(vowel) / F.greatest(_c(final), F.lit(0.03)), F.lit(1e-3)))


def target_cost_of(distance, stretch, vowel, quality, tone, phrase_matches, tier, pitch_weight: float = 1.0, stretch_weight: float = 1.0) -> Column:
    """target_cost from the absolute pitch gap and log_stretch, for callers that hold both (higher-order functions evaluate each mention anew)."""
    d, stretch, vowel = _c(distance), _c(stretch), _c(vowel)
    far = F.greatest(d - 3.0, F.lit(0.0))
    slow, fast = F.greatest(stretch, F.lit(0.0)), F.greatest(-stretch, F.lit(0.0))
    return (
        pitch_weight * (0.15 * d + 0.15 * far * far)
        + stretch_weight * (0.6 * slow * slow + 0.1 * fast)
        + 1.5 * (1.0 - F.greatest(_c(quality), F.lit(0.0)))
        + F.when(vowel > LONG_NOTE_SECONDS, lookup(tone, LONG_NOTE_TONE_COST, 0.0)).otherwise(F.lit(0.0))
        - 0.15 * _c(phrase_matches)
        + lookup(tier, TIER_PENALTY, 15.0)
    )


def join_cost(joined, contiguous, same_source, shift_gap, energy_gap, weight: float = 1.0) -> Column:
    """Cost of a unit after another. Free at a phrase start and where they follow each other in the recording."""
    spliced = weight * (0.6 + 0.15 * (~_c(same_source)).cast("int") + 0.03 * F.abs(_c(shift_gap)) + 0.02 * F.coalesce(F.abs(_c(energy_gap)), F.lit(0.0)))
    return F.when(~_c(joined) | F.coalesce(_c(contiguous), F.lit(False)), F.lit(0.0)).otherwise(spliced)


def transpose_cost(gap, weight) -> Column:
    d = F.abs(_c(gap))
    far = F.greatest(d - 4.0, F.lit(0.0))
    return _c(weight) * (0.1 * d + far * far)


def reject_reason(duration, final, voiced_ratio, align_error, min_duration=0.06, min_final=0.04, min_voiced=0.3, max_error=0.08) -> Column:
    """The first check that fails, or ''."""
    return (
        F.when(_c(duration) < min_duration, F.lit("too_short"))
        .when(_c(final) < min_final, F.lit("final_too_short"))
        .when(_c(voiced_ratio) < min_voiced, F.lit("unvoiced"))
        .when(_c(align_error) > max_error, F.lit("misaligned"))
        .otherwise(F.lit(""))
    )


def duration_score(duration) -> Column:
    gap = _c(duration) - 0.28
    return F.exp(-gap * gap / (2.0 * 0.2 * 0.2))


def clarity(attack, tail, silence, duration) -> Column:
    return 100.0 * (0.34 * _c(attack) + 0.22 * (1.0 - _c(tail)) + 0.22 * (1.0 - _c(silence)) + 0.22 * duration_score(duration))


def stability(f0, energy, duration, confidence, jumps) -> Column:
    held = 0.44 * _c(f0) + 0.24 * _c(energy) + 0.14 * duration_score(duration) + 0.18 * _c(confidence)
    return 100.0 * held * (1.0 - F.least(F.lit(0.35), 0.35 * _c(jumps)))


def recommended_role(duration, clear, stable, attack, voiced) -> Column:
    duration, stable = _c(duration), _c(stable)
    return (
        F.when((duration < 0.05) | (_c(clear) < 25.0), F.lit("weak"))
        .when((_c(attack) >= 0.55) & (duration <= 0.28) & (stable < 72.0), F.lit("onset"))
        .when((stable >= 62.0) & (_c(voiced) >= 0.30) & (duration >= 0.10), F.lit("sustain"))
        .otherwise(F.lit("general"))
    )


def novelty(onset, flux, rise, loud) -> Column:
    """Boundary evidence of a frame from four features that are scaled to 0..1."""
    return 0.42 * _c(onset) + 0.30 * _c(flux) + 0.18 * _c(rise) + 0.10 * _c(loud)


def segment_class(duration, peak, energy_ratio, zcr, flatness, silence, breath_s, breath_energy, breath_zcr, breath_flatness) -> dict[str, Column]:
    """Flags silence_like, breath_like and voiced_like of a segment summary."""
    silent = _c(peak) <= _c(silence) * 1.35
    noisy = (_c(zcr) >= breath_zcr) | (_c(flatness) >= breath_flatness)
    return {
        "silence_like": silent,
        "breath_like": (_c(duration) <= breath_s) & (_c(energy_ratio) <= breath_energy) & noisy & ~silent,
        "voiced_like": (_c(energy_ratio) >= 0.72) & (_c(zcr) <= breath_zcr * 1.1) & (_c(flatness) <= breath_flatness * 1.05),
    }


def mergeable(left: dict, right: dict, strength, silent, weak: float, micro: float, syllable: float, breath: float) -> Column:
    """Whether the boundary between two segments goes; left and right give duration, breath_like and voiced_like."""
    s, (dl, bl, vl), (dr, br, vr) = _c(strength), *((_c(x["duration"]), _c(x["breath_like"]), _c(x["voiced_like"])) for x in (left, right))
    any_of = (
        (bl & br)
        | ((dl <= micro) & (dr <= micro) & (s < weak + 0.08))
        | (bl & vr & (dl <= breath))
        | (br & vl & (dr <= breath))
        | ((dl <= syllable) & ~vl & vr & (s < weak + 0.10))
        | ((dr <= syllable) & ~vr & vl & (s < weak))
        | (((dl <= micro) | (dr <= micro)) & (s < weak))
    )
    return ~_c(silent) & any_of


def oto_from_regions(duration, onset, nucleus, tail) -> dict[str, Column]:
    """Voicebank timing in ms of an edited segment; onset, nucleus and tail are lengths in seconds or NULL."""
    ms = F.greatest(_c(duration) * 1000.0, F.lit(1.0))
    at_least = lambda x, low: F.when(_c(x).isNotNull(), F.greatest(_c(x) * 1000.0, F.lit(low)))
    onset_ms = F.coalesce(at_least(onset, 0.0), F.lit(0.0))
    tail_guess = F.greatest(F.lit(20.0), ms * 0.15)
    tail_ms = F.coalesce(at_least(tail, 15.0), tail_guess)
    nucleus_ms = F.coalesce(at_least(nucleus, 20.0), F.greatest(ms - tail_guess, F.lit(20.0)))
    consonant = F.least(ms - 5.0, F.greatest(F.lit(25.0), onset_ms + F.least(F.lit(50.0), nucleus_ms * 0.25)))
    preutter = F.least(consonant, F.greatest(F.lit(15.0), F.when(onset_ms > 0, onset_ms * 0.85).otherwise(consonant * 0.7)))
    overlap = F.least(preutter * 0.55, F.greatest(F.lit(5.0), F.when(onset_ms > 0, onset_ms * 0.45).otherwise(preutter * 0.45)))
    return {"offset_ms": F.lit(0.0), "consonant_ms": consonant, "cutoff_ms": -F.least(ms - 1.0, F.greatest(F.lit(15.0), tail_ms)), "preutterance_ms": preutter, "overlap_ms": overlap}


def cv_timing(start, boundary, nucleus_start, nucleus_end, end) -> dict[str, Column]:
    """Clip bounds and timing of a consonant-vowel entry, in seconds."""
    start, boundary, end = _c(start), _c(boundary), _c(end)
    pre = F.greatest(boundary - start, F.lit(0.0))
    lead = F.when(pre < 0.02, F.lit(0.02)).otherwise(F.lit(0.0))
    clip = start - lead
    return {
        "clip_start": clip,
        "clip_end": F.greatest(F.coalesce(_c(nucleus_end), end), boundary + 0.6 * (end - boundary)),
        "fixed": F.greatest(F.coalesce(_c(nucleus_start), boundary) - clip, pre + lead + 0.02),
        "preutter": pre + lead,
        "overlap": F.when(pre >= 0.02, pre * 0.5).otherwise(F.lit(0.01)),
    }


def transition_timing(left_end, left_final, right_start, right_boundary) -> dict[str, Column]:
    """The same for a vowel-consonant entry that spans two neighbours."""
    tail = F.least(F.lit(0.12), 0.5 * _c(left_final))
    clip = _c(left_end) - tail
    return {"clip_start": clip, "clip_end": _c(right_boundary) + 0.01, "fixed": _c(right_boundary) - clip, "preutter": _c(right_start) - clip, "overlap": tail * 0.5}


def ending_timing(end, final) -> dict[str, Column]:
    tail = F.least(F.lit(0.15), 0.6 * _c(final))
    return {"clip_start": _c(end) - tail, "clip_end": _c(end) + 0.08, "fixed": tail * 0.5, "preutter": F.lit(0.03), "overlap": F.lit(0.03)}


def cv_boundary_guess(initial, start, end, first_voiced) -> Column:
    """Where the vowel begins. first_voiced: seconds from start to the longest voiced run, or NULL."""
    initial, start = _c(initial), _c(start)
    long = _c(end) - start
    rest = F.when(_c(first_voiced).isNull(), 0.3 * long).otherwise(F.least(_c(first_voiced), 0.7 * long))
    return F.when(initial == "", start).when(initial.isin("m", "n", "l", "r"), start + F.least(F.lit(0.06), 0.25 * long)).otherwise(start + rest)
