"""Pitch, time and level conversions as Column expressions. An unvoiced frame is NULL, never NaN or zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A4_HZ, A4_MIDI, CENTS_BASE_HZ, TICKS_PER_BEAT = 440.0, 69.0, 55.0, 480


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def hz_to_midi(hz) -> Column:
    hz = _c(hz)
    return F.when(hz > 0, A4_MIDI + 12.0 * F.log2(hz / A4_HZ))


def midi_to_hz(midi) -> Column:
    """0.0 where there is no pitch."""
    return F.coalesce(A4_HZ * F.pow(F.lit(2.0), (_c(midi) - A4_MIDI) / 12.0), F.lit(0.0))


def hz_to_cents(hz) -> Column:
    return F.when(_c(hz).isNotNull(), 1200.0 * F.log2(F.greatest(_c(hz), F.lit(1e-5)) / CENTS_BASE_HZ))


def cents_to_hz(cents) -> Column:
    return CENTS_BASE_HZ * F.pow(F.lit(2.0), _c(cents) / 1200.0)


def db_to_gain(db) -> Column:
    return F.pow(F.lit(10.0), _c(db) / 20.0)


def seconds_to_ticks(seconds, tempo) -> Column:
    """Half-even rounding, 480 ticks a beat."""
    return F.bround(_c(seconds) * _c(tempo) / 60.0 * TICKS_PER_BEAT).cast("int")


def frame_nearest(seconds, period: float) -> Column:
    return F.bround(_c(seconds) / period).cast("int")


def frame_floor(seconds, period: float) -> Column:
    """Truncation towards zero, as indexes into painted frames need it."""
    return (_c(seconds) / period).cast("int")


def slice_span(values, start, end, rate) -> Column:
    """Elements [round(start*rate), round(end*rate)) of an array, clamped; empty if inverted."""
    values = _c(values)
    a = F.least(F.greatest(F.bround(_c(start) * rate).cast("int"), F.lit(0)), F.size(values))
    b = F.least(F.greatest(F.bround(_c(end) * rate).cast("int"), F.lit(0)), F.size(values))
    return F.slice(values, a + 1, F.greatest(b - a, F.lit(0)))


def slice_span_truncated(values, start, end, rate) -> Column:
    """The same with truncated bounds, as utterances are cut."""
    values = _c(values)
    a = F.least((_c(start) * rate).cast("int"), F.size(values))
    b = F.least((_c(end) * rate).cast("int"), F.size(values))
    return F.slice(values, a + 1, F.greatest(b - a, F.lit(0)))


def next_power_of_two(x) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(_c(x).cast("double"), F.lit(1.0))))).cast("long")


def clamp(x, low, high) -> Column:
    """NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(low)), F.lit(high)))


def midi_clamp(x) -> Column:
    return clamp(x, 0, 127)


def triangle(phase) -> Column:
    """Back-and-forth position 0..1..0 with period two."""
    return 1.0 - F.abs(F.pmod(_c(phase), F.lit(2.0)) - 1.0)


def piecewise_linear(x, knots_x, knots_y) -> Column:
    """Linear interpolation between ascending knots; the ends hold."""
    x, kx, ky = _c(x), _c(knots_x), _c(knots_y)
    n = F.size(kx)
    at = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(kx, lambda k: k <= x))))
    x0, x1, y0, y1 = F.get(kx, at - 1), F.get(kx, at), F.get(ky, at - 1), F.get(ky, at)
    inner = y0 + (y1 - y0) * (x - x0) / F.greatest(x1 - x0, F.lit(1e-12))
    return F.when(x <= F.get(kx, F.lit(0)), F.get(ky, F.lit(0))).when(x >= F.get(kx, n - 1), F.get(ky, n - 1)).otherwise(inner)


def trapezoid(t, start, end, fade_in, fade_out) -> Column:
    """Weight of a placement at time t: ramps at both ends, zero outside."""
    t = _c(t)
    weight = F.least(F.lit(1.0), (t - _c(start)) / F.greatest(_c(fade_in), F.lit(1e-6)), (_c(end) - t) / F.greatest(_c(fade_out), F.lit(1e-6)))
    return F.greatest(weight, F.lit(0.0))


def crossfade(left, right, n: int) -> Column:
    """The last n samples of left faded into the first n of right; both keep the rest."""
    left, right = _c(left), _c(right)
    m = F.least(F.lit(n), F.size(left), F.size(right))
    tail, head = F.slice(left, F.size(left) - m + 1, m), F.slice(right, F.lit(1), m)
    mixed = F.transform(F.arrays_zip(tail.alias("a"), head.alias("b")), lambda p, i: p["a"] * (1.0 - i / m) + p["b"] * (i / m))
    return F.when(m < 1, F.concat(left, right)).otherwise(F.concat(F.slice(left, F.lit(1), F.size(left) - m), mixed, F.slice(right, m + 1, F.size(right) - m)))


def follow_pitch(note, target, strength: float, transpose) -> Column:
    """Blend from the note to the sung pitch."""
    return _c(note) + strength * (F.coalesce(_c(target), _c(note)) - _c(note)) + _c(transpose)


def level_gain(reference, energy, loudness, strength: float = 0.7) -> Column:
    """dB that bring a unit to the reference and let it follow the target's loudness. A zero energy counts as missing."""
    energy = F.coalesce(F.nullif(_c(energy), F.lit(0.0)), _c(reference))
    return clamp(_c(reference) - energy, -12.0, 12.0) + clamp(strength * F.coalesce(_c(loudness), F.lit(0.0)), -15.0, 6.0)
