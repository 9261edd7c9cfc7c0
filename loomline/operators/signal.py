"""Frames from samples: numpy kernels over whole arrays, and the Arrow batch functions that apply them to audio columns.

A row holds one recording or a chunk of it; chunks keep rows small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def framed(x: np.ndarray, size: int, hop: int, centred: bool = True, mode: str = "constant") -> np.ndarray:
    x = np.pad(np.asarray(x, float), size // 2, mode=mode) if centred else np.asarray(x, float)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def rms(x, size: int = 1024, hop: int = 256) -> np.ndarray:
    return np.sqrt(np.mean(framed(x, size, hop) ** 2, axis=1))


def loudness_db(x, rate: int, window: float = 0.025, period: float = 0.01) -> np.ndarray:
    """dBFS on a grid of ``period``: mean squares of centred windows from prefix sums, zeros outside."""
    size, n = int(window * rate), int(np.ceil(len(x) / rate / period))
    sums = np.concatenate([[0.0], np.cumsum(np.square(np.asarray(x, float)))])
    centre = np.round(np.arange(n) * period * rate).astype(int)
    low, high = np.clip(centre - size // 2, 0, len(x)), np.clip(centre - size // 2 + size, 0, len(x))
    return 10 * np.log10(np.maximum((sums[high] - sums[low]) / size, 1e-12))


def zero_crossings(x, size: int = 1024, hop: int = 256) -> np.ndarray:
    f = framed(x, size, hop, mode="edge")
    return np.mean(np.signbit(f[:, 1:]) != np.signbit(f[:, :-1]), axis=1)


def spectrum(x, size: int = 1024, hop: int = 256, mode: str = "constant") -> np.ndarray:
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.abs(np.fft.rfft(framed(x, size, hop, mode=mode) * window, axis=1))


def flatness(x, size: int = 1024, hop: int = 256) -> np.ndarray:
    power = np.maximum(spectrum(x, size, hop) ** 2, 1e-10)
    return np.exp(np.mean(np.log(power), axis=1)) / np.mean(power, axis=1)


def mel_bank(rate: int, size: int, bands: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles on the mel scale (linear to 1 kHz, then logarithmic), of equal area."""
    to_mel = lambda f: np.where(f < 1000, 3 * f / 200, 15 + 27 * np.log(np.maximum(f, 1e-9) / 1000) / np.log(6.4))
    to_hz = lambda m: np.where(m < 15, 200 * m / 3, 1000 * np.exp(np.log(6.4) * (m - 15) / 27))
    edges = to_hz(np.linspace(to_mel(np.float64(low)), to_mel(np.float64(high or rate / 2)), bands + 2))
    f = np.fft.rfftfreq(size, 1 / rate)
    rise = (f[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - f[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x, rate: int, bands: int = 128, size: int = 2048, hop: int = 512) -> np.ndarray:
    return np.log(np.maximum(spectrum(x, size, hop, "reflect" if len(x) > size // 2 else "constant") @ mel_bank(rate, size, bands).T, 1e-5))


def mel_flux(x, rate: int, bands: int = 40, size: int = 1024, hop: int = 160) -> np.ndarray:
    mel = log_mel(x, rate, bands, size, hop)
    change = np.mean(np.abs(np.diff(mel, axis=0)), axis=1)
    return np.concatenate([change[:1], change]) if len(change) else np.zeros(len(mel))


def onset_strength(x, rate: int, size: int = 1024, hop: int = 256) -> np.ndarray:
    mel = log_mel(x, rate, 64, size, hop)
    return np.concatenate([[0.0], np.mean(np.maximum(0, np.diff(mel, axis=0)), axis=1)])


def peaks(values: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Local maxima (the middle of plateaus), thinned to ``distance`` from the highest down, that stand out by ``prominence``."""
    v = np.asarray(values, float)
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
    flat = [(a, b - 1) for a, b in zip(edge, edge[1:]) if a > 0 and b < len(v) and v[a - 1] < v[a] > v[b]]
    top = np.array([(a + b) // 2 for a, b in flat], int)
    kept = np.ones(len(top), bool)
    for k in np.argsort(v[top], kind="stable")[::-1]:
        if kept[k]:
            near = np.abs(top - top[k]) < distance
            near[k] = False
            kept &= ~near
    out = []
    for p in top[kept]:
        left, right = np.flatnonzero(v[:p] > v[p]), np.flatnonzero(v[p + 1 :] > v[p])
        low = v[left[-1] + 1 if len(left) else 0 : p + 1].min()
        high = v[p : p + 1 + right[0] if len(right) else len(v)].min()
        if v[p] - max(low, high) >= prominence:
            out.append(p)
    return np.array(out, int)


def backtracked(onsets: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """Each onset moved back to the local minimum of energy before it."""
    e = np.asarray(energy, float)
    low = np.flatnonzero((e[1:-1] <= e[:-2]) & (e[1:-1] < e[2:])) + 1
    low = np.concatenate([[0], low])
    return low[np.searchsorted(low, onsets, side="right") - 1]


def yin(x, rate: int, low: float = 65.0, high: float = 1000.0, size: int = 2048, hop: int = 256, threshold: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Pitch in Hz (0 unvoiced) and confidence of each frame, from the cumulative mean normalised difference."""
    lags = np.arange(1, int(rate / low) + 1)
    first = max(1, int(rate / high))
    hz, sure = [], []
    for f in framed(x, size, hop):
        spec = np.fft.rfft(f, 2 * size)
        same = np.fft.irfft(spec * np.conj(spec))[: lags[-1] + 1]
        sums = np.concatenate([[0.0], np.cumsum(f**2)])
        d = (sums[size - lags] - sums[0]) + (sums[size] - sums[lags]) - 2 * same[lags]
        d = np.maximum(d, 0)
        norm = d * lags / np.maximum(np.cumsum(d), 1e-12)
        cut = norm[first - 1 :]
        below = np.flatnonzero(cut < threshold)
        k = int(below[0]) if len(below) else int(np.argmin(cut))
        while k + 1 < len(cut) and cut[k + 1] < cut[k]:
            k += 1
        at, lag = k + first - 1, float(k + first)
        if 0 < at < len(norm) - 1:
            a, b, c = norm[at - 1 : at + 2]
            lag += 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c > 1e-12 else 0.0
        sure.append(float(np.clip(1 - norm[at], 0, 1)))
        hz.append(rate / lag if sums[size] > 1e-8 and len(below) else 0.0)
    return np.array(hz), np.array(sure)


def resample(x, rate: int, target: int, taps: int = 32) -> np.ndarray:
    """Windowed-sinc resampling."""
    if rate == target:
        return np.asarray(x, float)
    x, scale = np.pad(np.asarray(x, float), taps), min(1.0, target / rate)
    at = np.arange(int(np.ceil((len(x) - 2 * taps) * target / rate))) * rate / target + taps
    reach = int(np.ceil(taps / 2 / scale))
    k = np.floor(at).astype(int)[:, None] + np.arange(-reach + 1, reach + 1)
    d = at[:, None] - k
    weight = scale * np.sinc(scale * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / reach, -1, 1)))
    return (x[np.clip(k, 0, len(x) - 1)] * weight).sum(axis=1)


def decode_pitch(salience: np.ndarray, cents: np.ndarray, least: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Pitch from a salience map: the mean of the nine bins around the strongest, weighted; 0 where it isn't above ``least``."""
    top, n = np.argmax(salience, axis=1), salience.shape[1]
    k = top[:, None] + np.arange(-4, 5)
    weight = np.where((k >= 0) & (k < n), np.take_along_axis(salience, np.clip(k, 0, n - 1), axis=1), 0.0)
    mean = (weight * cents[np.clip(k, 0, n - 1)]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    sure = salience[np.arange(len(top)), top]
    return np.where(sure > least, 10 * 2.0 ** (mean / 1200), 0.0), sure


def preview_db(x, size: int = 1024, hop: int = 256) -> np.ndarray:
    """A spectrogram in dB below its peak, for display."""
    s = spectrum(x, size, hop)
    return np.maximum(20 * np.log10(np.maximum(s, 1e-10) / max(s.max(), 1e-10)), -80.0)


def _array_function(kernel):
    @F.pandas_udf(ArrayType(DoubleType()))
    def apply(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None else kernel(np.asarray(x, float)).tolist())

    return apply


rms_frames, zcr_frames, flatness_frames = _array_function(rms), _array_function(zero_crossings), _array_function(flatness)


def loudness_frames(rate: int):
    return _array_function(lambda x: loudness_db(x, rate))


def flux_frames(rate: int):
    return _array_function(lambda x: mel_flux(x, rate))
