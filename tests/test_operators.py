"""Operators against brute force, on shuffled input with ties, empty groups and single rows."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomline.operators import aggregates, joins, lattice, ranking, rendering, rolling, runs, segmentation, sequence, signal


def frame(spark, rows, schema, seed=0):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- joins


@pytest.mark.parametrize("closed", [False, True])
def test_points_in_intervals(spark, closed):
    r = random.Random(1)
    spans = [(k % 3, n, s := r.choice([0.0, 1.0, -5.0, r.uniform(-10, 10)]), s + r.choice([0.0, 1e-9, 0.5, 3.0, 500.0])) for n, k in enumerate(range(60))]
    points = [(n % 4, n, r.choice([0.0, 1.0, 0.5, r.uniform(-12, 30)])) for n in range(80)]
    a, b = frame(spark, points, "g int, p int, x double"), frame(spark, spans, "g int, s int, lo double, hi double")
    want = sorted(((p, s) for g, p, x in points for h, s, lo, hi in spans if g == h and lo <= x and (x <= hi if closed else x < hi)), key=repr)
    assert got(joins.points_in_intervals(a, b, ["g"], "x", "lo", "hi", closed).select("p", "s")) == want
    left = joins.points_in_intervals(a, b, ["g"], "x", "lo", "hi", closed, "left").select("p", "s")
    assert sorted(p for p, s in got(left) if s is None) == sorted({p for _, p, _ in points} - {p for p, _ in want})
    assert joins.points_in_intervals(a, b.limit(0), ["g"], "x", "lo", "hi").count() == 0


def test_one_long_span_costs_no_more(spark):
    """Short intervals don't meet in the bucket of a long one."""
    short = [(0, k, k * 1.0, k * 1.0 + 0.5) for k in range(3000)]
    a = frame(spark, [*short, (0, -1, 0.0, 3000.0)], "g int, x int, s double, e double")
    b = frame(spark, [*short, (0, -2, 10.0, 900.0)], "g int, y int, s2 double, e2 double")
    assert joins.overlapping(a, b, ["g"], ("s", "e"), ("s2", "e2")).count() == 3000 + 3000 + 890 + 1
    assert joins.sharing_buckets(a, b, ["g"], ("s", "e"), ("s2", "e2")).count() < 20_000


def test_overlaps_and_best_match(spark):
    r = random.Random(2)
    make = lambda n: [(k % 3, k, s := r.uniform(0, 40), s + r.choice([0.01, 1.0, 5.0, 80.0])) for k in range(n)]
    left, right = make(50), make(50)
    a, b = frame(spark, left, "g int, x int, s double, e double"), frame(spark, right, "g int, y int, s2 double, e2 double")
    want = [(x, y, (min(e, e2) - max(s, s2)) / max(e - s, e2 - s2)) for g, x, s, e in left for h, y, s2, e2 in right if g == h and s < e2 and s2 < e]
    assert got(joins.overlapping(a, b, ["g"], ("s", "e"), ("s2", "e2")).select("x", "y")) == sorted(((x, y) for x, y, _ in want), key=repr)
    best = {}
    for x, y, ratio in sorted(want, key=lambda w: (w[0], -w[2], w[1])):
        best.setdefault(x, (y, ratio))
    chosen = joins.best_overlap(a, b, ["g"], "x", ("s", "e"), ("s2", "e2"), "y").select("x", "y")
    assert got(chosen) == sorted(((x, y) for x, (y, ratio) in best.items() if ratio >= 0.55), key=repr)
    same = [(x, y) for g, x, s, e in left for h, y, s2, e2 in right if g == h and abs(s - s2) <= 0.5 and abs(e - e2) <= 0.5]
    assert got(joins.same_bounds(a, b, ["g"], ("s", "e"), ("s2", "e2"), 0.5).select("x", "y")) == sorted(same, key=repr)


def test_nearest_and_as_of(spark):
    points, grid = [(g, n, x) for n, (g, x) in enumerate(itertools.product((0, 1, 2), (-1.0, 0.0, 0.5, 1.0, 2.4, 9.0)))], [(0, 0.0, 10), (0, 1.0, 11), (0, 3.0, 12), (1, 2.0, 13)]
    a, b = frame(spark, points, "g int, n int, x double"), frame(spark, grid, "g int, t double, v int")
    for g, n, x, v in got(joins.nearest(a, b, ["g"], "x", "t", ["v"])):
        own = [(abs(t - x), t, w) for h, t, w in grid if h == g]
        assert v == (min(own)[2] if own else None)
    for g, n, x, v in got(joins.as_of(a, b, ["g"], "x", "t", ["v"])):
        assert v == max(((t, w) for h, t, w in grid if h == g and t <= x), default=(0, None))[1]


def test_frames_in_spans_gives_each_span_a_frame(spark):
    spans, frames = [(0, 0.0, 0.2), (0, 0.25, 0.28), (0, 5.0, 6.0)], [(0, k / 10, k) for k in range(5)]
    out = joins.frames_in_spans(frame(spark, spans, "g int, a double, b double"), frame(spark, frames, "g int, t double, k int"), ["g"], "a", "b", "t")
    assert got(out.select("a", "k")) == [(0.0, 0), (0.0, 1), (0.0, 2), (0.25, 3)]


def test_zip_pending_and_fallbacks(spark):
    a, b = frame(spark, [(0, 1), (0, 2), (0, 3), (1, 1)], "g int, x int"), frame(spark, [(0, 7), (0, 8), (1, 9)], "g int, y int")
    assert got(joins.zip_positions(a, b, ["g"], ["x"], ["y"])) == [(0, 1, 7), (0, 2, 8), (1, 1, 9)]
    assert got(joins.zip_positions(a, b, ["g"], ["x"], ["y"], strict=True)) == [(1, 1, 9)]
    assert got(joins.pending(a, b.withColumnRenamed("y", "x"), ["g", "x"])) == got(a)
    first, second = frame(spark, [(0, 1, 0.0, 1.0), (0, 2, 1.0, 2.0)], "g int, n int, start double, end double"), frame(spark, [(0, 1, 0.1, 1.1), (0, 2, 1.5, 2.0)], "g int, n int, start double, end double")
    assert got(joins.agreeing(first, second, ["g", "n"]).select("n", "start", "refined")) == [(1, 0.1, True), (2, 1.0, False)]
    lex = frame(spark, [("ni3", ["n i"])], "token string, phones array<string>")
    tokens = frame(spark, [("ni3",), ("a1",), ("?",)], "token string")
    rule = F.when(F.col("token") == "a1", F.lit("a"))
    assert got(joins.pronunciations(tokens, lex, "token", rule).select("token", "phones")) == [("a1", "a"), ("ni3", "n i")]


# --- runs and windows


def test_runs(spark):
    r = random.Random(5)
    rows = [(g, i, r.random() < 0.6) for g in range(4) for i in range(50)] + [(9, 0, False)]
    df = frame(spark, rows, "g int, i int, f boolean")
    want = []
    for g in range(4):
        flags = [f for h, _, f in rows if h == g]
        want += [(g, a, b, b - a) for a, b in segmentation._runs(np.array(flags))]
    assert got(runs.runs(df, ["g"], "i", F.col("f"))) == sorted(want, key=repr)
    kept = runs.drop_short_runs(df.withColumn("v", F.when(F.col("f"), 1.0)), ["g"], "i", "v", 3)
    assert kept.filter("v IS NOT NULL").count() == sum(n for *_, n in want if n >= 3) and kept.count() == len(rows)
    longest = {g: min((-n, a, b) for h, a, b, n in want if h == g)[1:] for g in range(4)}
    assert got(runs.longest_run(runs.runs(df, ["g"], "i", F.col("f")), ["g"])) == sorted(((g, *v) for g, v in longest.items()), key=repr)


def test_gap_rules_are_strict_or_not(spark):
    spans = frame(spark, [(0, 0.0, 1.0), (0, 1.25, 2.0), (0, 2.5, 3.0), (0, 3.75, 4.0)], "g int, s double, e double")
    assert got(runs.close_gaps(spans, ["g"], "s", "e", 0.5)) == [(0, 0.0, 2.0, 2), (0, 2.5, 3.0, 1), (0, 3.75, 4.0, 1)]
    assert got(runs.merge_intervals(spans, ["g"], "s", "e", 0.5)) == [(0, 0.0, 3.0, 3), (0, 3.75, 4.0, 1)]
    nested = frame(spark, [(0, 0.0, 9.0), (0, 1.0, 2.0), (0, 8.0, 8.5), (0, 9.5, 10.0)], "g int, s double, e double")
    assert got(runs.merge_intervals(nested, ["g"], "s", "e")) == [(0, 0.0, 9.0, 3), (0, 9.5, 10.0, 1)]


def test_words_and_timelines(spark):
    words = [(0, 0, "ni3", 0.0, 0.3), (0, 1, "tian1", 0.3, 0.6), (0, 2, "tian1", 0.6, 0.9), (0, 3, "tian1", 0.9, 13.0), (0, 4, "", 13.0, 14.0)]
    kept = runs.keep_words(frame(spark, words, "g int, i int, w string, s double, e double"), ["g"], ["i"], "w", "s", "e", ("", "sil"))
    assert [r[1] for r in got(kept)] == [0, 1, 2]
    off = runs.concatenate_timelines(frame(spark, [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 1.0)], "g int, i int, d double"), ["g"], ["i"], "d")
    assert [r[3] for r in got(off)] == pytest.approx([0.0, 1.6, 4.2])


@pytest.mark.parametrize("n", [1, 2, 4, 20])
def test_moving_averages(spark, n):
    r = np.random.default_rng(n)
    x = r.random(n)
    df = frame(spark, [(0, i, float(v)) for i, v in enumerate(x)], "g int, i int, v double")
    edge = [row[3] for row in got(rolling.moving_average_edge(df, ["g"], ["i"], "v", 15, "m").withColumn("i", F.format_string("%03d", "i")))]
    assert edge == pytest.approx(segmentation.smooth_edge(x, 15).tolist())
    zero = [row[3] for row in got(rolling.moving_average_zero(df, ["g"], ["i"], "v", 5, "m").withColumn("i", F.format_string("%03d", "i")))]
    assert zero == pytest.approx((np.convolve(x, np.ones(5) / 5, "same") if n >= 5 else x).tolist())
    med = [row[3] for row in got(rolling.median_filter_zero(df, ["g"], ["i"], "v", 5, "m").withColumn("i", F.format_string("%03d", "i")))]
    assert med == pytest.approx([float(np.median(np.pad(x, 2)[k : k + 5])) for k in range(n)])


def test_octave_fix(spark):
    hz = np.full(200, 220.0)
    hz[50:55] = 440
    hz[120:] = 440
    midi = 69 + 12 * np.log2(hz / 440)
    out = rolling.fold_outliers(frame(spark, [(0, i, float(m)) for i, m in enumerate(midi)], "g int, i int, m double"), ["g"], ["i"], "m", "f")
    folded = {i: f for _, i, _, f in got(out)}
    assert all(folded[i] == pytest.approx(57.0) for i in range(50, 55)) and all(folded[i] == pytest.approx(69.0) for i in range(140, 200))


def test_interpolation(spark):
    vals = [None, 100.0, None, None, 200.0, None]
    rows = [(0, i, v) for i, v in enumerate(vals)] + [(1, i, None) for i in range(3)]
    out = got(rolling.interpolate(frame(spark, rows, "g int, i int, v double"), ["g"], ["i"], "i", "v", "f", log=True))
    assert [r[3] for r in out[:6]] == pytest.approx([100.0, 100.0, 100 * 2 ** (1 / 3), 100 * 2 ** (2 / 3), 200.0, 200.0]) and [r[3] for r in out[6:]] == [None] * 3


def test_closed_forms(spark):
    r = random.Random(7)
    for case in range(2):
        spans = sorted((r.uniform(0, 5), r.uniform(-1, 5)) for _ in range(30))
        rows = [(0, i, s, e) for i, (s, e) in enumerate(spans)]
        end, want = 0.5, []
        for _, i, s, e in rows:
            start = max(s, end)
            end = max(e, start)
            want.append((i, start, end))
        out = rolling.running_monotone(frame(spark, rows, "g int, i int, s double, e double"), ["g"], ["i"], "s", "e", F.lit(0.5))
        assert sorted((x["i"], x["start_fixed"], x["end_fixed"]) for x in out.collect()) == want
        ticks = [(0, i, int(s * 100) - 5, int(e * 100)) for _, i, s, e in rows]
        end, want = 0, []
        for _, i, s, e in ticks:
            start = max(s, end)
            end = max(e, start + 15)
            want.append((i, start, end))
        out = rolling.ticks_without_overlap(frame(spark, ticks, "g int, i int, s int, e int"), ["g"], ["i"], "s", "e")
        assert sorted((x["i"], x["tick_start"], x["tick_end"]) for x in out.collect()) == want


# --- aggregates and ranks


@pytest.mark.parametrize("hold", [200_000, 50])
def test_exact_quantile(spark, hold):
    r = np.random.default_rng(3)
    for values in (r.normal(size=3000), np.round(r.normal(size=3000), 1), np.array([4.0]), np.array([1.0, 2.0]), np.full(500, 3.0), np.concatenate([np.full(2000, 7.0), r.random(500)])):
        df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(3)
        for q in (0.0, 0.5, 0.9):
            assert aggregates.exact_quantile(df, "v", q, hold) == pytest.approx(float(np.percentile(values, 100 * q))), (len(values), q)
    assert aggregates.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None


def test_tuning(spark):
    midi = np.concatenate([np.full(80, x) for x in (60.3, 62.3, 64.3, 65.3)])
    df = frame(spark, [(0, i, float(m)) for i, m in enumerate(midi)], "g int, i int, m double")
    calm = rolling.steady(df, ["g"], ["i"], "m", "calm")
    assert got(aggregates.circular_offset(calm, ["g"], "m", F.col("calm")))[0][2] == pytest.approx(0.3, abs=0.05)


def test_apportion_adds_up(spark):
    rows = [(0, i, w) for i, w in enumerate([3.0, 1.0, 0.0, 2.5])]
    out = got(aggregates.apportion(frame(spark, rows, "g int, i int, w double"), ["g"], ["i"], "w", F.lit(7)))
    assert sum(r[3] for r in out) == 7 and all(r[3] >= 0 for r in out)


def test_tiers_are_all_or_nothing(spark):
    targets = frame(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "z"), (4, None, "x")], "t int, k string, f string")
    units = frame(spark, [(10, "a", "x"), (11, "a", "y"), (12, "d", "x")], "u int, k string, f string")
    out = ranking.tiered_candidates(targets.fillna("?"), units, ["k", "f"], units).select("t", "tier", "u")
    assert got(out) == [(1, 0, 10), (1, 0, 11), (2, 1, 10), (2, 1, 12), (3, 2, 10), (3, 2, 11), (3, 2, 12), (4, 1, 10), (4, 1, 12)]


def test_best_shift_and_ties(spark):
    rows = frame(spark, [(0, 60.0), (0, 60.0), (1, 54.0)], "g int, p double")
    out = ranking.best_shift(rows, ["g"], lambda s: F.abs(F.col("p") + s - 48), range(-12, 13, 12))
    assert [r[:2] for r in got(out)] == [(0, -12), (1, -12)]  # of -12 and 0, which cost the same, the smaller
    best = ranking.best_by(frame(spark, [(0, 1.0, 5), (0, 1.0, 4), (0, 2.0, 1)], "g int, c double, o int"), ["g"], F.col("c"), ["o"], ["o"])
    assert got(best) == [(0, 4)]


def test_best_pairs(spark):
    rows = [("a1", "b1", "v", "p", 1.0, True), ("b1", None, "w", "q", 2.0, True), ("c1", "d1", "v", "p", 9.0, True), ("d1", None, "w", "q", 5.0, False), ("e1", None, None, "q", 5.0, True)]
    pairs, ends = ranking.best_pairs(frame(spark, rows, "u string, nx string, grp string, head string, ql double, ok boolean"), "u", "nx", "grp", "head", "ql", ["u"], F.col("ok"))
    assert got(pairs) == [("v q", "a1", "b1", 3.0)] and got(ends) == [("w R", "b1", 2.0)]


# --- lattice


def test_rescue_matches_the_literal_loop(spark):
    for seed in range(3):
        r = random.Random(seed)
        chain = [[f"c{c}u{p}" for p in range(r.randint(1, 6))] for c in range(6)]
        rows = [(0, t, c, p, 0) for t in range(6) for c in range(6) for p in range(len(chain[c])) if r.random() < 0.5]
        ranked = []
        for t in range(6):
            own = [x for x in rows if x[1] == t]
            r.shuffle(own)
            ranked += [(s, t, c, p, k + 1) for k, (s, t, c, p, _) in enumerate(own)]
        kept, before = set(), set()
        for t in range(6):
            own = {(c, p): k for _, u, c, p, k in ranked if u == t}
            now = {x for x, k in own.items() if k <= 2 or (x[0], x[1] - 1) in before}
            kept |= {(t, *x) for x in now}
            before = now
        out = lattice.with_rescue(frame(spark, ranked, "s int, t int, c int, p int, k int", seed), "s", "t", "c", "p", "k", 2)
        assert {(x["t"], x["c"], x["p"]) for x in out.collect()} == kept


def test_path_is_the_cheapest(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(seed, t, k, f"u{t}{k}", f"u{t + 1}{r.randint(0, 2)}", f"s{r.randint(0, 1)}", r.uniform(-5, 5), r.choice([None, r.uniform(-30, 0)]), r.random(), 0, t != 3) for t in range(6) for k in range(3)]
        df = frame(spark, rows, "song int, t int, rank int, unit_id string, next_id string, source string, shift double, energy double, cost double, tier int, joined boolean", seed)
        out = sorted(lattice.select_sequence(df, "song", "t", ["rank"]).collect(), key=lambda x: x["t"])
        by = {(x[1], x[2]): x for x in rows}

        def price(path):
            total = 0.0
            for t, k in enumerate(path):
                b = by[t, k]
                total += b[8]
                if t and b[10]:
                    a = by[t - 1, path[t - 1]]
                    gap = abs(a[7] - b[7]) if a[7] is not None and b[7] is not None else 0.0
                    total += 0.0 if a[4] == b[3] else 0.6 + 0.15 * (a[5] != b[5]) + 0.03 * abs(a[6] - b[6]) + 0.02 * gap
            return total

        best = min(price(p) for p in itertools.product(range(3), repeat=6))
        assert out[0]["total_cost"] == pytest.approx(best)
        assert price([int(x["unit_id"][2]) for x in out]) == pytest.approx(best)


# --- scans


def test_thinning(spark):
    r = random.Random(11)
    for _ in range(2):
        pts, dur, gap = [r.uniform(-1, 11) for _ in range(40)], 10.0, r.choice([0.5, 1.0, 20.0])
        row = spark.createDataFrame([(pts + pts[:3],)], "p array<double>").select(sequence.thin(F.col("p"), F.lit(dur), F.lit(gap))).first()[0]
        assert row == segmentation.thinned(pts, dur, gap) and row[0] == 0.0 or gap == 20.0
        assert all(b - a >= gap - 1e-9 for a, b in zip(row, row[1:])) or gap == 20.0


def test_span_repair(spark):
    spans = [(0.0, 0.5), (0.5, 0.5), (0.5, 0.5), (0.6, 1.0)]
    df = spark.createDataFrame([([tuple(s) for s in spans],), ([],)], "s array<struct<start:double,end:double>>")
    out, none = (r[0] for r in df.select(sequence.repair_spans(F.col("s"), F.lit(0.0), F.lit(1.2))).collect())
    assert none == [] and all(s["end"] - s["start"] > 0.03 for s in out) and all(a["end"] <= b["start"] + 1e-9 for a, b in zip(out, out[1:]))
    assert spark.range(1).select(sequence.group_by_length(F.array(*map(F.lit, (100.0, 150.0, 50.0, 300.0, 1.0))), 280.0)).first()[0] == [0, 0, 1, 2, 3]


def brute_speech(db, period, min_silence, min_speech, max_chunk, pad):
    """Frame by frame, and recursion for long spans."""
    if not db:
        return []
    p10, p90 = np.percentile(db, [10, 90])
    spans, gap = [], int(min_silence / period)
    for i, x in enumerate(db):
        if x > max(p10 + 6, p90 - 35):
            if spans and (i == spans[-1][1] or i - spans[-1][1] < gap):
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])

    def halves(a, b):
        if b - a <= int(max_chunk / period):
            return [(a, b)]
        inner = range(a + int(1 / period), b - int(1 / period))
        at = min(max(min(inner, key=lambda i: (db[i], i)) if len(inner) else (a + b) // 2, a + 1), b - 1)
        return halves(a, at) + halves(at, b)

    parts = [p for a, b in spans if b - a >= int(min_speech / period) for p in halves(a, b)]
    return [(max(0.0, a * period - pad), min(len(db) * period, b * period + pad)) for a, b in parts]


def test_silence_split(spark):
    r, tracks = np.random.default_rng(8), {}
    for g in range(12):
        blocks = [np.full(int(r.integers(1, 90)), -70.0 if k % 2 else -20.0) for k in range(int(r.integers(1, 9)))]
        tracks[g] = np.round(np.concatenate(blocks) + r.normal(0, 3, sum(map(len, blocks))), 2).tolist()
    tracks[90], tracks[91] = [-20.0] * 400, [-80.0] * 5
    options = {"min_silence": 0.5, "min_speech": 0.6, "max_chunk": 8.0, "pad": 0.08}
    rows = [(g, i, x) for g, db in tracks.items() for i, x in enumerate(db)]
    df = frame(spark, rows, "g int, i int, db double")
    found = segmentation.split_on_silence(df, ["g"], "i", "db", 0.1, **options).collect()
    want = [(g, n, a, b) for g, db in tracks.items() for n, (a, b) in enumerate(brute_speech(db, 0.1, *options.values()))]
    assert sorted(map(tuple, found)) == [(g, n, pytest.approx(a), pytest.approx(b)) for g, n, a, b in sorted(want)] and len(want) > 20
    assert segmentation.split_on_silence(df.limit(0), ["g"], "i", "db", 0.1).collect() == []


def brute_levels(wide, light, least, threshold):
    """The same scan one frame at a time."""
    found, level, gone = [0], float(np.median(wide[:least])), []
    for k in range(1, len(wide)):
        if abs(wide[k] - level) <= threshold:
            gone, level = [], 0.95 * level + 0.05 * float(wide[k])
            continue
        gone.append(k)
        if len(gone) <= least // 2:
            continue
        low = max(found[-1] + 1, gone[0] - 10)
        steps = [abs(light[i + 1] - light[i]) for i in range(low, k - 1)]
        at = low + 1 + steps.index(max(steps)) if steps else k
        if at - found[-1] >= least and len(wide) - at >= least // 2:
            found.append(at)
            level = float(np.median(wide[at : at + least]))
        gone = []
    return found


def test_level_changes():
    r, several = np.random.default_rng(12), 0
    for _ in range(300):
        tones = np.repeat(r.integers(50, 64, 6), r.integers(1, 40, 6)) + r.normal(0, float(r.choice([0.05, 0.5])), 1)
        midi = tones + r.normal(0, 0.2, len(tones))
        if len(midi) < 3:
            continue
        wide, light = segmentation.smooth_edge(midi, 15), segmentation.smooth_edge(midi, 5)
        found = segmentation.level_changes(wide, light, 12, 0.8)
        assert found == brute_levels(wide, light, 12, 0.8)
        several += len(found) > 2
    assert several > 50


def test_melisma_has_two_notes():
    hz = np.zeros(200)
    hz[:60], hz[60:120] = 440 * 2 ** (-9 / 12), 440 * 2 ** (-5 / 12)
    notes = segmentation.notes_of(hz[:120], 0.0, 1.2)
    assert [n[2] for n in notes] == [60, 64] and abs(notes[0][1] - 0.6) < 0.06
    assert segmentation.notes_of(np.zeros(50), 0.0, 0.5) == [] and segmentation.notes_of(hz[:1], 0, 0.01) == []


def test_nucleus():
    flux = np.full(40, 0.5)
    flux[4:12], flux[30:38] = 0.05, 0.04
    a, b = segmentation.steady_nucleus(flux, 0.3)
    assert a < 15 and b - a >= 6 and segmentation.steady_nucleus(flux[:5], 0.3) is None


def test_boundary_merging():
    times = np.arange(100) * 0.01
    rms = np.r_[np.full(22, 0.5), np.full(14, 0.05), np.full(42, 0.5), np.full(22, 0.0)]
    zcr = np.r_[np.full(22, 0.02), np.full(14, 0.4), np.full(42, 0.02), np.full(22, 0.0)]
    kept = segmentation.merge_boundaries([0.22, 0.30, 0.36, 0.78], 1.0, times, rms, zcr, zcr, np.zeros(100), segmentation.MergeRules(min_gap=0.05))
    assert kept[0] == 0.0 and kept[-1] == 1.0 and 0.30 not in kept and len(kept) < 6


def test_regions_are_ordered(spark):
    t = np.arange(44) * 0.01
    env = np.r_[np.linspace(0, 1, 8), np.full(22, 1.0), np.linspace(1, 0, 14)]
    frames = frame(spark, [("a", float(x), float(e)) for x, e in zip(t, env)], "k string, t double, e double")
    out = {r["k"]: r for r in segmentation.regions(frame(spark, [("a", 1.0, 1.44), ("b", 0.0, 0.04)], "k string, s double, x double"), frames, ["k"], "s", "x", "t", "e").collect()}
    for r in out.values():
        assert r["onset"]["start"] == r["s"] and r["onset"]["end"] == r["nucleus"]["start"] < r["nucleus"]["end"] == r["tail"]["start"] < r["tail"]["end"] == r["x"]
    assert out["a"]["nucleus"]["end"] - out["a"]["nucleus"]["start"] > out["a"]["onset"]["end"] - out["a"]["onset"]["start"]
    assert out["b"]["onset"]["end"] == pytest.approx(0.0088)


# --- rendering and signals


def test_plan_loops_long_notes(spark):
    row = [(0, 0, 0.5, 0.55, 2.5, 0.0, 0.08, 0.3, 0.12, 0.25)]
    p = rendering.plan_placements(spark.createDataFrame(row, "song int, t int, syl_start double, vowel_start double, syl_end double, unit_start double, boundary double, unit_end double, nucleus_start double, nucleus_end double"), "song", "t")
    r = p.first()
    assert r["onset"] - r["out_start"] == pytest.approx(0.08) and r["pingpong"]["half_cycles"] % 2 == 1 and all(b > a for a, b in zip(r["knots_out"], r["knots_out"][1:]))
    times = p.select(F.explode(F.sequence(F.lit(47), F.lit(256))).alias("k"), "*").select(rendering.source_time(F.col("k") / 100, F.col("knots_out"), F.col("knots_src"), F.col("pingpong")).alias("s")).collect()
    assert all(-0.05 <= x["s"] <= 0.35 for x in times)


def test_curve_simplifying(spark):
    r = np.random.default_rng(2)
    x, y = np.arange(0, 300, 5.0), np.cumsum(r.normal(size=60)) * 4
    keep = rendering.simplify(x, y, 3.0)
    assert keep[0] and keep[-1] and keep.sum() < 60 and np.abs(np.interp(x, x[keep], y[keep]) - y).max() <= 3.0 + 1e-9

    def needed(a, b):
        off = [abs(y[k] - (y[a] + (y[b] - y[a]) * (x[k] - x[a]) / (x[b] - x[a]))) for k in range(a + 1, b)]
        k = a + 1 + off.index(max(off)) if off else a
        return needed(a, k) | needed(k, b) | {k} if off and max(off) > 3.0 else set()

    assert set(np.flatnonzero(keep).tolist()) == {0, 59} | needed(0, 59)
    assert rendering.simplify(x[:0], y[:0], 3.0).tolist() == [] and rendering.simplify(x[:2], y[:2], 3.0).tolist() == [True, True]


def test_overlap_add(spark):
    rows = [(0, 0, [1.0, 3.0], 1.0, True), (0, 0, [3.0, 5.0], 3.0, False), (0, 1, [7.0, 7.0], 0.5, True)]
    out = rendering.overlap_add(frame(spark, rows, "p int, f int, v array<double>, w double, on boolean"), ["p"], "f", "v", "w", "on")
    assert got(out.select("f", "v", "on")) == [(0, [2.5, 4.5], False), (1, [7.0, 7.0], True)]


def test_signals():
    rate = 22050
    t = np.arange(int(0.55 * rate)) / rate
    sine = 0.5 * np.sin(2 * np.pi * 220 * t)
    hz, sure = signal.yin(sine, rate)
    assert abs(np.median(hz[hz > 0]) - 220) < 2 and np.median(sure) > 0.9
    assert signal.rms(sine).max() == pytest.approx(0.5 / math.sqrt(2), rel=0.05) and signal.zero_crossings(sine)[5] < 0.05
    noise = np.random.default_rng(0).normal(size=8000) * 0.1
    assert np.median(signal.flatness(noise)) > 10 * np.median(signal.flatness(sine)) and signal.zero_crossings(noise)[5] > 0.3
    assert signal.loudness_db(np.zeros(100), 100).max() == pytest.approx(-120)
    half = signal.resample(sine, rate, rate // 2)
    assert abs(len(half) - len(sine) // 2) <= 1 and abs(np.median(signal.yin(half, rate // 2)[0][2:-2]) - 220) < 3
    found = signal.peaks(np.array([0, 1, 0, 3, 3, 0, 2, 0, 0.1, 0]), 2, 0.5)
    assert found.tolist() == [1, 3, 6] and signal.log_mel(sine, rate).shape[1] == 128 and len(signal.mel_flux(sine, rate)) > 10
    sal = np.zeros((2, 360))
    sal[0, 100:103] = (0.5, 1.0, 0.5)
    hz, sure = signal.decode_pitch(sal, 20.0 * np.arange(360) + 1997.379)
    assert hz[1] == 0 and hz[0] == pytest.approx(10 * 2 ** ((20 * 101 + 1997.379) / 1200))


def test_cutpoints_of_tones():
    rate, parts = 22050, []
    for f in (220, 330, 440):
        n = np.arange(int(0.18 * rate))
        parts += [np.zeros(int(0.12 * rate)), 0.6 * np.sin(2 * np.pi * f * n / rate) * np.minimum(1, n / 400) * np.minimum(1, (len(n) - n) / 400)]
    cuts = segmentation.candidate_cutpoints(np.concatenate(parts), rate, segmentation.MergeRules(min_gap=0.09))
    assert cuts[0] == 0.0 and cuts[-1] > 0.8 and len(cuts) >= 4
    assert segmentation.candidate_cutpoints(np.zeros(0), rate) == [0.0]


@pytest.mark.parametrize("hold", [2000, 4])
def test_units_of_the_same_key(spark, hold):
    """Only the first k and those that follow an offered unit leave the row of a target; keys of many units, ranked by a window, give the same."""
    r = random.Random(4)
    targets = [(s, t, r.choice([*range(5), None]), r.randint(-1, 4), r.random()) for s in range(3) for t in range(6)]
    units = [(r.choice([0, 0, 0, 1, 2, 3, 9]), n, round(r.random(), 1), r.randint(0, 5)) for n in range(40)]
    a, b = frame(spark, targets, "s int, t int, want int, prev int, p double"), frame(spark, units, "key int, n int, f double, before int")
    cost = lambda u: F.round(u("gap"), 1)
    terms = {"gap": lambda u: F.abs(F.col("p") - u("f"))}
    for also in (None, lambda u: u("before") == F.col("prev")):
        out = ranking.of_same_key(a, b, ["s", "t"], "want", "key", terms, cost, ["n"], ["before"], 2, also, hold=hold)
        want = []
        for s, t, key, prev, p in targets:
            own = sorted((float(f"{math.floor(abs(p - f) * 10 + 0.5) / 10:.1f}"), n, before) for k, n, f, before in units if k == key)
            want += [(s, t, n, rank) for rank, (_, n, before) in enumerate(own, 1) if rank <= 2 or also and before == prev]
        assert got(out.select("s", "t", "n", "rank")) == sorted(want, key=repr)


def test_rescue_needs_no_candidates_that_continue_nothing(spark):
    r = random.Random(5)
    rows = [(0, t, c, p, r.randint(1, 9)) for t in range(12) for c in range(3) for p in range(6) if r.random() < 0.6]
    held = {x[:4] for x in rows}
    fewer = [x for x in rows if x[4] <= 2 or (0, x[1] - 1, x[2], x[3] - 1) in held]
    kept = [got(lattice.with_rescue(frame(spark, some, "s int, t int, c int, p int, k int"), "s", "t", "c", "p", "k", 2)) for some in (rows, fewer)]
    assert len(fewer) < len(rows) and kept[0] == kept[1]


def test_candidates_are_cut_where_they_meet(spark):
    """What goes on from the join is a few rows a target, not every unit of its part."""
    from loomline.plans.queries import candidates

    found = candidates(spark, "/root/testdata/sf0.001", 3)
    assert found.filter("rank > 3").count() < found.count() / 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and "posexplode" not in plan and "explode" in plan


def test_sides_copied_to_levels_are_not_broadcast(spark):
    """The files of a few intervals are small, what they are copied to isn't: the driver must hold neither side."""
    a, b = frame(spark, [(0, 1, 1.0)], "g int, p int, x double"), frame(spark, [(0, 1, 0.0, 3.0)], "g int, s int, lo double, hi double")
    spans = frame(spark, [(0, 2, 0.5, 2.0)], "g int, p int, x double, y double")
    for out in (
        joins.points_in_intervals(a, b, ["g"], "x", "lo", "hi"),
        joins.overlapping(spans, b, ["g"], ("x", "y"), ("lo", "hi")),
        joins.same_bounds(spans, b, ["g"], ("x", "y"), ("lo", "hi")),
        joins.segment_at(a, b, ["g"], "x", "lo", "hi", "s"),
    ):
        out.collect()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_counted_tiers_meet_no_units(spark):
    """Counts by key agree with the pairs, and no step makes a row for each pair of a target and a unit."""
    r = random.Random(6)
    targets = frame(spark, [(n, r.choice([*"abcd", None]), r.choice(["x", "y", "z"])) for n in range(60)], "k int, f string, g string")
    units = frame(spark, [(r.randint(50, 90), r.choice([*"ab", None]), r.choice(["x", "y"]), r.randint(1, 3)) for _ in range(50)], "k int, f string, g string, n int")
    keys = ["k", "f", "g"]
    found = ranking.tiered_counts(targets, units, keys, "n", "total")
    pairs = ranking.tiered_candidates(targets.fillna("?"), units, keys).groupBy("k", "tier").agg(F.sum("n").alias("total"))
    placed = ranking.resolve_tiers(targets.fillna("?"), units, keys).select("k", "tier")
    want = placed.join(pairs, ["k", "tier"], "left").fillna(0)
    assert got(found.select("k", "tier", "total")) == got(want)
    from loomline.plans.queries import QUERIES

    plan = QUERIES["tiered_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == len(keys) and "Union" not in plan


def test_probes_of_a_point_grow_slower_than_the_levels(spark):
    """Intervals of twenty powers of two: a point is copied to seven of them, and every pair is still found once."""
    assert joins.drawn_together(list(range(20))) == [1, 4, 7, 10, 13, 16, 19] and joins.drawn_together([-12, 0, 1, 2, 9]) == [-12, 2, 9]
    r = random.Random(8)
    spans = [(0, n, s := r.uniform(-50, 50), s + 2.0 ** (n % 20 - 9) * r.uniform(0.5, 1)) for n in range(120)]
    points = [(0, n, s := r.uniform(-60, 60), s + 2.0 ** (n % 17 - 9)) for n in range(120)]
    a, b = frame(spark, points, "g int, p int, x double, y double"), frame(spark, spans, "g int, s int, lo double, hi double")
    out = joins.points_in_intervals(a, b, ["g"], "x", "lo", "hi")
    assert got(out.select("p", "s")) == sorted(((p, s) for _, p, x, _ in points for _, s, lo, hi in spans if lo <= x < hi), key=repr)
    probes = str(out._jdf.queryExecution().optimizedPlan().toString()).split("explode([")[1].split("]")[0]
    assert len(probes.split(",")) <= 8
    both = joins.overlapping(a, b, ["g"], ("x", "y"), ("lo", "hi"))
    assert got(both.select("p", "s")) == sorted(((p, s) for _, p, x, y in points for _, s, lo, hi in spans if x < hi and lo < y), key=repr)
