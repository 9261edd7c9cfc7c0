"""Registered queries: the operators on the shared tables, each with the SQL that gives the same rows.

events are frames and units of a user's track (t in hours, i numbers them), lineitem with part are recorded units, orders of a
customer are the targets of a song, embeddings are spectral frames. Every query reads its whole tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import pitch, scores, text
from loomline.operators import aggregates, joins, lattice, ranking, rendering, rolling, runs, segmentation, sequence

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

U = ["user_id"]
O = ["t", "event_id"]  # noqa: E741
UNIT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# --- tables in their roles

E = """e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 3600e6 AS t, 40.0::DOUBLE + value / 10.0::DOUBLE AS p,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 3600e6, event_id) - 1 AS i FROM events)"""


def events(spark, d) -> DataFrame:
    """One row an event: hours t, frame number i in the user's track, value, and a pitch p."""
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6).alias("t"))
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy(*O)) - 1).cast("long")
    return ev.withColumns({"p": 40.0 + F.col("value") / 10.0, "i": i})


UNITS = """u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS rejected, l_quantity / 100 AS fd, l_tax * 10 AS f0_std,
  l_discount * 2.5::DOUBLE AS nucleus, 40.0::DOUBLE + l_extendedprice / 5000.0::DOUBLE AS f0, -5.0::DOUBLE * l_linenumber AS energy, (l_linenumber % 5) + 1 AS tone, 1 - l_tax AS voiced,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
med AS (SELECT quantile_cont(f0, 0.5) AS m FROM u WHERE NOT rejected)"""
QUALITY = """0.25::DOUBLE * least(fd, 0.35::DOUBLE) / 0.35::DOUBLE + 0.2::DOUBLE * exp(-coalesce(nullif(f0_std, 0), 2.0::DOUBLE)) + 0.15::DOUBLE * (least(nucleus, 0.25::DOUBLE) / 0.25::DOUBLE)
  + 0.15::DOUBLE * exp(-abs(f0 - m) / 4.0::DOUBLE) + 0.1::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (energy + 45.0::DOUBLE) / 30.0::DOUBLE))
  + 0.1::DOUBLE * (CASE tone WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.55 WHEN 4 THEN 0.85 WHEN 5 THEN 0.5 END)::DOUBLE + 0.05::DOUBLE * voiced"""
RATED = f"{UNITS}, q AS (SELECT *, round({QUALITY}, 9) AS quality FROM u, med WHERE NOT rejected)"


def units(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    c = F.col
    return li.select(
        *UNIT_KEY, (c("l_returnflag") == "R").alias("rejected"), (c("l_quantity") / 100).alias("fd"), (c("l_tax") * 10).alias("f0_std"), (c("l_discount") * 2.5).alias("nucleus"),
        (40.0 + c("l_extendedprice") / 5000.0).alias("f0"), (-5.0 * c("l_linenumber")).alias("energy"), ((c("l_linenumber") % 5) + 1).alias("tone"), (1 - c("l_tax")).alias("voiced"),
    )


def rate(rows: DataFrame, everything: DataFrame) -> DataFrame:
    """Usable units of rows with their quality; the speaker's median over everything is one number."""
    median = aggregates.exact_quantile(everything.filter(~F.col("rejected")), "f0", 0.5)
    q = scores.unit_quality("fd", "f0_std", "nucleus", "f0", F.lit(median).cast("double"), "energy", "tone", "voiced", F.lit(False))
    return rows.filter(~F.col("rejected")).withColumn("quality", F.round(q, 9))


def rated_units(spark, d) -> DataFrame:
    return rate(units(spark, d), units(spark, d))


# --- units: quality, checks, indexes


@query(f"""WITH {RATED}
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, round(quality, 6) AS quality FROM q
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY quality DESC, l_orderkey, l_linenumber, l_suppkey) = 1""")
def best_unit_per_key(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_suppkey"]
    best = ranking.best_by(rated_units(spark, d), ["l_partkey"], -F.col("quality"), order, [*order, "quality"])
    return best.withColumn("quality", r6(F.col("quality")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity / 100 < 0.06 THEN 'too_short' WHEN l_discount < 0.04 THEN 'final_too_short'
  WHEN l_tax * 10 < 0.3 THEN 'unvoiced' WHEN l_extendedprice / 1e6 > 0.08 THEN 'misaligned' ELSE '' END AS reason FROM lineitem""")
def qc_reasons(spark, d):
    c = F.col
    reason = scores.reject_reason(c("l_quantity") / 100, "l_discount", c("l_tax") * 10, c("l_extendedprice") / 1e6)
    return table(spark, d, "lineitem").select(*UNIT_KEY, reason.alias("reason"))


@query("""SELECT l_partkey, count(*) AS n_units, count(DISTINCT l_suppkey) AS n_sources, count(*) FILTER (l_returnflag <> 'R') AS n_usable FROM lineitem GROUP BY l_partkey""")
def usable_by_key(spark, d):
    """Units, sources and usable units of each key; distinct sources are counted from one row a key and source."""
    per = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("ok"))
    return per.groupBy("l_partkey").agg(F.sum("n").alias("n_units"), F.count("*").alias("n_sources"), F.sum("ok").alias("n_usable"))


# --- links, runs and sessions


@query(f"""WITH {E} SELECT event_id, CASE WHEN t - lag(t + value / 100) OVER w <= 6 THEN lag(event_id) OVER w END AS prev_id,
  CASE WHEN lead(t) OVER w - (t + value / 100) <= 6 THEN lead(event_id) OVER w END AS next_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def link_contiguous(spark, d):
    spans = events(spark, d).withColumn("until", F.col("t") + F.col("value") / 100)
    return runs.link_neighbours(spans, U, O, "event_id", "t", "until", 6).select("event_id", "prev_id", "next_id")


@query(f"""WITH {E} SELECT event_id, coalesce(t - lag(t + value / 100) OVER w <= 8, false) AS joined, NOT coalesce(t - lag(t + value / 100) OVER w <= 8, false) AS phrase_start,
  coalesce(lead(t) OVER w - (t + value / 100) > 8, true) AS phrase_end FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def phrase_flags(spark, d):
    spans = events(spark, d).withColumn("until", F.col("t") + F.col("value") / 100)
    return runs.phrase_flags(spans, U, O, "t", "until", 8).select("event_id", "joined", "phrase_start", "phrase_end")


_RUNS = f"""WITH {E}, f AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE value > 30)
SELECT user_id, min(i) AS "start", max(i) + 1 AS "end", count(*) AS n FROM f GROUP BY user_id, g"""


@query(_RUNS)
def runs_above_threshold(spark, d):
    return runs.runs(events(spark, d), U, "i", F.col("value") > 30)


@query(f"""WITH {E}, f AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE value > 30),
l AS (SELECT user_id, i, count(*) OVER (PARTITION BY user_id, g) AS n FROM f) SELECT e.event_id, CASE WHEN l.n >= 3 THEN e.p END AS p FROM e LEFT JOIN l USING (user_id, i)""")
def drop_short_runs(spark, d):
    voiced = events(spark, d).withColumn("p", F.when(F.col("value") > 30, F.col("p")))
    return runs.drop_short_runs(voiced, U, "i", "p", 3).select("event_id", "p")


@query(f"""WITH {E}, o AS (SELECT *, CASE WHEN t - lag(t) OVER w < 6 THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM o)
SELECT user_id, min(t) AS "start", max(t) AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def close_gaps_sessions(spark, d):
    return runs.close_gaps(events(spark, d).withColumn("until", F.col("t")), U, "t", "until", 6)


@query(f"""WITH {E}, s AS (SELECT *, t + value / 10 AS u FROM e), o AS (SELECT *, CASE WHEN t > max(u) OVER (PARTITION BY user_id ORDER BY t, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.5::DOUBLE THEN 1 ELSE 0 END AS n FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, u) AS k FROM o) SELECT user_id, min(t) AS "start", max(u) AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def merge_touching_intervals(spark, d):
    return runs.merge_intervals(events(spark, d).withColumn("u", F.col("t") + F.col("value") / 10), U, "t", "u", 0.5)


@query(f"""WITH {E}, th AS (SELECT user_id, quantile_cont(value, 0.18) AS q, max(i) AS last FROM e GROUP BY user_id),
f AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e JOIN th USING (user_id) WHERE value <= round(1.5::DOUBLE * q, 3)),
r AS (SELECT user_id, min(i) AS a, max(i) + 1 AS b FROM f GROUP BY user_id, g HAVING count(*) >= 2), x AS (SELECT r.*, last FROM r JOIN th USING (user_id))
SELECT user_id, a AS "at" FROM x WHERE a > 0 UNION ALL SELECT user_id, b FROM x WHERE b <= last""")
def low_run_boundaries(spark, d):
    ev = events(spark, d)
    floor = aggregates.quantile_by(table(spark, d, "events"), U, "value", 0.18, "q")
    return runs.low_run_boundaries(ev.join(floor, "user_id"), U, "i", "value", aggregates.round_scaled(1.5 * F.col("q"), 3), 2)


@query(f"""WITH {E}, s AS (SELECT user_id, i, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS u FROM e)
SELECT user_id, printf('seg_%03d', n) AS segment_id, t AS "start", u AS "end" FROM s WHERE u IS NOT NULL""")
def consecutive_segments(spark, d):
    return runs.consecutive_segments(events(spark, d), U, "t")


@query("""WITH w AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, length(coalesce(text, '')) / 100.0::DOUBLE AS s FROM conversations WHERE role <> 'system')
SELECT conv_id, turn, role FROM w WHERE NOT coalesce(before = role AND s > 1.5, false)""")
def keep_words(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lit(0.0).alias("a"), (F.length(F.coalesce("text", F.lit(""))) / 100.0).alias("b"))
    return runs.keep_words(turns, ["conv_id"], ["turn"], "role", "a", "b", ("", "system")).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, round(coalesce(sum(length(coalesce(text, '')) / 10.0::DOUBLE + 0.6::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS "offset" FROM conversations""")
def concatenate_timelines(spark, d):
    turns = table(spark, d, "conversations").withColumn("s", F.length(F.coalesce("text", F.lit(""))) / 10.0)
    return runs.concatenate_timelines(turns, ["conv_id"], ["turn"], "s").select("conv_id", "turn", r6(F.col("offset")).alias("offset"))


@query(f"""WITH {E}, x AS (SELECT user_id, i AS k, i + 1 AS a, coalesce(lead(i) OVER (PARTITION BY user_id ORDER BY i), 1000000000) AS b FROM e WHERE event_type = 'purchase'),
n AS (SELECT x.user_id, x.k, x.a, e.i, lag(e.i) OVER (PARTITION BY x.user_id, x.k ORDER BY e.i) AS before FROM x JOIN e ON e.user_id = x.user_id AND e.i >= x.a AND e.i < x.b WHERE e.value > 30),
g AS (SELECT *, sum(CASE WHEN i - coalesce(before, a - 1) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY i) AS broken FROM n),
m AS (SELECT user_id, k, max(i) + 1 AS m FROM g WHERE broken = 0 GROUP BY user_id, k) SELECT user_id, k, greatest(a, coalesce(m, a)) AS extended FROM x LEFT JOIN m USING (user_id, k)""")
def extend_while_voiced(spark, d):
    ev = events(spark, d)
    marks = ev.filter(F.col("event_type") == "purchase").select("user_id", F.col("i").alias("k"), (F.col("i") + 1).alias("a"))
    marks = marks.withColumn("b", F.coalesce(F.lead("k").over(Window.partitionBy("user_id").orderBy("k")), F.lit(1000000000)))
    return runs.extend_while(marks, ev, U, ["k"], "a", "b", "i", F.col("value") > 30, slack=2).select("user_id", "k", "extended")


# --- rolling statistics


@query(f"""WITH {E}, v AS (SELECT user_id, event_id, t, p + CASE WHEN event_id % 11 = 0 THEN 12 ELSE 0 END AS p FROM e WHERE value > 10),
m AS (SELECT *, median(p) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS mid, count(*) OVER (PARTITION BY user_id) AS n FROM v),
o AS (SELECT *, abs(abs(p - mid) - 12.0::DOUBLE) < 1.5 AS off FROM m), c AS (SELECT *, CASE WHEN off <> lag(off, 1, false) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 1 ELSE 0 END AS new FROM o),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM c), l AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS long FROM r)
SELECT event_id, round(CASE WHEN off AND long < 12 AND n >= 5 THEN CASE WHEN p > mid THEN p - 12 ELSE p + 12 END ELSE p END, 6) AS folded FROM l
UNION ALL SELECT event_id, NULL FROM e WHERE value <= 10""")
def outlier_fold(spark, d):
    p = F.col("p") + F.when(F.col("event_id") % 11 == 0, 12.0).otherwise(0.0)
    voiced = events(spark, d).withColumn("p", F.when(F.col("value") > 10, p))
    return rolling.fold_outliers(voiced, U, O, "p", "folded").select("event_id", r6(F.col("folded")).alias("folded"))


@query(f"""WITH {E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER w AS a, last_value(value) OVER w AS b, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN n < 3 THEN value ELSE (sum(value) OVER c + greatest(8 - k, 0) * a + greatest(k + 7 - n, 0) * b) / 15 END, 6) AS edge,
  round(CASE WHEN n < 5 THEN value ELSE sum(value) OVER z / 5 END, 6) AS zero, round(CASE WHEN count(*) OVER f = 6 THEN avg(value) OVER f END, 6) AS valid FROM n
WINDOW c AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), z AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)""")
def moving_averages(spark, d):
    """Every track here has at least fifteen frames; shorter ones narrow the window (tests)."""
    ev = rolling.moving_average_edge(events(spark, d), U, O, "value", 15, "edge")
    ev = rolling.moving_average_valid(rolling.moving_average_zero(ev, U, O, "value", 5, "zero"), U, O, "value", 6, "valid")
    return ev.select("event_id", *(r6(F.col(c)).alias(c) for c in ("edge", "zero", "valid")))


@query(f"""WITH {E}, v AS (SELECT *, CASE WHEN value > 30 THEN p END AS x FROM e),
k AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, last_value(x IGNORE NULLS) OVER b AS xa, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tb, first_value(x IGNORE NULLS) OVER f AS xb FROM v
WINDOW b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN xa IS NULL THEN xb WHEN xb IS NULL OR ta >= tb THEN xa ELSE exp(ln(xa) + (ln(xb) - ln(xa)) * (t - ta) / (tb - ta)) END, 6) AS bridged FROM k""")
def interpolate_gaps(spark, d):
    voiced = events(spark, d).withColumn("x", F.when(F.col("value") > 30, F.col("p")))
    return rolling.interpolate(voiced, U, O, "t", "x", "bridged", log=True).select("event_id", r6(F.col("bridged")).alias("bridged"))


@query(f"""WITH {E}, q AS (SELECT user_id, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM e GROUP BY user_id)
SELECT event_id, round(CASE WHEN b > a THEN greatest(0, least(1, (value - a) / (b - a))) ELSE 0 END, 6) AS scaled FROM e JOIN q USING (user_id)""")
def robust_scale(spark, d):
    return rolling.robust_scale(table(spark, d, "events"), U, "value", "scaled").select("event_id", r6(F.col("scaled")).alias("scaled"))


@query(f"""WITH {E}, r AS (SELECT *, greatest(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id), 0), 0) AS rise FROM e),
q AS (SELECT user_id, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b, quantile_cont(rise, 0.05) AS ra, quantile_cont(rise, 0.95) AS rb, quantile_cont(p, 0.05) AS pa, quantile_cont(p, 0.95) AS pb FROM r GROUP BY user_id),
s AS (SELECT r.*, CASE WHEN b > a THEN greatest(0, least(1, (value - a) / (b - a))) ELSE 0 END AS sv, CASE WHEN rb > ra THEN greatest(0, least(1, (rise - ra) / (rb - ra))) ELSE 0 END AS sr, CASE WHEN pb > pa THEN greatest(0, least(1, (p - pa) / (pb - pa))) ELSE 0 END AS sp FROM r JOIN q USING (user_id)),
n AS (SELECT *, 0.42::DOUBLE * sp + 0.30::DOUBLE * sr + 0.18::DOUBLE * sr + 0.10::DOUBLE * sv AS novelty FROM s)
SELECT event_id, round(max(novelty) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS strength, round(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS level FROM n""")
def boundary_strength(spark, d):
    ev = rolling.rise(events(spark, d), U, O, "value", "rise")
    for c, name in (("value", "sv"), ("rise", "sr"), ("p", "sp")):
        ev = rolling.robust_scale(ev, U, c, name)
    ev = ev.withColumn("novelty", scores.novelty("sp", "sr", "sr", "sv"))
    near = rolling.mean_near(rolling.peak_near(ev, U, O, "novelty", "strength"), U, O, "value", "level")
    return near.select("event_id", r6(F.col("strength")).alias("strength"), r6(F.col("level")).alias("level"))


@query(f"""WITH {E}, c AS (SELECT *, 1200.0::DOUBLE * log2(greatest(value, 1e-5::DOUBLE) / 55.0::DOUBLE) AS c FROM e), s AS (SELECT user_id, abs(c - lag(c) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS d FROM c WHERE value > 5)
SELECT user_id, round(coalesce(avg(CASE WHEN d >= 650 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 0), 6) AS jump_share FROM s GROUP BY user_id""")
def octave_jumps(spark, d):
    ev = events(spark, d).withColumn("c", F.when(F.col("value") > 5, pitch.hz_to_cents("value")))
    return rolling.jump_share(ev, U, O, "c").select("user_id", r6(F.col("jump_share")).alias("jump_share"))


@query(f"""WITH {E}, m AS (SELECT user_id, t, event_id, greatest(max(greatest(t, t + value / 10 - 3)) OVER (PARTITION BY user_id ORDER BY t, event_id), 0.0::DOUBLE) AS u FROM e)
SELECT event_id, round(greatest(t, coalesce(lag(u) OVER (PARTITION BY user_id ORDER BY t, event_id), t), 0.0::DOUBLE), 6) AS start_fixed, round(u, 6) AS end_fixed FROM m""")
def monotone_spans(spark, d):
    spans = events(spark, d).withColumn("u", F.col("t") + F.col("value") / 10 - 3)
    fixed = rolling.running_monotone(spans, U, O, "t", "u", F.lit(0.0))
    return fixed.select("event_id", r6(F.col("start_fixed")).alias("start_fixed"), r6(F.col("end_fixed")).alias("end_fixed"))


@query(f"""WITH {E}, k AS (SELECT *, i + 1 AS k FROM e) SELECT event_id, round(max(p - k * 0.05::DOUBLE) OVER (PARTITION BY user_id ORDER BY t, event_id) + k * 0.05::DOUBLE, 6) AS increased FROM k""")
def strictly_increasing(spark, d):
    return rolling.strictly_increasing(events(spark, d), U, O, "p", "increased", 0.05).select("event_id", r6(F.col("increased")).alias("increased"))


@query(f"""WITH {E}, k AS (SELECT user_id, event_id, t, i, CAST(round_even(t * 60 * 120.0::DOUBLE / 60.0::DOUBLE * 480, 0) AS INTEGER) AS a, CAST(round_even((t + value / 20) * 60 * 120.0::DOUBLE / 60.0::DOUBLE * 480, 0) AS INTEGER) AS b FROM (SELECT user_id, event_id, i, value, t - min(t) OVER (PARTITION BY user_id) AS t FROM e)),
n AS (SELECT *, max(greatest(b, greatest(a, 0) + 15) - 15 * i) OVER (PARTITION BY user_id ORDER BY t, event_id) + 15 * i AS z FROM k)
SELECT event_id, greatest(a, 0, coalesce(lag(z) OVER (PARTITION BY user_id ORDER BY t, event_id), 0)) AS tick_start, z AS tick_end FROM n""")
def non_overlapping_ticks(spark, d):
    ev = events(spark, d)
    ev = ev.withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy("user_id")))
    notes = ev.withColumns({"a": pitch.seconds_to_ticks(F.col("t") * 60, 120.0), "b": pitch.seconds_to_ticks((F.col("t") + F.col("value") / 20) * 60, 120.0)})
    return rolling.ticks_without_overlap(notes, U, O, "a", "b").select("event_id", F.col("tick_start").cast("long").alias("tick_start"), F.col("tick_end").cast("long").alias("tick_end"))


@query("""WITH f AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
x AS (SELECT vec_id, label, CASE WHEN b IS NOT NULL THEN list_sum(list_transform(range(1, len(embedding) + 1), lambda k: abs(embedding[k]::DOUBLE - b[k]::DOUBLE))) / len(embedding) END AS flux,
  CASE WHEN b IS NOT NULL THEN list_sum(list_transform(range(1, len(embedding) + 1), lambda k: greatest(embedding[k]::DOUBLE - b[k]::DOUBLE, 0.0::DOUBLE))) ELSE 0 END AS rise FROM f)
SELECT vec_id, round(coalesce(flux, lead(flux) OVER (PARTITION BY label ORDER BY vec_id), 0), 6) AS flux, round(rise, 6) AS rise FROM x""")
def vector_flux(spark, d):
    both = rolling.vector_flux(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding", "flux")
    both = rolling.vector_flux(both, ["label"], ["vec_id"], "embedding", "rise", positive=True)
    return both.select("vec_id", r6(F.col("flux")).alias("flux"), r6(F.col("rise")).alias("rise"))


@query("""WITH x AS (SELECT label, vec_id % 7 AS frame, vec_id, embedding, 1.0::DOUBLE + (vec_id % 3) AS w FROM embeddings),
l AS (SELECT label, frame, w, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS k FROM x), m AS (SELECT label, frame, k, sum(w * v) / sum(w) AS m FROM l GROUP BY label, frame, k)
SELECT label, frame, round(sum(m), 5) AS total, round(sum(m * k), 3) AS moment, any_value(voiced) AS voiced FROM m JOIN (SELECT label, frame, sum(CASE WHEN vec_id % 2 = 0 THEN w ELSE 0 END) / sum(w) >= 0.5 AS voiced FROM x GROUP BY label, frame) USING (label, frame) GROUP BY label, frame""")
def overlap_add(spark, d):
    x = table(spark, d, "embeddings").withColumns({"frame": F.col("vec_id") % 7, "w": 1.0 + (F.col("vec_id") % 3), "voiced": F.col("vec_id") % 2 == 0})
    out = rendering.overlap_add(x, ["label"], "frame", "embedding", "w", "voiced")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    moment = F.aggregate(F.transform("embedding", lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v)
    return out.select("label", "frame", F.round(total, 5).alias("total"), F.round(moment, 3).alias("moment"), "voiced")


# --- aggregates


@query(f"""WITH {E}, v AS (SELECT user_id, cos((p - round_even(p, 0)) * {2 * math.pi!r}::DOUBLE) AS x, sin((p - round_even(p, 0)) * {2 * math.pi!r}::DOUBLE) AS y FROM e WHERE value > 2),
m AS (SELECT user_id, count(*) AS n, avg(x) AS x, avg(y) AS y FROM v GROUP BY user_id)
SELECT user_id, n, round(CASE WHEN n >= 20 AND sqrt(x * x + y * y) >= 0.05 THEN atan2(y, x) / {2 * math.pi!r}::DOUBLE ELSE 0 END, 6) AS tuning FROM m""")
def circular_mean(spark, d):
    ev = table(spark, d, "events").withColumn("p", 40.0 + F.col("value") / 10.0)
    found = aggregates.circular_offset(ev.filter("value > 2"), U, "p", F.lit(True), 20, 0.05)
    return found.withColumn("tuning", r6(F.col("tuning")))


@query("""WITH m AS (SELECT user_id, median(value) AS median, stddev_pop(value) / greatest(avg(value), 1e-5) AS variation FROM events GROUP BY user_id)
SELECT user_id, round(any_value(median), 6) AS median, round(median(abs(value - median)), 6) AS mad, round(any_value(variation), 6) AS variation FROM events JOIN m USING (user_id) GROUP BY user_id""")
def mad_cv_stats(spark, d):
    s = aggregates.spread_summary(table(spark, d, "events"), U, "value")
    return s.select("user_id", *(r6(F.col(c)).alias(c) for c in ("median", "mad", "variation")))


@query("""SELECT user_id, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS voiced_ratio, round(avg(value), 6) AS energy_db, round(CASE WHEN count(*) FILTER (value > 20) >= 2 THEN quantile_cont(value, 0.5) FILTER (value > 20) END, 6) AS f0_midi,
  round(CASE WHEN count(*) FILTER (value > 20) >= 2 THEN stddev_pop(value) FILTER (value > 20) END, 6) AS f0_std FROM events GROUP BY user_id""")
def voiced_summary(spark, d):
    ev = table(spark, d, "events").withColumn("p", F.when(F.col("value") > 20, F.col("value")))
    s = aggregates.voiced_summary(ev, U, "p", "value")
    return s.select("user_id", *(r6(F.col(c)).alias(c) for c in ("voiced_ratio", "energy_db", "f0_midi", "f0_std")))


@query("""SELECT o_orderkey, round(sum(greatest(l_quantity, 1e-3::DOUBLE) * (40.0::DOUBLE + l_extendedprice / 7000.0::DOUBLE)) / sum(greatest(l_quantity, 1e-3::DOUBLE)), 6) AS pitch, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def weighted_pitch(spark, d):
    notes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(aggregates.weighted_mean(40.0 + F.col("l_extendedprice") / 7000.0, F.col("l_quantity")).alias("pitch"), F.count("*").alias("n"))
    return table(spark, d, "orders").join(notes, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", r6(F.col("pitch")).alias("pitch"), "n")


@query(f"""WITH {E}, b AS (SELECT user_id, CAST(floor(i / 10) AS BIGINT) AS bucket, min(value) AS lo, max(value) AS hi, count(*) AS n FROM e GROUP BY user_id, floor(i / 10))
SELECT user_id, bucket, 0 AS side, lo AS value FROM b WHERE n = 10 UNION ALL SELECT user_id, bucket, 1, hi FROM b WHERE n = 10""")
def bucket_min_max(spark, d):
    return aggregates.bucket_extremes(events(spark, d), U, "i", "value", 10)


@query(f"""WITH {E}, x AS (SELECT *, ((event_id * 37) % 101 - 50) / 1000.0::DOUBLE AS err FROM e)
SELECT event_type, count(*) AS n, round(avg(err), 6) AS bias, round(avg(abs(err)), 6) AS mean_abs, round(quantile_cont(abs(err), 0.5), 6) AS median_abs, round(avg(CASE WHEN abs(err) < 0.02 THEN 1.0 ELSE 0.0 END), 6) AS below_20ms, round(avg(CASE WHEN abs(err) < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS below_50ms FROM x GROUP BY event_type""")
def boundary_error_report(spark, d):
    ev = table(spark, d, "events")
    truth = ev.select("event_id", "event_type", F.lit(0.0).alias("a"))
    found = ev.select("event_id", (((F.col("event_id") * 37) % 101 - 50) / 1000.0).alias("b"))
    report = aggregates.error_report(truth.join(found, "event_id"), F.col("b") - F.col("a"), ["event_type"])
    return report.select("event_type", "n", *(r6(F.col(c)).alias(c) for c in report.columns[2:]))


_NOTES = f"""WITH {E}, x AS (SELECT p AS a, CASE WHEN event_id % 5 > 0 THEN p + (event_id % 3) * 0.6::DOUBLE + CASE WHEN event_id % 13 = 0 THEN 12 ELSE 0 END END AS b FROM e)"""


@query(f"""{_NOTES} SELECT count(*) AS n, round(avg(CASE WHEN round_even(b, 0) = round_even(a, 0) THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN abs(round_even(b, 0) - round_even(a, 0)) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_semitone,
  round(avg(CASE WHEN abs(round_even(b, 0) - round_even(a, 0)) >= 11 THEN 1.0 ELSE 0.0 END), 6) AS octave_off, round(median(abs(b * 100.0::DOUBLE - a * 100.0::DOUBLE)), 6) AS median_cents, round(avg(CASE WHEN abs(b * 100.0::DOUBLE - a * 100.0::DOUBLE) > 50 THEN 1.0 ELSE 0.0 END), 6) AS over_50 FROM x WHERE b IS NOT NULL""")
def note_and_pitch_accuracy(spark, d):
    ev = table(spark, d, "events").select((40.0 + F.col("value") / 10.0).alias("a"), "event_id")
    off = (F.col("event_id") % 3) * 0.6 + F.when(F.col("event_id") % 13 == 0, 12).otherwise(0)
    both = ev.withColumn("b", F.when(F.col("event_id") % 5 > 0, F.col("a") + (F.col("event_id") % 3) * 0.6 + F.when(F.col("event_id") % 13 == 0, 12).otherwise(0)))
    cents = both.withColumns({"ca": F.col("a") * 100.0, "cb": F.col("b") * 100.0})
    one = aggregates.note_accuracy(both, "b", "a").crossJoin(aggregates.pitch_error(cents, "cb", "ca"))  # one row each
    return one.select("n", *(r6(F.col(c)).alias(c) for c in one.columns[1:]))


@query("""WITH x AS (SELECT item_id, regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g') AS a FROM benchmark), y AS (SELECT item_id, a, replace(replace(a, 'e', 'a'), ' t', ' th') AS b FROM x)
SELECT item_id, levenshtein(a, b) AS errors, length(a) AS tokens FROM y""")
def token_error_rate(spark, d):
    """Edit distance between whole recognised and reference texts, with letters as tokens (pooled rates: aggregates.pooled_rate)."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z ]", "")
    x = table(spark, d, "benchmark").select("item_id", letters.alias("a")).withColumn("b", F.replace(F.replace("a", F.lit("e"), F.lit("a")), F.lit(" t"), F.lit(" th")))
    each = lambda c: F.filter(F.split(c, ""), lambda l: l != "")
    return x.select("item_id", text.token_distance(each("a"), each("b")).cast("long").alias("errors"), F.length("a").cast("long").alias("tokens"))


@query("""WITH w AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations), s AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, sum(n) OVER (PARTITION BY conv_id) AS b FROM w),
u AS (SELECT conv_id, turn, CAST(round_even(CASE WHEN b > 0 THEN a / b * 100 END, 0) AS BIGINT) AS upto FROM s) SELECT conv_id, turn, upto - coalesce(lag(upto) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS n_items FROM u""")
def apportion(spark, d):
    turns = table(spark, d, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    return aggregates.apportion(turns, ["conv_id"], ["turn"], "n", F.lit(100)).select("conv_id", "turn", "n_items")


# --- choosing


_WANTED = """keys AS (SELECT p_partkey, p_brand, p_type FROM part), bank AS (SELECT l_partkey AS p_partkey, p_brand, p_type, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND l_quantity >= 49 AND p_size > 25 AND p_brand <> 'Brand#11')"""


@query(f"""WITH {_WANTED}, t AS (SELECT *, CASE WHEN p_partkey IN (SELECT p_partkey FROM bank) THEN 0 WHEN p_brand IN (SELECT p_brand FROM bank) THEN 1 WHEN p_type IN (SELECT p_type FROM bank) THEN 2 ELSE 3 END AS tier FROM keys),
a AS (SELECT p_partkey, count(*) AS n FROM bank GROUP BY 1), b AS (SELECT p_brand, count(*) AS n FROM bank GROUP BY 1), c AS (SELECT p_type, count(*) AS n FROM bank GROUP BY 1)
SELECT t.p_partkey, tier, CASE tier WHEN 0 THEN a.n WHEN 1 THEN b.n WHEN 2 THEN c.n ELSE 0 END AS n_candidates FROM t LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_brand) LEFT JOIN c USING (p_type)""")
def tiered_candidates(spark, d):
    """How many units each part may be sung by, in which tier; counts of the units of a key join in place of the units."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    counted = table(spark, d, "lineitem").filter("l_returnflag = 'A' AND l_quantity >= 49").groupBy("l_partkey").agg(F.count("*").alias("n"))
    keys = ["p_partkey", "p_brand", "p_type"]
    bank = part.filter("p_size > 25 AND p_brand <> 'Brand#11'").join(counted, F.col("p_partkey") == F.col("l_partkey")).select(*keys, "n")
    return ranking.tiered_counts(part.select(*keys), bank, keys, "n", "n_candidates").select("p_partkey", "tier", "n_candidates")


#: A target for each order: the part of its first line is wanted, pitched by the order's price.
_TARGETS = f"""{RATED}, first AS (SELECT l_orderkey AS o_orderkey, l_partkey AS want, l_quantity / 60 AS vowel FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1),
tg AS (SELECT o_custkey AS song, o_orderkey, want, vowel, 45.0::DOUBLE + o_totalprice / 40000.0::DOUBLE AS pitch, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders JOIN first USING (o_orderkey)),
cand AS (SELECT song, k, q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, q.pos, round(0.15::DOUBLE * abs(pitch - f0) + 0.15::DOUBLE * greatest(abs(pitch - f0) - 3.0::DOUBLE, 0) * greatest(abs(pitch - f0) - 3.0::DOUBLE, 0)
  + 0.6::DOUBLE * greatest(s, 0) * greatest(s, 0) + 0.1::DOUBLE * greatest(-s, 0) + 1.5::DOUBLE * (1.0::DOUBLE - greatest(quality, 0)) + CASE WHEN vowel > 0.5 THEN CASE tone WHEN 3 THEN 0.3 WHEN 5 THEN 0.4 ELSE 0 END ELSE 0 END, 6) AS cost
  FROM tg JOIN (SELECT * FROM q) q ON q.l_partkey = want , LATERAL (SELECT ln(greatest(vowel / greatest(fd, 0.03::DOUBLE), 1e-3::DOUBLE)) AS s)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY song, k ORDER BY cost, l_orderkey, l_linenumber, l_partkey, l_suppkey, pos) AS rank FROM cand)"""


def candidates(spark, d, most: int, chained: bool = True) -> DataFrame:
    """The ``most`` cheapest units of the wanted part for every order, with target cost and rank; song = customer, k numbers its orders.

    chained: with each unit's place in its order and the unit after it, from one window before rejected units go; units of any rank that follow,
    in their order, a unit that the song's target before is offered are there too.
    """
    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    first = ranking.best_by(li.withColumn("vowel", F.col("l_quantity") / 60), ["l_orderkey"], F.lit(0), ["l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey", "vowel"])
    song = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    wanted = orders.join(first.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("want"), "vowel"), "o_orderkey")
    beside = {"want_before": F.lag("want").over(song), "want_after": F.lead("want").over(song)} if chained else {}
    wanted = wanted.withColumns({"k": F.row_number().over(song), **beside})
    wanted = wanted.select(F.col("o_custkey").alias("song"), "k", "want", *beside, "vowel", (45.0 + F.col("o_totalprice") / 40000.0).alias("pitch"))
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "f0")
    usable_part = F.when(~F.col("rejected"), F.col("l_partkey"))
    place = {"pos": F.row_number().over(own), "next_id": F.xxhash64(F.lead(F.struct(*UNIT_KEY, "f0")).over(own)), "part_before": F.lag(usable_part).over(own), "part_after": F.lead("l_partkey").over(own)} if chained else {}
    offered = rate(units(spark, d).withColumns(place), units(spark, d)).select(*UNIT_KEY, "f0", "fd", "quality", "tone", *(["energy"] if chained else []), *place)
    terms = {"distance": lambda u: F.abs(F.col("pitch") - u("f0")), "stretch": lambda u: scores.log_stretch("vowel", u("fd"))}
    cost = lambda u: F.round(scores.target_cost_of(u("distance"), u("stretch"), "vowel", u("quality"), u("tone"), F.lit(0), F.lit(0)), 6)
    follows = (lambda u: u("part_before") == F.col("want_before")) if chained else None
    found = ranking.of_same_key(wanted, offered, ["song", "k"], "want", "l_partkey", terms, cost, [*UNIT_KEY, "f0"], ["energy", *place] if chained else [], most, follows)
    # a next unit that the song's next target isn't offered is never met: no need to carry its hash
    return found.withColumn("next_id", F.when(F.col("part_after") == F.col("want_after"), F.col("next_id"))) if chained else found


@query(f"""WITH {_TARGETS} SELECT song, k, l_orderkey, l_linenumber, l_suppkey, rank, cost FROM ranked WHERE rank <= 3""")
def topk_candidates(spark, d):
    return candidates(spark, d, 3, chained=False).select("song", "k", "l_orderkey", "l_linenumber", "l_suppkey", F.col("rank").cast("long").alias("rank"), "cost").withColumn("k", F.col("k").cast("long"))


@query(f"""WITH {_TARGETS}, i AS (SELECT *, k - row_number() OVER (PARTITION BY song, l_orderkey, k - pos ORDER BY k) AS island FROM ranked),
r AS (SELECT *, max(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY song, l_orderkey, k - pos, island ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM i)
SELECT song, k, l_orderkey, l_linenumber, l_suppkey, rank FROM r WHERE kept = 1""")
def lattice_with_rescue(spark, d):
    offered = candidates(spark, d, 3).select("song", "k", "l_orderkey", "l_linenumber", "l_suppkey", "pos", "rank")
    kept = lattice.with_rescue(offered, "song", "k", "l_orderkey", "pos", "rank", 3)
    return kept.select("song", F.col("k").cast("long").alias("k"), "l_orderkey", "l_linenumber", "l_suppkey", F.col("rank").cast("long").alias("rank"))


@query()
def viterbi_select(spark, d):
    """The cheapest sequence for each song over its pruned lattice; tests hold it against brute force."""
    c, unit = F.col, F.struct("l_orderkey", "l_linenumber", F.col("want").alias("l_partkey"), "l_suppkey", "f0")
    offered = candidates(spark, d, 10).select("song", "k", "want", "pitch", "l_orderkey", "l_linenumber", "l_suppkey", "f0", "pos", "next_id", "energy", "cost", "rank")
    kept = lattice.with_rescue(offered.repartition("song"), "song", "k", "l_orderkey", "pos", "rank", 10)
    ready = kept.select("song", "k", F.xxhash64(unit).alias("unit_id"), F.coalesce("next_id", F.lit(0)).alias("next_id"), c("l_suppkey").alias("source"), (c("pitch") - c("f0")).alias("shift"), "energy", "cost", F.lit(0).alias("tier"), (c("k") > 1).alias("joined"), "rank")
    return lattice.select_sequence(ready, "song", "k", ["rank"], placed=True).withColumn("total_cost", r6(c("total_cost")))


@query(f"""WITH n AS (SELECT o_custkey, 45.0::DOUBLE + o_totalprice / 10000.0::DOUBLE AS p, o_totalprice / 100000.0::DOUBLE AS w FROM orders),
c AS (SELECT o_custkey, s, sum(w * (0.1::DOUBLE * abs(p + s - 55) + greatest(abs(p + s - 55) - 4.0::DOUBLE, 0) * greatest(abs(p + s - 55) - 4.0::DOUBLE, 0))) AS cost FROM n, unnest([-36, -24, -12, 0, 12, 24, 36]) AS t(s) GROUP BY o_custkey, s)
SELECT o_custkey, s AS shift, round(cost, 5) AS cost FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY round(cost, 9), s) = 1""")
def best_transpose(spark, d):
    notes = table(spark, d, "orders").select("o_custkey", (45.0 + F.col("o_totalprice") / 10000.0).alias("p"), (F.col("o_totalprice") / 100000.0).alias("w"))
    best = ranking.best_shift(notes, ["o_custkey"], lambda s: scores.transpose_cost(F.col("p") + s - 55, F.col("w")), range(-36, 37, 12))
    return best.withColumn("cost", F.round("cost", 5))


_CHAINS = f"""WITH {E}, u AS (SELECT event_id, user_id, event_type, round(value, 9) AS q, value > 5 AS ok, CASE WHEN lead(t) OVER w - t <= 6 THEN lead(event_id) OVER w END AS next_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""


@query(f"""{_CHAINS}, p AS (SELECT a.event_type || ' ' || b.event_type AS alias, a.event_id, b.event_id AS right_id, round(a.q + b.q, 9) AS score FROM u a JOIN u b ON a.next_id = b.event_id WHERE a.ok AND b.ok
UNION ALL SELECT event_type || ' R', event_id, NULL, q FROM u WHERE ok AND next_id IS NULL)
SELECT alias, event_id, right_id, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY alias ORDER BY score DESC, event_id) = 1""")
def best_pair_per_alias(spark, d):
    ev = events(spark, d).withColumns({"until": F.col("t"), "head": F.col("event_type")})
    linked = runs.link_neighbours(ev, U, O, "event_id", "t", "until", 6)
    pairs, ends = ranking.best_pairs(linked, "event_id", "next_id", "event_type", "head", "value", ["event_id"], F.col("value") > 5)
    both = pairs.unionByName(ends.withColumn("right_id", F.lit(None).cast("long")))
    return both.withColumn("score", r6(F.col("score")))


# --- interval and nearest joins

_SPANS = f"""WITH {E}, a AS (SELECT user_id, event_id, t AS s, t + value / 5 AS u FROM e WHERE event_type <> 'error'), b AS (SELECT user_id AS user_id, event_id AS old_id, t - 1 AS s2, t + value / 4 - 1 AS u2 FROM e WHERE event_type <> 'view')"""


def _spans(spark, d):
    ev = events(spark, d)
    a = ev.filter("event_type <> 'error'").select("user_id", "event_id", F.col("t").alias("s"), (F.col("t") + F.col("value") / 5).alias("u"))
    b = ev.filter("event_type <> 'view'").select("user_id", F.col("event_id").alias("old_id"), (F.col("t") - 1).alias("s2"), (F.col("t") + F.col("value") / 4 - 1).alias("u2"))
    return a, b


@query(f"""{_SPANS}, p AS (SELECT event_id, old_id, (least(u, u2) - greatest(s, s2)) / greatest(greatest(u - s, u2 - s2), 1e-9) AS ratio FROM a JOIN b ON a.user_id = b.user_id AND s < u2 AND s2 < u)
SELECT event_id, old_id, round(ratio, 6) AS ratio FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ratio DESC, old_id) = 1 AND ratio >= 0.55""")
def overlap_match(spark, d):
    a, b = _spans(spark, d)
    best = joins.best_overlap(a, b, U, "event_id", ("s", "u"), ("s2", "u2"), "old_id")
    return best.select("event_id", "old_id", r6(F.col("ratio")).alias("ratio"))


@query(f"""{_SPANS} SELECT a.event_id, count(*) AS n, min(old_id) AS first_id FROM a JOIN b ON a.user_id = b.user_id AND s < u2 AND s2 < u GROUP BY a.event_id""")
def overlap_counts(spark, d):
    a, b = _spans(spark, d)
    return joins.overlapping(a, b, U, ("s", "u"), ("s2", "u2")).groupBy("event_id").agg(F.count("*").alias("n"), F.min("old_id").alias("first_id"))


@query(f"""{_SPANS} SELECT event_id, old_id FROM a JOIN b ON a.user_id = b.user_id AND s >= s2 - 1e-4 AND u <= u2 + 1e-4""")
def contained_spans(spark, d):
    a, b = _spans(spark, d)
    return joins.contained(a, b, U, ("s", "u"), ("s2", "u2")).select("event_id", "old_id")


@query(f"""{_SPANS} SELECT e.event_id, min(old_id) AS line FROM e LEFT JOIN b ON e.user_id = b.user_id AND t + 0.5 >= s2 AND t + 0.5 < u2 GROUP BY e.event_id""")
def point_in_interval(spark, d):
    _, b = _spans(spark, d)
    points = events(spark, d).select("user_id", "event_id", (F.col("t") + 0.5).alias("at"))
    first = joins.points_in_intervals(points, b, U, "at", "s2", "u2").groupBy("event_id").agg(F.min("old_id").alias("line"))
    return points.select("event_id").join(first, "event_id", "left")


@query(f"""WITH {E}, g AS (SELECT user_id, t AS gt, i AS gi FROM e WHERE event_type = 'view') SELECT e.event_id, arg_min(gi, (abs(e.t + 1 - gt), gt)) AS nearest, max(gi) FILTER (gt <= e.t + 1) AS last FROM e LEFT JOIN g ON e.user_id = g.user_id GROUP BY e.event_id""")
def nearest_point(spark, d):
    ev = events(spark, d)
    grid = ev.filter("event_type = 'view'").select("user_id", F.col("t").alias("gt"), F.col("i").alias("gi"))
    points = ev.select("user_id", "event_id", (F.col("t") + 1).alias("at"))
    near = joins.nearest(points, grid, U, "at", "gt", ["gi"]).withColumnRenamed("gi", "nearest")
    return joins.as_of(near, grid, U, "at", "gt", ["gi"]).select("event_id", "nearest", F.col("gi").alias("last"))


@query(f"""WITH {E}, n AS (SELECT user_id, max(i) AS last FROM e GROUP BY user_id), p AS (SELECT e.user_id, event_id, CAST(round_even((i * 1.7::DOUBLE - 3) / 2.0::DOUBLE, 0) AS BIGINT) AS j, last FROM e JOIN n USING (user_id))
SELECT p.event_id, coalesce(a.value, 0) AS outside, b.value AS clamped FROM p LEFT JOIN e a ON a.user_id = p.user_id AND a.i = j JOIN e b ON b.user_id = p.user_id AND b.i = least(greatest(j, 0), last)""")
def frame_lookup(spark, d):
    ev = events(spark, d)
    points, frames = ev.select("user_id", "event_id", (F.col("i") * 1.7 - 3).alias("at")), ev.select("user_id", "i", "value")
    out = joins.frame_lookup(points, frames, U, "at", "i", "value", 2.0).withColumnRenamed("value", "outside")
    return joins.frame_lookup(out, frames, U, "at", "i", "value", 2.0, clamped=True).select("event_id", "outside", F.col("value").alias("clamped"))


@query(f"""WITH {E}, f AS (SELECT user_id, i, value FROM e), s AS (SELECT user_id, i AS k, t AS a, t + 2 AS b FROM e WHERE event_type = 'error') SELECT s.user_id, k, count(*) AS n, round(avg(e.value), 6) AS mean, max(e.value) AS peak FROM s JOIN e ON e.user_id = s.user_id AND e.t >= a AND e.t <= b GROUP BY s.user_id, k""")
def segment_summary(spark, d):
    ev = events(spark, d)
    spans = ev.filter("event_type = 'error'").select("user_id", F.col("i").alias("k"), F.col("t").alias("a"), (F.col("t") + 2).alias("b"))
    inside = joins.frames_in_spans(spans, ev.select("user_id", "t", "value"), U, "a", "b", "t")
    return inside.groupBy("user_id", "k").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.max("value").alias("peak"))


@query(f"""WITH {E}, a AS (SELECT user_id, event_id, i, round(t, 2) AS s, round(t, 2) + 1 AS u FROM e), b AS (SELECT user_id, event_id AS old_id, round(t, 2) + (event_id % 5 - 2) / 1000.0::DOUBLE AS s2, round(t, 2) + 1 + (event_id % 4) / 1000.0::DOUBLE AS u2 FROM e)
SELECT event_id, old_id FROM a JOIN b ON a.user_id = b.user_id AND abs(s - s2) <= 0.0025 AND abs(u - u2) <= 0.0025""")
def same_bounds(spark, d):
    ev = events(spark, d)
    s, x = F.round("t", 2), F.col("event_id")
    a = ev.select("user_id", "event_id", s.alias("s"), (s + 1).alias("u"))
    b = ev.select("user_id", x.alias("old_id"), (s + (x % 5 - 2) / 1000.0).alias("s2"), (s + 1 + (x % 4) / 1000.0).alias("u2"))
    return joins.same_bounds(a, b, U, ("s", "u"), ("s2", "u2"), 0.0025).select("event_id", "old_id")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_anti_join(spark, d):
    return joins.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("""SELECT d.doc_id, quality, CASE WHEN quality IS NOT NULL AND n_chars <= 4000 THEN 'label' ELSE 'split' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_sidecar(spark, d):
    rows = joins.first_of(table(spark, d, "documents").select("doc_id", "n_chars"), [table(spark, d, "labels")], ["doc_id"], "quality")
    origin = F.when(F.col("quality").isNotNull() & (F.col("n_chars") <= 4000), F.lit("label")).otherwise(F.lit("split"))
    return rows.select("doc_id", "quality", origin.alias("origin"))


@query("""WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn AS asked, b.turn AS answered FROM a JOIN b USING (conv_id, n)""")
def zip_positions(spark, d):
    c = table(spark, d, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("asked"))
    answered = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("answered"))
    return joins.zip_positions(asked, answered, ["conv_id"], ["asked"], ["answered"])


# --- scans and plans


@query(f"""WITH RECURSIVE {E}, p AS (SELECT user_id, list_distinct(list(round_even(t - t0, 6)) FILTER (t > t0)) AS pts, max(t) - min(t0) + 1 AS dur FROM (SELECT user_id, t, min(t) OVER (PARTITION BY user_id) AS t0 FROM e) GROUP BY user_id),
l AS (SELECT user_id, dur, list_reduce(list_transform(list_sort(pts), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 12 THEN list_concat(a, x) ELSE a END, [0.0::DOUBLE]) AS kept FROM p),
m AS (SELECT user_id, list_append(CASE WHEN len(kept) > 1 AND dur - kept[len(kept)] < 12 THEN kept[1:len(kept) - 1] ELSE kept END, round_even(dur, 6)) AS kept FROM l) SELECT user_id, unnest(kept) AS "at" FROM m""")
def greedy_min_gap(spark, d):
    ev = events(spark, d).withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy("user_id")))
    length = ev.groupBy("user_id").agg((F.max("t") + 1).alias("dur"))
    return sequence.thin_cutpoints(ev, U, "t", length, "dur", 12.0)


@query(f"""WITH {E}, c AS (SELECT user_id, round_even(t, 0) AS "at" FROM e WHERE event_type = 'view' UNION SELECT user_id, round_even(t + 0.4::DOUBLE, 0) FROM e WHERE event_type = 'click' UNION SELECT user_id, round_even(t, 0) FROM e WHERE value > 60) SELECT user_id, "at" FROM c""")
def candidate_union(spark, d):
    """Three producers of candidate points, each point once."""
    ev = events(spark, d)
    part = lambda cond, t: ev.filter(cond).select("user_id", F.bround(t).alias("at"))
    return part("event_type = 'view'", F.col("t")).union(part("event_type = 'click'", F.col("t") + 0.4)).union(part("value > 60", F.col("t"))).distinct()


@query(f"""WITH {E}, n AS (SELECT user_id, i AS k, i + 1 AS a, i + 1 + CAST(floor(value / 20) AS BIGINT) AS b, round_even(p, 0) AS tone FROM e WHERE event_type = 'click')
SELECT e.event_id, max_by(n.tone, n.k) AS painted FROM e LEFT JOIN n ON e.user_id = n.user_id AND e.i >= n.a AND e.i < n.b GROUP BY e.event_id""")
def paint_notes(spark, d):
    ev = events(spark, d)
    notes = ev.filter("event_type = 'click'").select("user_id", F.col("i").alias("k"), (F.col("i") + 1).alias("a"), (F.col("i") + 1 + F.floor(F.col("value") / 20)).alias("b"), F.bround("p").alias("painted"))
    return rendering.paint_notes(ev.select("user_id", "event_id", "i"), notes, U, "i", "a", "b", "k", "painted").select("event_id", "painted")


_PLAN = f"""WITH {E}, s AS (SELECT user_id, i, t, t + 0.1::DOUBLE AS v, t + 0.2::DOUBLE + value / 20 AS z, 0.0::DOUBLE AS us, (value % 7) / 20 AS bd, (value % 7) / 20 + 0.2::DOUBLE + (value % 5) / 10 AS ue FROM e),
c AS (SELECT *, least(bd - us, 0.18::DOUBLE) AS cons FROM s), j AS (SELECT *, coalesce(lead(t) OVER w - z <= 0.15, false) AS joined, lead(v) OVER w - lead(cons) OVER w AS nx FROM c WINDOW w AS (PARTITION BY user_id ORDER BY i)),
o AS (SELECT *, v - cons AS out_start, CASE WHEN joined THEN greatest(nx, v + 0.03::DOUBLE) + 0.03::DOUBLE ELSE z + 0.06::DOUBLE END AS out_end, bd + 0.25::DOUBLE * (ue - bd) AS ns, bd + 0.75::DOUBLE * (ue - bd) AS ne FROM j)"""


@query(f"""{_PLAN}, r AS (SELECT *, ns - bd AS att, least(ue - ne, 0.2::DOUBLE) AS tail, out_end - v AS vo FROM o)
SELECT user_id, i, round(out_start, 6) AS out_start, round(out_end, 6) AS out_end, vo > att + ne - ns + tail AS stretched, CASE WHEN vo > att + ne - ns + tail AND (vo - att - tail) / (ne - ns) > 2.5
  THEN CAST(greatest(1, round_even((vo - att - tail) / (ne - ns) / 2.5::DOUBLE, 0)) AS BIGINT) + 1 - CAST(greatest(1, round_even((vo - att - tail) / (ne - ns) / 2.5::DOUBLE, 0)) AS BIGINT) % 2 END AS half_cycles,
  CASE WHEN coalesce(lag(out_end) OVER (PARTITION BY user_id ORDER BY i) > out_start, false) THEN 0.03 ELSE 0.01 END::DOUBLE AS fade_in, CASE WHEN joined THEN 0.03 ELSE 0.06 END::DOUBLE AS fade_out FROM r""")
def render_plan(spark, d):
    v = F.col("value")
    chosen = events(spark, d).select(
        "user_id", "i", F.col("t").alias("syl_start"), (F.col("t") + 0.1).alias("vowel_start"), (F.col("t") + 0.2 + v / 20).alias("syl_end"), F.lit(0.0).alias("unit_start"), ((v % 7) / 20).alias("boundary"),
        ((v % 7) / 20 + 0.2 + (v % 5) / 10).alias("unit_end"),
    )
    # without a nucleus of its own a unit holds the middle half of its final
    chosen = chosen.withColumns({"nucleus_start": F.col("boundary"), "nucleus_end": F.col("boundary")})
    p = rendering.plan_placements(chosen, "user_id", "i")
    return p.select("user_id", "i", r6(F.col("out_start")).alias("out_start"), r6(F.col("out_end")).alias("out_end"), (F.size("knots_out") == 5).alias("stretched"), F.col("pingpong.half_cycles").cast("long").alias("half_cycles"), "fade_in", "fade_out")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 100 AS d, l_tax * 10 AS a, l_discount * 10 AS b, 1 - l_tax AS c FROM lineitem),
s AS (SELECT *, exp(-(d - 0.28::DOUBLE) * (d - 0.28::DOUBLE) / (2.0::DOUBLE * 0.2::DOUBLE * 0.2::DOUBLE)) AS ds FROM x),
y AS (SELECT *, 100.0::DOUBLE * (0.34::DOUBLE * a + 0.22::DOUBLE * (1 - b) + 0.22::DOUBLE * (1 - b) + 0.22::DOUBLE * ds) AS clarity, 100.0::DOUBLE * (0.44::DOUBLE * b + 0.24::DOUBLE * c + 0.14::DOUBLE * ds + 0.18::DOUBLE * c) * (1 - least(0.35::DOUBLE, 0.35::DOUBLE * a)) AS stability FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(clarity, 4) AS clarity, round(stability, 4) AS stability, CASE WHEN d < 0.05 OR clarity < 25 THEN 'weak' WHEN a >= 0.55 AND d <= 0.28 AND stability < 72 THEN 'onset' WHEN stability >= 62 AND c >= 0.3 AND d >= 0.1 THEN 'sustain' ELSE 'general' END AS role FROM y""")
def segment_scores(spark, d):
    c = F.col
    x = table(spark, d, "lineitem").select(*UNIT_KEY, (c("l_quantity") / 100).alias("d"), (c("l_tax") * 10).alias("a"), (c("l_discount") * 10).alias("b"), (1 - c("l_tax")).alias("c"))
    y = x.withColumns({"clarity": scores.clarity("a", "b", "b", "d"), "stability": scores.stability("b", "c", "d", "c", "a")})
    return y.select(*UNIT_KEY, F.round("clarity", 4).alias("clarity"), F.round("stability", 4).alias("stability"), scores.recommended_role("d", "clarity", "stability", "a", "c").alias("role"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 10 AS ms, l_tax * 1000 AS onset, l_extendedprice / 7000 AS tail FROM lineitem), n AS (SELECT *, greatest(ms, 1) AS m, greatest(20, greatest(ms, 1) * 0.15::DOUBLE) AS tg FROM x),
y AS (SELECT *, least(m - 5, greatest(25, onset + least(50, greatest(m - tg, 20) * 0.25::DOUBLE))) AS consonant FROM n), z AS (SELECT *, least(consonant, greatest(15, CASE WHEN onset > 0 THEN onset * 0.85::DOUBLE ELSE consonant * 0.7::DOUBLE END)) AS preutter FROM y)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(consonant, 4) AS consonant_ms, round(preutter, 4) AS preutterance_ms, round(least(preutter * 0.55::DOUBLE, greatest(5, CASE WHEN onset > 0 THEN onset * 0.45::DOUBLE ELSE preutter * 0.45::DOUBLE END)), 4) AS overlap_ms, round(-least(m - 1, greatest(15, greatest(tail, 15))), 4) AS cutoff_ms FROM z""")
def oto_timing(spark, d):
    c = F.col
    o = scores.oto_from_regions(c("l_quantity") / 100, c("l_tax"), F.lit(None).cast("double"), c("l_extendedprice") / 7000000)
    return table(spark, d, "lineitem").select(*UNIT_KEY, *(F.round(o[k], 4).alias(k) for k in ("consonant_ms", "preutterance_ms", "overlap_ms", "cutoff_ms")))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS BIGINT) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def markup_scan(spark, d):
    links = F.regexp_count("html", F.lit('<a href="[^"]*">[^<]*</a>')).cast("long")
    return table(spark, d, "pages").select("page_id", links.alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""SELECT s_suppkey, trim(regexp_replace(CASE WHEN contains(s_name, ' ') THEN 'vc ' || s_name ELSE s_name END, '[^0-9A-Za-z]+', '_', 'g'), '_') AS name, trim(regexp_replace('head ' || s_name, '[^0-9A-Za-z]+', '_', 'g'), '_') AS cleaned FROM supplier""")
def name_cleaning(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.safe_name("s_name").alias("name"), text.safe_name(F.concat(F.lit("- "), "s_name")).alias("cleaned"))


@query("""SELECT user_id, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY user_id""")
def track_percentiles(spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    return p.select("user_id", "n", r6(F.col("p")[0]).alias("p10"), r6(F.col("p")[1]).alias("p90"))


@query(f"""WITH {E}, d AS (SELECT user_id, i, value - 60.0 AS db FROM e), p AS (SELECT user_id, count(*) AS n, greatest(quantile_cont(db, 0.1) + 6.0, quantile_cont(db, 0.9) - 35.0) AS lim FROM d GROUP BY user_id),
f AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM d JOIN p USING (user_id) WHERE db > lim), r AS (SELECT user_id, min(i) AS a, max(i) + 1 AS b FROM f GROUP BY user_id, g),
o AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a) < 2 THEN 0 ELSE 1 END AS opens FROM r), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY a) AS k FROM o),
m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM s GROUP BY user_id, k HAVING max(b) - min(a) >= 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS n, round(greatest(0.0, a * 0.25::DOUBLE - 0.08), 6) AS "start", round(least(n * 0.25::DOUBLE, b * 0.25::DOUBLE + 0.08), 6) AS "end" FROM m JOIN p USING (user_id)""")
def silence_split(spark, d):
    """Speech spans of each track from its levels; none is cut at its quietest frame, which tests hold against brute force."""
    ev = events(spark, d).withColumn("db", F.col("value") - 60.0)
    out = segmentation.split_on_silence(ev, U, "i", "db", 0.25, min_silence=0.6, min_speech=0.5, max_chunk=1e6)
    return out.select("user_id", F.col("n").cast("long").alias("n"), r6(F.col("start")).alias("start"), r6(F.col("end")).alias("end"))


@query()
def note_segmentation(spark, d):
    """Notes of each user's value track, read as pitch in Hz."""
    ev = events(spark, d).select("user_id", "i", (100.0 + F.col("value")).alias("hz"), F.lit(0.0).alias("a"), F.lit(0.0).alias("tuning"))
    ends = ev.groupBy("user_id").agg((F.count("*") * 0.01).alias("b"))
    return segmentation.segment_notes(ev.join(ends, "user_id"), U, "i", "hz", "a", "b", "tuning")
