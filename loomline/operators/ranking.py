"""Top-k, best-of and tiered candidates. Every choice is settled by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts groups to k before the shuffle as well."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, nth).filter(F.col(name) <= k)


def of_same_key(targets: DataFrame, units: DataFrame, by: list[str], key: str, unit_key: str, terms: dict, cost, order: list[str], keep: list[str], k: int, also=None, name: str = "rank", hold: int = 2000) -> DataFrame:
    """targets with ``cost``, order and keep of the first k units of their key, numbered by cost and order over all of them; where also(unit)
    holds, units beyond k stay too, under their number.

    by: what tells targets apart; terms (by name), cost and also take a function from a unit's column name to that column, cost from names of terms
    too. The units of a key come together as
    one list and a target is rated against it in its own row, so what doesn't stay is never shuffled or sorted. Keys of over ``hold`` units have
    no list: their pairs are rows, ranked by a window.
    """
    kept = [c for c in dict.fromkeys([*order, *keep]) if c != unit_key]
    big = units.groupBy(F.col(unit_key).alias("__key")).agg(F.count("*").alias("__n")).filter(F.col("__n") > hold).select("__key")
    skewed = not big.isEmpty()
    short = units.join(big, F.col(unit_key) == F.col("__key"), "left_anti") if skewed else units
    rest = [c for c in units.columns if c not in (unit_key, *kept)]
    every = [*kept, *rest]
    lists = short.repartition(unit_key).groupBy(F.col(unit_key).alias("__key")).agg(F.collect_list(F.struct(*every)).alias("__units"))
    met = targets.join(lists.hint("merge"), F.col(key) == F.col("__key"))
    termed = F.transform("__units", lambda u: F.struct(*(u[c].alias(c) for c in every), *(f(u.getField).alias(c) for c, f in terms.items())))
    rated = F.sort_array(F.transform(termed, lambda u: F.struct(cost(u.getField).alias("cost"), *(u[c].alias(c) for c in kept))))
    if also is None:
        out = met.select(*targets.columns, F.posexplode(F.slice(rated, 1, k)).alias("__i", "__u")).withColumn(name, F.col("__i") + 1)
    else:
        numbered = F.transform(rated, lambda u, i: F.struct((i + 1).alias("i"), u.alias("u")))
        stay = F.filter(numbered, lambda x: (x["i"] <= k) | F.coalesce(also(x["u"].getField), F.lit(False)))
        out = met.select(*targets.columns, F.explode(stay).alias("__x")).withColumns({name: F.col("__x.i"), "__u": F.col("__x.u")})
    fields = ["cost", *kept]
    out = out.select(*targets.columns, name, *(F.col(f"__u.{c}").alias(c) for c in fields))
    if not skewed:
        return out
    pairs = targets.join(units.join(big, F.col(unit_key) == F.col("__key"), "left_semi").hint("merge"), F.col(key) == F.col(unit_key))
    pairs = pairs.withColumns({c: f(F.col) for c, f in terms.items()}).withColumn("cost", cost(F.col))
    ranked = pairs.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("cost", *(c for c in order if c != unit_key))))
    stay = F.col(name) <= k if also is None else (F.col(name) <= k) | F.coalesce(also(F.col), F.lit(False))
    return out.unionByName(ranked.filter(stay).select(*out.columns))


def best_by(rows: DataFrame, by: list[str], cost: Column, order: list[str], keep: list[str]) -> DataFrame:
    """The row of least cost of each group, ties by order: a partial aggregate, so a hot group shrinks before the shuffle."""
    names = list(dict.fromkeys([*order, *keep]))
    best = F.min(F.struct(cost.alias("__cost"), *names))
    return rows.groupBy(*by).agg(best.alias("__b")).select(*by, *(F.col(f"__b.{c}").alias(c) for c in keep))


def resolve_tiers(wanted: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (distinct values of keys) with ``tier``: the first key that available has too; len(keys) if none.

    All or nothing: a tier counts only where every earlier one is empty.
    """
    out = wanted
    for n, k in enumerate(keys):
        has = available.select(F.col(k)).filter(F.col(k).isNotNull()).distinct().withColumn(f"__t{n}", F.lit(n))
        out = out.join(has, k, "left")
    tier = F.coalesce(*(F.col(f"__t{n}") for n in range(len(keys))), F.lit(len(keys)))
    return out.withColumn("tier", tier).drop(*(f"__t{n}" for n in range(len(keys))))


def tiered_candidates(targets: DataFrame, units: DataFrame, keys: list[str], fallback: DataFrame | None = None, most: int = 100_000_000) -> DataFrame:
    """Each target with the units of its tier. Target columns keep their names, unit columns must differ but for the keys.

    Targets that no key matches meet all of ``fallback`` (none by default). These should be very few: their number times that of the
    units is what is looked at, though a top_k that follows cuts it before any shuffle. Over ``most`` such pairs are refused.
    """
    distinct = targets.select(*keys).distinct()
    placed = targets.join(resolve_tiers(distinct, units, keys), keys)
    extra = [c for c in units.columns if c not in keys]
    parts = []
    for n, k in enumerate(keys):
        own = placed.filter(F.col("tier") == n)
        parts.append(own.join(units.select(k, *extra), k).select(*targets.columns, "tier", *extra))
    if fallback is not None:
        lone = placed.filter(F.col("tier") == len(keys))
        pairs = (n := lone.count()) and n * fallback.count()
        if pairs > most:
            raise ValueError(f"{n} targets match no key: with the fallback that makes {pairs} pairs, over {most}")
        parts.append(lone.crossJoin(fallback.select(*extra)).select(*targets.columns, "tier", *extra))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tiered_counts(targets: DataFrame, units: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
    """targets with ``tier`` and the number of units in it (0 if none); units come counted in ``n``.

    The units of a value are one sum, so a target meets a row a key, never the units.
    """
    out, held = targets, []
    for i, k in enumerate(keys):
        own = units.filter(F.col(k).isNotNull()).groupBy(k).agg(F.sum(n).alias(f"__n{i}"))
        out = out.join(own, k, "left")
        held.append(F.struct(F.lit(i).alias("tier"), F.col(f"__n{i}").alias("n")))
    first = F.coalesce(*(F.when(x["n"].isNotNull(), x) for x in held), F.struct(F.lit(len(keys)).alias("tier"), F.lit(0).cast("long").alias("n")))
    return out.withColumn("__first", first).select(*targets.columns, F.col("__first.tier").alias("tier"), F.col("__first.n").alias(name))


def best_shift(rows: DataFrame, by: list[str], cost, shifts: range, gain: float = 1e-9) -> DataFrame:
    """by, shift, cost: the shift of least summed cost(shift); of shifts within ``gain`` the smallest.

    One pass: a sum for each shift, compared in the aggregate's own row.
    """
    sums = rows.groupBy(*by).agg(*(F.sum(cost(s)).alias(f"__s{k}") for k, s in enumerate(shifts)))
    pairs = F.array(*(F.struct(F.col(f"__s{k}").alias("cost"), F.lit(s).alias("shift")) for k, s in enumerate(shifts)))
    best = F.aggregate(F.slice(pairs, 2, len(shifts)), F.element_at(pairs, 1), lambda a, x: F.when(x["cost"] < a["cost"] - gain, x).otherwise(a))
    return sums.withColumn("__b", best).select(*by, F.col("__b.shift").alias("shift"), F.col("__b.cost").alias("cost"))


def best_window(frames: DataFrame, by: list[str], index: str, score: Column) -> DataFrame:
    """by, at: where a score is least, the first of equals."""
    return frames.filter(score.isNotNull()).groupBy(*by).agg(F.min(F.struct(score.alias("s"), F.col(index).alias("at")))["at"].alias("at"))


def best_pairs(units: DataFrame, unit_id: str, next_id: str, group: str, head: str, quality: str, order: list[str], usable: Column) -> tuple[DataFrame, DataFrame]:
    """The best pair for each alias 'group head' of neighbours, and the best ending for each group.

    A unit whose neighbour isn't usable gives neither; one without neighbour gives an ending.
    """
    own = units.filter(usable & F.col(group).isNotNull())
    right = units.filter(usable & F.col(head).isNotNull()).select(F.col(unit_id).alias("right_id"), F.col(head).alias("__head"), F.col(quality).alias("__q"))
    pairs = own.drop(head).join(right, F.col(next_id) == F.col("right_id"))
    alias = F.concat_ws(" ", group, "__head")
    best = best_by(pairs.withColumns({"alias": alias, "score": F.round(F.col(quality) + F.col("__q"), 9)}), ["alias"], -F.col("score"), order, [unit_id, "right_id", "score"])
    ends = own.filter(F.col(next_id).isNull()).withColumns({"alias": F.concat_ws(" ", group, F.lit("R")), "score": F.round(F.col(quality), 9)})
    return best, best_by(ends, ["alias"], -F.col("score"), order, [unit_id, "score"])
