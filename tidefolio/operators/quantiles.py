"""Exact order statistics per group, for groups of any size, by one plan that looks at no data beforehand.

Groups of up to ``WHOLE`` values are sorted as one list each. In larger ones each wanted rank is bracketed by an approximate quantile sketch (bounded state, combined on the map side; the smallest and
largest value for groups too small for its accuracy). The bracket is cut into equal bins whose counts are combined on the
map side too; running sums over a group's bins tell which of them hold the wanted ranks, and only the values of those are
ranked. Values below the bracket are merely counted, those above it are not read on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import attach, grouped, one_of

SKETCH_ACCURACY = 10_000  # the sketch's rank error is at most n / SKETCH_ACCURACY
WHOLE = 4 * SKETCH_ACCURACY  # below this many values the bracket would hold too few ranks to be safe
BINS = 1024


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], method: str = "linear"
) -> DataFrame:
    """One row per group with a column per entry of ``probs``.

    ``method`` is ``linear`` (interpolate at p(n-1)) or ``nearest`` (the value at round(p(n-1)), halves up).
    """
    one_of(method, ("linear", "nearest"), "method")
    small, large = _by_size(df, by, value)
    sorted_ = grouped(small, by, F.sort_array(F.collect_list("_x")).alias("_s"))
    few = sorted_.select(*by, *[_picked(p, method).alias(n) for n, p in probs.items()])
    return _united(few, _sketched(large, by, probs, method), by)


def quantiles_with_tails(df: DataFrame, by: list[str], value: str, probs: dict[str, float], upper: bool = True) -> DataFrame:
    """Interpolated quantiles, each with the mean of the values at or above it (else at or below) as ``<name>_tail``."""
    small, large = _by_size(df, by, value)

    def beyond(x: Column, name: str) -> Column:
        return x >= F.col(name) if upper else x <= F.col(name)

    def listed_tail(name: str) -> Column:
        part = F.filter(F.col("_s").cast("array<double>"), lambda x: beyond(x, name))
        return F.try_divide(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), F.size(part).cast("double"))

    sorted_ = grouped(small, by, F.sort_array(F.collect_list("_x")).alias("_s"))
    few = sorted_.select(*by, "_s", *[_picked(p, "linear").alias(n) for n, p in probs.items()])
    few = few.select(*by, *probs, *[listed_tail(n).alias(n + "_tail") for n in probs])
    tails = [F.avg(F.when(beyond(F.col("_x"), n), F.col("_x"))).alias(n + "_tail") for n in probs]
    levels = [F.first(n).alias(n) for n in probs]
    return _united(few, grouped(_beside(large, _sketched(large, by, probs, "linear"), by), by, *levels, *tails), by)


def _by_size(df: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The values (not NULL, as ``_x``) of groups of at most ``WHOLE`` of them, which one row can hold, and those of larger
    groups, of which there are few enough to broadcast what is known of each: no row travels for its group's sake."""
    x = F.col(value)
    data = df.where(x.isNotNull()).select(*by, x.alias("_x"))
    for c in by:
        data = data.where(F.col(c).isNotNull())
    if not by:
        many = data.agg(F.count("_x")).scalar() > WHOLE
        return data.where(~many), data.where(many)
    large = data.groupBy(*by).agg(F.count("_x").alias("_n")).where(F.col("_n") > WHOLE).select(*by)
    return data.join(F.broadcast(large), by, "left_anti"), data.join(F.broadcast(large), by, "left_semi")


def _beside(large: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Facts about large groups on each of their rows."""
    return large.join(F.broadcast(facts), by) if by else attach(large, facts, by)


def _united(small: DataFrame, large: DataFrame, by: list[str]) -> DataFrame:
    both = small.unionByName(large)
    return both if by else both.agg(*[F.max(c).alias(c) for c in both.columns])


def _picked(p: float, method: str) -> Column:
    rank, part = _position(p, F.size("_s"), method)
    at = rank.cast("int")
    return _between(F.get("_s", at), F.get("_s", at + 1), part)


def _sketched(data: DataFrame, by: list[str], probs: dict[str, float], method: str) -> DataFrame:
    margin = 2.0 / SKETCH_ACCURACY
    cuts = sorted({min(max(p + s * margin, 0.0), 1.0) for p in probs.values() for s in (-1, 1)})
    place = {c: i for i, c in enumerate(cuts)}
    facts = grouped(
        data,
        by,
        F.count("_x").alias("_n"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
        F.percentile_approx("_x", cuts, SKETCH_ACCURACY).alias("_cuts"),
    )

    def target(name: str, p: float) -> Column:
        rank, part = _position(p, F.col("_n"), method)
        whole = F.col("_n") <= WHOLE
        lo = F.lit(None) if p - margin <= 0 else F.when(~whole, F.col("_cuts")[place[p - margin]])
        hi = F.lit(None) if p + margin >= 1 else F.when(~whole, F.col("_cuts")[place[p + margin]])
        return F.struct(
            F.lit(name).alias("name"),
            rank.alias("rank"),
            part.alias("part"),
            F.coalesce(lo, F.col("_min")).alias("lo"),
            F.coalesce(hi, F.col("_max")).alias("hi"),
        )

    wanted = facts.select(*by, F.array(*[target(n, p) for n, p in probs.items()]).alias("_targets"))
    probes = _beside(data, wanted, by).select(*by, "_x", F.explode("_targets").alias("_t")).where("_x <= _t.hi")
    width = F.col("_t.hi") - F.col("_t.lo")
    at = F.least(F.floor((F.col("_x") - F.col("_t.lo")) / width * BINS), F.lit(BINS - 1))
    # Infinite ends leave one bin.
    bin_ = F.when(F.col("_x") < F.col("_t.lo"), -1).when((width > 0) & (width < float("inf")), at).otherwise(0)
    probes = probes.select(*by, "_x", F.col("_t.name").alias("name"), "_t.rank", "_t.part", bin_.cast("int").alias("_bin"))
    key = [*by, "name"]
    counts = probes.groupBy(*key, "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.first("rank").alias("rank"), F.first("part").alias("part")
    )
    upto = F.sum("_c").over(W.partitionBy(*key).orderBy("_bin"))
    holding = (
        counts.withColumn("_upto", upto)
        .withColumn("_before", F.col("_upto") - F.col("_c"))
        .where((F.col("_upto") > F.col("rank")) & (F.col("_before") <= F.col("rank") + 1))
        .select(*key, "_bin", "_before", "rank", "part")
    )
    values = probes.select(*key, "_bin", "_x").join(F.broadcast(holding), [*key, "_bin"]).groupBy(*key, "_bin", "_x").agg(
        F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("rank").alias("rank"), F.first("part").alias("part")
    )
    reached = F.col("_before") + F.sum("_c").over(W.partitionBy(*key, "_bin").orderBy("_x"))
    found = (
        values.withColumn("_upto", reached)
        .groupBy(*key)
        .agg(
            F.min(F.when(F.col("_upto") > F.col("rank"), F.col("_x"))).alias("_a"),
            F.min(F.when(F.col("_upto") > F.col("rank") + 1, F.col("_x"))).alias("_b"),
            F.first("part").alias("part"),
        )
        .withColumn("_q", _between(F.col("_a"), F.col("_b"), F.col("part")))
    )
    return grouped(found, by, *[F.max(F.when(F.col("name") == n, F.col("_q"))).alias(n) for n in probs])


def _position(p: float, n: Column, method: str) -> tuple[Column, Column]:
    """Rank from 0 and the part of the way to the next rank."""
    exact = F.lit(float(p)) * (n - 1)
    if method == "nearest":
        return F.floor(exact + 0.5), F.lit(0.0)
    return F.floor(exact), exact - F.floor(exact)


def _between(a: Column, b: Column, part: Column) -> Column:
    return F.when(part > 0, a + (b - a) * part).otherwise(a)
