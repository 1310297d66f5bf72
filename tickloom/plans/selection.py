"""Exact quantiles by narrowing the range of values, without sorting the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.session import stage

#: Values of a group that are taken into one sorted array, and equal shares at which a range is cut.
SMALL_ROWS, CUTS = 20_000, 256


def _inside(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """The values strictly between ``_lo`` and ``_hi`` of their group; a missing end is open."""
    ranges = ranges.withColumnsRenamed({b: f"_r_{b}" for b in by})
    same = [F.col(b).eqNullSafe(F.col(f"_r_{b}")) for b in by]
    within = (F.col("_lo").isNull() | (F.col("_x") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_x") < F.col("_hi")))
    met = values.join(ranges, same).filter(within)
    return met.drop(*[f"_r_{b}" for b in by])


def _narrow(values: DataFrame, wide: DataFrame, by: list[str], margin: int) -> DataFrame:
    """One round: cut the range of each group at equal shares, keep the part that holds the ranks still sought.

    The cuts come from a sketch; what lies below, at and between the two chosen ones is then counted, and ranges whose counts do
    not hold the ranks stay as they are for a round with a wider margin.
    """
    fields = wide.columns
    accuracy = 8 * CUTS
    cuts = _inside(values, wide, by).groupBy(*by).agg(
        F.percentile_approx("_x", [i / CUTS for i in range(CUTS + 1)], accuracy).alias("_cuts")
    ).withColumnsRenamed({b: f"_c_{b}" for b in by})
    low = F.when(F.col("_low_v").isNull(), F.col("_low_at")).otherwise(F.col("_high_at"))
    high = F.when(F.col("_high_v").isNull(), F.col("_high_at")).otherwise(F.col("_low_at"))
    share = lambda rank: (rank - F.col("_below")) / F.greatest(F.col("_m") - 1, F.lit(1)) * CUTS
    first, last = F.floor(share(low)).cast("int") - margin, F.ceil(share(high)).cast("int") + margin
    bounds = wide.join(cuts, [F.col(b).eqNullSafe(F.col(f"_c_{b}")) for b in by]).drop(*[f"_c_{b}" for b in by])
    bounds = bounds.withColumns({
        "_a": F.when(first >= 0, F.get("_cuts", F.greatest(first, F.lit(0)))),
        "_b": F.when(last <= CUTS, F.get("_cuts", F.least(last, F.lit(CUTS)))),
    }).drop("_cuts")
    bounds = stage(bounds, "bounds")
    x, a, b = F.col("_x"), F.col("_a"), F.col("_b")
    after = a.isNull() | (x > a)
    counts = _inside(values, bounds, by).groupBy(*by).agg(
        F.count_if(x < a).alias("_n_under"), F.count_if(x == a).alias("_n_a"),
        F.count_if(after & (b.isNull() | (x < b))).alias("_n_in"), F.count_if(after & (x == b)).alias("_n_b"),
    ).withColumnsRenamed({k: f"_c_{k}" for k in by})
    met = bounds.join(counts, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in by]).drop(*[f"_c_{k}" for k in by])
    at_a = F.col("_below") + F.col("_n_under")
    at_in = at_a + F.col("_n_a")
    at_b = at_in + F.col("_n_in")
    end = at_b + F.col("_n_b")

    def value(rank: Column, known: Column) -> Column:
        return F.when(known.isNotNull(), known).when((rank >= at_a) & (rank < at_in), a).when((rank >= at_b) & (rank < end), b)

    def held(rank: Column, known: Column) -> Column:
        return known.isNotNull() | ((rank >= at_a) & (rank < end))

    ok = held(F.col("_low_at"), F.col("_low_v")) & held(F.col("_high_at"), F.col("_high_v"))
    keep = lambda new, old: F.when(ok, new).otherwise(F.col(old))
    return met.withColumn("_ok", ok).select(
        *by, "_n", "_low_at", "_high_at",
        keep(value(F.col("_low_at"), F.col("_low_v")), "_low_v").alias("_low_v"),
        keep(value(F.col("_high_at"), F.col("_high_v")), "_high_v").alias("_high_v"),
        keep(F.coalesce(a, F.col("_lo")), "_lo").alias("_lo"), keep(F.coalesce(b, F.col("_hi")), "_hi").alias("_hi"),
        keep(at_in, "_below").alias("_below"), keep(F.col("_n_in"), "_m").alias("_m"),
    ).select(*fields)


def select_quantile(df: DataFrame, column: str, q: float, by: Sequence[str] = (), small: int = SMALL_ROWS) -> DataFrame:
    """Exact interpolated quantile ``quantile`` of ``column`` and number of values ``n`` per group.

    Each round reads the values twice (cuts, then counts) and narrows the open range that holds the two ranks sought to about
    a hundredth, until it holds at most ``small`` values, which one array per group takes. A value that
    is repeated beyond that lies at an end of a range and is counted, not gathered. Groups hold any share of the rows: only
    sketches and counts are shuffled. Null and NaN values are left out; a group without values gives no row, and no group at
    all gives one row with n = 0.
    """
    by, keys = list(by), [f"_k{i}" for i in range(len(by))]
    x = F.col(column)
    kind = df.select(x).schema[0].dataType
    ok = x.isNotNull() & ~F.isnan(x) if isinstance(kind, (T.DoubleType, T.FloatType)) else x.isNotNull()
    # One constant group where none is named, so that all joins have a key.
    groups = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias("_k0")]
    keys = keys or ["_k0"]
    values = stage(df.filter(ok).select(*groups, x.alias("_x")), "values")
    rank = (F.col("_n") - 1) * F.lit(float(q))
    none = F.lit(None).cast(kind)
    state = stage(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_n", F.floor(rank).alias("_low_at"), F.ceil(rank).alias("_high_at"), none.alias("_low_v"), none.alias("_high_v"),
        none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_m"),
    ), "ranks")
    sought = F.col("_low_v").isNull() | F.col("_high_v").isNull()
    margin = 1
    while not (wide := state.filter(sought & (F.col("_m") > small))).isEmpty():
        state = stage(state.filter(~(sought & (F.col("_m") > small))).unionByName(_narrow(values, wide, keys, margin)), "ranks")
        margin += 1
    lists = _inside(values, state.filter(sought), keys).groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    lists = lists.withColumnsRenamed({k: f"_c_{k}" for k in keys})
    met = state.join(lists, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys], "left")
    pick = lambda known, at: F.coalesce(known, F.get("_xs", (F.col(at) - F.col("_below")).cast("int")))
    low, high = pick(F.col("_low_v"), "_low_at"), pick(F.col("_high_v"), "_high_at")
    result = (low + (high - low) * (rank - F.col("_low_at"))).alias("quantile")
    if by:
        return met.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], result, F.col("_n").alias("n"))
    whole = met.select(result, F.col("_n").alias("n"))
    return whole.agg(F.max("quantile").alias("quantile"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
