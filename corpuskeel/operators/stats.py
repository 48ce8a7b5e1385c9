"""Summaries and comparisons of experiment metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import exact_quantiles, join_per_key, range_rank, range_scan, shuffled


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, sample sd (null for n < 2), min, max per key; no value is clamped."""
    by = list(by)
    plain = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    middle = exact_quantiles(df, by, value, {"median": 0.5})
    joined = plain.join(middle, by, "left") if by else plain.crossJoin(middle)  # one row each without keys
    return joined.select(*by, "n", "mean", "median", "sd", "min", "max")


def describe_levels(df: DataFrame, coarse: str, fine: str, value: str) -> DataFrame:
    """Summary per `coarse` and per (`coarse`, `fine`) in one result; `fine` is null on the upper level."""
    sums = df.groupingSets([[F.col(coarse)], [F.col(coarse), F.col(fine)]], coarse, fine).agg(
        F.grouping(fine).cast("int").alias("is_total"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    upper = exact_quantiles(df, [coarse], value, {"median": 0.5}).withColumn(fine, F.lit(None).cast(df.schema[fine].dataType)).withColumn("is_total", F.lit(1))
    lower = exact_quantiles(df, [coarse, fine], value, {"median": 0.5}).withColumn("is_total", F.lit(0))
    medians = upper.unionByName(lower)
    on = (
        (F.col("a.is_total") == F.col("b.is_total"))
        & (F.col(f"a.{coarse}") == F.col(f"b.{coarse}"))
        & F.col(f"a.{fine}").eqNullSafe(F.col(f"b.{fine}"))
    )
    return sums.alias("a").join(medians.alias("b"), on, "left").select("a.*", "b.median")


def histogram(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Histogram of a bounded integer as one sorted map per key."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(value), F.col("n"))))
    return histogram(df, by, value).groupBy(*by).agg(F.map_from_entries(entries).alias("histogram"))


def size_histogram(groups: DataFrame, group: str, *flags: str) -> DataFrame:
    """Number of groups per size, apart for groups in which some row has a flag set."""
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("size"), *[F.max(f).alias(f) for f in flags])
    return sizes.groupBy("size", *flags).agg(F.count(F.lit(1)).alias("n_groups"))


def run_states(expected: DataFrame, observed: DataFrame, statuses: Sequence[str] = ("completed", "failed", "interrupted")) -> DataFrame:
    """Every expected run with its status, or missing; unexpected, repeated and mismatching ones are named."""
    seen = observed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("seed").alias("_seed"),
        F.first("condition").alias("_condition"),
        F.first("status").alias("_status"),
    )
    return expected.join(seen, "run_id", "full_outer").select(
        "run_id",
        F.when(F.col("seed").isNull(), "unexpected")
        .when(F.col("_n").isNull(), "missing")
        .when(F.col("_n") > 1, "duplicate")
        .when((F.col("_seed") != F.col("seed")) | (F.col("_condition") != F.col("condition")), "mismatch")
        .when(~F.col("_status").isin(*statuses), "unknown_status")
        .otherwise(F.col("_status"))
        .alias("state"),
    )


def paired_differences(df: DataFrame, seed: str, condition: str, value: str, first: str, second: str) -> DataFrame:
    """(seed, difference) for seeds observed under both conditions; one value per cell is required."""
    one = F.when(F.col(condition) == first, F.col(value))
    two = F.when(F.col(condition) == second, F.col(value))
    cells = df.filter(F.col(condition).isin(first, second)).groupBy(seed).agg(
        F.max(one).alias("_a"), F.count(one).alias("_na"), F.max(two).alias("_b"), F.count(two).alias("_nb")
    )
    guard = F.when((F.col("_na") > 1) | (F.col("_nb") > 1), F.raise_error(F.lit("repeated condition and seed")).cast("double"))
    return (
        cells.filter((F.col("_na") > 0) & (F.col("_nb") > 0))
        .select(seed, F.coalesce(guard, F.col("_b") - F.col("_a")).alias("difference"))
    )


def paired_effect(differences: DataFrame) -> DataFrame:
    """n, mean difference and Cohen's dz; null where the sd is missing or zero."""
    sd = F.stddev_samp("difference")
    return differences.agg(
        F.count(F.lit(1)).alias("n"), F.avg("difference").alias("mean_difference"), sd.alias("_sd")
    ).select("n", "mean_difference", F.when(F.col("_sd") > 0, F.col("mean_difference") / F.col("_sd")).alias("cohens_dz"))


# Share of a Poisson variable of mean 1 up to k events, k = 0, 1, ...; beyond the last it is 1 in 32 bits.
POISSON_CUTS = [math.floor(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]
DRAWS_PER_DIGEST = 4
# Draws of exactly n for n units that a task makes.
DRAWS_PER_TASK = 500_000


def bootstrap_multiplicity(unit: Column, sample: Column, seed: int) -> Column:
    """How often a unit enters a resample: a Poisson draw of mean 1 from 32 bits of md5(seed:unit:sample div 4)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), unit.cast("string"), F.floor(sample / DRAWS_PER_DIGEST).cast("string")))
    number = F.conv(F.substring(digest, sample % DRAWS_PER_DIGEST * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return sum((F.when(number >= cut_, 1).otherwise(0) for cut_ in POISSON_CUTS), F.lit(0))


def bootstrap_means(values: DataFrame, unit: str, samples: int, seed: int) -> DataFrame:
    """(sample, estimate): mean per resample of `values` (`unit`, total, weight), totals over weights.

    A Poisson bootstrap: units enter a resample independently, as often as a Poisson variable of mean 1 says,
    which for many units is the usual bootstrap with a random number of draws. The draw depends on (seed,
    unit, sample) alone, so every unit is drawn where it lies and the sums merge map-side: what is shuffled is
    one row per task and sample. A resample without any weight has a null estimate.
    """
    drawn = values.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    times = bootstrap_multiplicity(F.col(unit), F.col("sample"), seed)
    weight = F.sum(times * F.col("weight"))
    return drawn.groupBy("sample").agg(F.when(weight != 0, F.sum(times * F.col("total")) / weight).alias("estimate"))


def percentile_interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return exact_quantiles(cut(means, "estimates"), [], "estimate", {"low": tail, "high": 1 - tail})


def paired_bootstrap(
    differences: DataFrame, seed_col: str, samples: int, seed: int, complete: bool, min_pairs: int = 5
) -> DataFrame:
    """Percentile interval of the mean difference; withheld (nulls) below `min_pairs` or if incomplete."""
    n = differences.count()
    if n < min_pairs or not complete:
        return differences.sparkSession.range(1).select(
            F.lit(n).cast("long").alias("n"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(True).alias("withheld")
        )
    units = differences.select(seed_col, F.col("difference").alias("total"), F.lit(1.0).alias("weight"))
    return percentile_interval(bootstrap_means(units, seed_col, samples, seed)).select(
        F.lit(n).cast("long").alias("n"), "low", "high", F.lit(False).alias("withheld")
    )


def drawn_means(units: DataFrame, unit: str, samples: int, seed: int) -> DataFrame:
    """(sample, estimate): mean per resample of exactly as many draws, with replacement, as there are units.

    `units` hold a numeric `unit`, total and weight and are numbered in its order. Draw i of a sample is the unit
    at position md5(seed:sample:i) mod n; every unit makes its own draw of every sample, so the table of draws
    grows where the units are. Draws and units meet by a shuffle: the planner takes the draws for as many rows as there
    are units, and a broadcast of them ends the driver.
    """
    numbered = range_rank(units, [], unit, name="position").select((F.col("position") - 1).alias("position"), "total", "weight")
    numbered = cut(numbered, "units")
    n = numbered.count()
    # The units are few bytes and their draws many rows, so they are dealt to tasks by their draws.
    dealt = numbered.select(F.col("position").alias("slot")).repartition(max(1, n * samples // DRAWS_PER_TASK), "slot")
    slots = dealt.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample"), F.col("slot")))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    drawn = slots.select("sample", F.pmod(number, F.lit(n)).alias("position"))
    weight = F.sum("weight")
    return drawn.join(shuffled(numbered), "position").groupBy("sample").agg(F.when(weight != 0, F.sum("total") / weight).alias("estimate"))


def clustered_bootstrap(df: DataFrame, group: str, value: str, samples: int, seed: int) -> DataFrame:
    """Percentile interval of the mean with whole groups as the unit of resampling, n draws for n groups."""
    units = df.groupBy(group).agg(F.sum(value).alias("total"), F.count(value).cast("double").alias("weight"))
    return percentile_interval(drawn_means(cut(units, "clusters"), group, samples, seed))


def holm(df: DataFrame, family: Sequence[str], p: str) -> DataFrame:
    """Holm-adjusted p values (`adjusted`) within each family, of any size; a null p has a null adjusted value.

    Equal p values of a family get one adjusted value, so they are counted first; the number of smaller ones
    and the running maximum are segmented scans over slices of p.
    """
    keys = list(family)
    counts = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    ranked = range_scan(cut(counts, "p-values"), keys, p, "_c", "_upto").join(sizes, keys)
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_upto") + F.col("_c")) * F.col(p))
    adjusted = range_scan(cut(ranked.withColumn("_step", step), "holm-steps"), keys, p, "_step", "adjusted", how="max")
    known = join_per_key(df, adjusted.select(*keys, p, "_c", "adjusted"), [*keys, p], "_c").drop("_c")
    return known.unionByName(df.filter(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def quality_profile(df: DataFrame, by: Sequence[str], value: str, passes: Column) -> DataFrame:
    """Attempted and valid counts, quartiles, range and strict passes over both denominators."""
    valid = F.col(value).isNotNull()
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count(value).alias("valid"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count_if(valid & passes).alias("passes"),
    )
    quartiles = exact_quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return base.join(quartiles, list(by), "left").select(
        *by, "attempted", "valid", "min", "q1", "median", "q3", "max", "passes",
        (F.col("passes") / F.col("attempted")).alias("full_share"),
        F.when(F.col("valid") > 0, F.col("passes") / F.col("valid")).alias("valid_share"),
    )


def observed_counts(df: DataFrame, name: str, counters: Mapping[str, Column]):
    """Counters taken beside a scan: returns the frame to consume and the observation to read after."""
    from pyspark.sql import Observation

    observation = Observation(name)
    return df.observe(observation, *[c.alias(n) for n, c in counters.items()]), observation
