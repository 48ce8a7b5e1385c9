"""Detector scores: joint decisions, threshold calibration on a grid, bounds, ROC.

The score table is long: (domain, uid, condition, q, s, i), one row per candidate; a vetoed score is
null. An observation that failed or never arrived has no rows and no entry in the observed roster;
an observed one without candidates is a valid non-match.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.bounds import exact_one_sided
from .checks import require_none


def score_violations(scores: DataFrame) -> DataFrame:
    def bad(c: str) -> Column:
        return F.col(c).isNotNull() & (F.isnan(c) | ~F.col(c).between(-1.0, 1.0))

    return scores.filter(bad("s") | bad("i")).select("uid", "condition", "q", "s", "i")


def joint_decision(scores: DataFrame, by: Sequence[str], tau_s: float, tau_i: float, ordinal: str = "q") -> DataFrame:
    """Strict decision on a common q: the best instance per q is met with the semantic score of q.

    Null (vetoed) scores cannot hit. `cross_q_only`: both components hit, but never on one q.
    """
    by = list(by)
    per_q = scores.groupBy(*by, ordinal).agg(F.max("s").alias("s"), F.max("i").alias("i"))
    s_hit = F.coalesce(F.col("s") > tau_s, F.lit(False))
    i_hit = F.coalesce(F.col("i") > tau_i, F.lit(False))
    joined = per_q.withColumn("_s", s_hit).withColumn("_i", i_hit).withColumn("_j", s_hit & i_hit)
    return joined.groupBy(*by).agg(
        F.bool_or("_s").alias("semantic_hit"),
        F.bool_or("_i").alias("instance_hit"),
        F.bool_or("_j").alias("both_match"),
        F.min(F.when(F.col("_j"), F.col(ordinal))).alias("first_joint_q"),
    ).withColumn("cross_q_only", F.col("semantic_hit") & F.col("instance_hit") & ~F.col("both_match"))


def thresholds_below(score: Column) -> Column:
    """How many grid thresholds (j - 50) / 50, j = 0..100, lie strictly below `score`.

    Starts from the rounded index and is settled against the thresholds themselves, in doubles.
    """
    guess = F.greatest(F.lit(0), F.least(F.lit(K.GRID_POINTS), F.floor(score * K.GRID_CENTRE + K.GRID_CENTRE).cast("int")))
    value = lambda j: (j - K.GRID_CENTRE).cast("double") / F.lit(float(K.GRID_CENTRE))
    count = guess - 1
    for step in (-1, 0, 1):
        j = guess + step
        count = F.when((j >= 0) & (j < K.GRID_POINTS) & (value(j) < score), j + 1).otherwise(count)
    return F.greatest(count, F.lit(0))


def grid_counts(roster: DataFrame, observed: DataFrame, scores: DataFrame) -> DataFrame:
    """Matches per (domain, condition, semantic index, instance index) on the whole grid.

    Each observation covers a staircase of the grid. The staircase is cut in rectangles, a rectangle
    becomes four corner entries, and entries are summed before anything is shuffled far: the shuffle
    carries at most cells x 102 x 102 rows, whatever the number of observations. Two running sums
    rebuild the counts.

    `roster` (domain, uid) is planned; `observed` (uid, condition) lists the observations that have a
    result, with or without candidates. A missing observation counts as a match in a negative
    condition and as a miss in the positive one.
    """
    conditions = [K.POSITIVE_CONDITION, *K.NEGATIVE_CONDITIONS]
    planned = roster.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    absent = (
        planned.join(observed.select("uid", "condition"), ["uid", "condition"], "left_anti")
        .groupBy("domain", "condition")
        .agg(F.count(F.lit(1)).alias("n_missing"))
    )
    reached = (
        scores.filter(F.col("s").isNotNull() & F.col("i").isNotNull())
        .groupBy("domain", "uid", "condition", "q")
        .agg(F.max("s").alias("s"), F.max("i").alias("i"))
        .withColumn("high", thresholds_below(F.col("s")))
        .withColumn("wide", thresholds_below(F.col("i")))
        .filter("high > 0 and wide > 0")
        # At most one row per grid line and observation from here on.
        .groupBy("domain", "uid", "condition", "high")
        .agg(F.max("wide").alias("wide"))
    )
    falling = Window.partitionBy("domain", "uid", "condition").orderBy(F.desc("high"))
    stairs = reached.withColumn(
        "wide", F.max("wide").over(falling.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("low", F.coalesce(F.lead("high").over(falling), F.lit(0)))
    corner = lambda a, b, n: F.struct(a.alias("js"), b.alias("ji"), F.lit(n).alias("n"))
    zero = F.lit(0)
    corners = stairs.select(
        "domain",
        "condition",
        F.explode(
            F.array(
                corner(F.col("low"), zero, 1),
                corner(F.col("high"), zero, -1),
                corner(F.col("low"), F.col("wide"), -1),
                corner(F.col("high"), F.col("wide"), 1),
            )
        ).alias("c"),
    ).select("domain", "condition", "c.*")
    deltas = corners.groupBy("domain", "condition", "js", "ji").agg(F.sum("n").alias("n"))
    axis = F.sequence(F.lit(0), F.lit(K.GRID_POINTS - 1))
    cells = (
        roster.select("domain").distinct()
        .withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
        .withColumn("js", F.explode(axis))
        .withColumn("ji", F.explode(axis))
    )
    along = Window.partitionBy("domain", "condition", "js").orderBy("ji").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("domain", "condition", "ji").orderBy("js").rowsBetween(Window.unboundedPreceding, 0)
    filled = cells.join(deltas, ["domain", "condition", "js", "ji"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    summed = filled.withColumn("n", F.sum("n").over(along)).withColumn("n", F.sum("n").over(across))
    adverse = F.when(F.col("condition") != K.POSITIVE_CONDITION, F.coalesce("n_missing", F.lit(0))).otherwise(F.lit(0))
    return summed.join(absent, ["domain", "condition"], "left").select(
        "domain", "condition", "js", "ji", (F.col("n") + adverse).alias("n_matches")
    )


def planned_counts(roster: DataFrame) -> DataFrame:
    return roster.groupBy("domain").agg(F.count(F.lit(1)).alias("planned"))


def best_thresholds(counts: DataFrame, planned: DataFrame) -> DataFrame:
    """Admissible threshold pair with the largest macro rate, then larger indices; empty if none.

    Admissible: 100 * matches <= planned in every negative cell. Rates are compared exactly: a pair's
    sum over the domains is an integer of any length over the least common multiple of the planned
    counts, written with leading zeros. Only the 10,201 pairs, one entry per domain each, meet that step.
    """
    sizes = [int(r["planned"]) for r in planned.collect()]  # one row per domain
    common = math.lcm(*sizes) if sizes else 1
    whole = common * max(len(sizes), 1)
    digits = len(str(whole))

    @F.pandas_udf("string")
    def total(terms: pd.Series) -> pd.Series:
        return pd.Series([str(sum(int(t["n"]) * (common // int(t["planned"])) for t in x)).zfill(digits) for x in terms], dtype=object)

    @F.pandas_udf("double")
    def rate(keys: pd.Series) -> pd.Series:
        return pd.Series([int(k) / whole for k in keys], dtype="float64")

    joined = counts.join(planned, "domain")
    positive = F.col("condition") == K.POSITIVE_CONDITION
    excess = ~positive & (100 * F.col("n_matches") > F.col("planned"))
    pairs = (
        joined.groupBy("js", "ji")
        .agg(
            F.collect_list(F.when(positive, F.struct(F.col("n_matches").alias("n"), "planned"))).alias("_terms"),
            F.bool_or(excess).alias("_excess"),
        )
        .filter(~F.col("_excess"))
        .select("js", "ji", total("_terms").alias("_key"))
    )
    best = pairs.agg(F.max(F.struct("_key", "js", "ji")).alias("_b")).filter(F.col("_b").isNotNull())
    grid = lambda c: (F.col(c) - K.GRID_CENTRE) / F.lit(float(K.GRID_CENTRE))
    return best.select("_b.js", "_b.ji", rate("_b._key").alias("macro_rate")).select(
        F.col("js").cast("long").alias("js"), F.col("ji").cast("long").alias("ji"), grid("js").alias("tau_s"), grid("ji").alias("tau_i"), "macro_rate"
    )


def joint_objective(cells: DataFrame) -> DataFrame:
    """Bounds per cell of (domain, condition, n_matches, planned) and whether each cell holds."""
    positive = F.col("condition") == K.POSITIVE_CONDITION
    bounded = cells.withColumn(
        "bound",
        F.when(positive, exact_one_sided("n_matches", "planned", lower=True)).otherwise(
            exact_one_sided("n_matches", "planned", lower=False)
        ),
    )
    return bounded.withColumn(
        "holds",
        F.when(positive, F.col("bound") >= K.POSITIVE_FLOOR).otherwise(F.col("bound") <= K.NEGATIVE_CEILING),
    )


def objective_met(cells: DataFrame, domains: DataFrame) -> DataFrame:
    """Conjunction over all domain x condition cells; an absent cell is an error, not a pass."""
    conditions = F.array(*[F.lit(c) for c in (K.POSITIVE_CONDITION, *K.NEGATIVE_CONDITIONS)])
    wanted = domains.select("domain").distinct().withColumn("condition", F.explode(conditions))
    require_none(wanted.join(cells, ["domain", "condition"], "left_anti"), "objective cell missing")
    return cells.agg(F.bool_and("holds").alias("met"), F.count(F.lit(1)).alias("n_cells"))


def joint_margin(scores: DataFrame, by: Sequence[str], tau_s: float, tau_i: float) -> DataFrame:
    """max over q of min(s - tau_s, best i - tau_i); the sentinel if every q is vetoed."""
    per_q = scores.groupBy(*by, "q").agg(F.max("s").alias("s"), F.max("i").alias("i"))
    margin = F.when(
        F.col("s").isNotNull() & F.col("i").isNotNull(), F.least(F.col("s") - tau_s, F.col("i") - tau_i)
    )
    return per_q.groupBy(*by).agg(F.max(margin).alias("_m")).select(
        *by,
        F.coalesce("_m", F.lit(K.VETO_MARGIN)).alias("margin"),
        F.col("_m").isNull().alias("all_vetoed"),
    )


def _sortable_hex(value: Column, digits: int = 9) -> Column:
    """Hex string that sorts like `value` for values in [-4, 4] (a prefix; ties keep the value)."""
    return F.lpad(F.hex(F.floor((value + 4.0) / 8.0 * (16**digits - 1)).cast("long")), digits, "0")


def auc_by_ranks(margins: DataFrame, positive: Column) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at average ranks.

    Equal margins are folded to one row first. Ranks come from a running count over margins; the
    margins are cut in value slices so that no task orders all of them.
    """
    values = margins.groupBy("margin").agg(
        F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg")
    )
    sliced = values.withColumn("_slice", F.substring(_sortable_hex(F.col("margin")), 1, 4))
    totals = sliced.groupBy("_slice").agg(F.sum("n_neg").alias("_neg"))
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_below"))  # <= 65,536 rows
    inside = Window.partitionBy("_slice").orderBy("margin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sliced.withColumn("_local", F.coalesce(F.sum("n_neg").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_slice")
        .withColumn("_wins", F.col("n_pos") * (F.col("_below") + F.col("_local") + F.col("n_neg") * 0.5))
    )
    return ranked.agg(
        F.sum("n_pos").alias("n_positive"), F.sum("n_neg").alias("n_negative"), F.sum("_wins").alias("_w")
    ).select(
        "n_positive",
        "n_negative",
        F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), F.col("_w") / F.col("n_positive") / F.col("n_negative")).alias("auc"),
    )


def centred_cosine(blocks: DataFrame, by: Sequence[str], frequency: str, value: str, sign: str) -> DataFrame:
    """Centred cosine of coefficients with a ±1 template per key; flat inputs are vetoed.

    Both are centred per frequency. Only sums are needed, so this is one mergeable aggregate per
    (key, frequency) and a second one per key.
    """
    x, t = F.col(value), F.col(sign).cast("double")
    sums = blocks.groupBy(*by, frequency).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(t).alias("st"),
        F.sum(x * t).alias("sxt"),
        F.sum(x * x).alias("sxx"),
        F.sum(t * t).alias("stt"),
    )
    cross = F.sum(F.col("sxt") - F.col("sx") * F.col("st") / F.col("n"))
    ox = F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    ot = F.sum(F.col("stt") - F.col("st") * F.col("st") / F.col("n"))
    folded = sums.groupBy(*by).agg(cross.alias("_c"), F.greatest(ox, F.lit(0.0)).alias("_x"), F.greatest(ot, F.lit(0.0)).alias("_t"))
    veto = (F.sqrt("_x") <= 1e-9) | (F.sqrt("_t") <= 1e-9)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c") / F.sqrt(F.col("_x") * F.col("_t"))))
    return folded.select(*by, F.when(veto, F.lit(0.0)).otherwise(score).alias("score"), veto.alias("zero_variance"))


def scored_candidates(candidates: DataFrame, score, columns: Sequence[str]) -> DataFrame:
    """Apply a pandas UDF returning struct(score, veto) and refuse scores outside [-1, 1]."""
    scored = candidates.withColumn("_r", score(*columns))
    value = F.col("_r.score")
    sound = value.isNotNull() & ~F.isnan(value) & value.between(-1.0, 1.0) & F.col("_r.veto").isNotNull()
    checked = F.when(sound, value).otherwise(F.raise_error(F.lit("score callback out of range")).cast("double"))
    return scored.withColumn("score", checked).withColumn("veto", F.col("_r.veto")).drop("_r")
