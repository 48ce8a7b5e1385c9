"""Building blocks that stay distributed when one key holds a large share of all rows.

* `hashed_rank`    row numbers in the order of a uniform digest, with no global sort in one task
* `range_rank`, `range_lag`, `range_scan`  the same idea for numeric orders: numbers, predecessors, running folds
* `shuffled`       a table that a join must not broadcast, since it grows with the input
* `join_per_key`   join of rows with one row per key, hot keys broadcast, the rest shuffled
* `digest_tree`, `member_digest`  one digest per group over its members, by a radix tree of bounded nodes
* `exact_quantiles` exact interpolated percentiles without holding a group in one buffer
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# A key with more rows than this is joined by broadcast. At most rows / HOT_ROWS keys can be that
# frequent, which bounds the broadcast: 10^12 rows allow 500,000 of them.
HOT_ROWS = 2_000_000


def hashed_rank(
    df: DataFrame,
    digest: str,
    ties: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    name: str = "rank",
    digits: int = 4,
) -> DataFrame:
    """Add the 1-based position of each row in (`digest`, *`ties`) order per partition.

    `digest` is lower-case hex of a uniform hash, so its first `digits` digits cut every partition
    in evenly filled, ordered slices. Rows are numbered inside a slice; slice sizes (at most
    16**digits per partition) give the offsets. No task sees more than one slice at a time.
    """
    part = list(partition_by)
    sliced = df.withColumn("_slice", F.substring(F.col(digest), 1, digits))
    sizes = sliced.groupBy(*part, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = (
        Window.partitionBy(*(part or [F.lit(0)]))
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *part, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    if not part:
        offsets = F.broadcast(offsets)  # at most 16**digits rows
    inside = Window.partitionBy(*part, "_slice").orderBy(digest, *ties)
    return (
        sliced.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*part, "_slice"])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_slice", "_local", "_offset")
    )


def _range_slices(df: DataFrame, order: str, slices: int) -> DataFrame:
    """Add `_slice`: value ranges of the numeric column `order` with about as many rows each, for all keys alike.

    The cuts are quantiles of a sketch that merges map-side, so outliers and hot keys leave the slices even;
    equal values share a slice. Null values come first.
    """
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = df.agg(F.percentile_approx(order, shares, 50 * slices).alias("_cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_slice", _passed_cuts(F.col(order), slices)).drop("_cuts")  # `cuts` is one row


def _passed_cuts(value: Column, slices: int) -> Column:
    """Number of the sorted `_cuts` at or below the value, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(slices.bit_length()))])
    passed = lambda at, step: F.get("_cuts", at + step - 1) <= value
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(passed(at, step), at + step).otherwise(at))


def range_rank(
    df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str] = (), name: str = "rank", slices: int = 1024
) -> DataFrame:
    """1-based position per key in (`order`, *`ties`) order for a numeric `order`.

    Like `hashed_rank`, with even slices of the values: a key of any size is numbered slice by slice.
    """
    by = list(by)
    sliced = _range_slices(df, order, slices)
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    if not by:
        offsets = F.broadcast(offsets)  # at most `slices` rows
    inside = Window.partitionBy(*by, "_slice").orderBy(order, *ties)
    return (
        sliced.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*by, "_slice"])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_slice", "_local", "_offset")
    )


def range_lag(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, slices: int = 256) -> DataFrame:
    """Value of the row before in the series of a key, `order` being numeric and unique per key.

    Rows look back inside their slice of the value range; the first row of a slice sees the last
    value of the slice before it.
    """
    by = list(by)
    sliced = _range_slices(df, order, slices)
    ends = sliced.groupBy(*by, "_slice").agg(F.max_by(value, order).alias("_last"))
    per_key = Window.partitionBy(*by).orderBy("_slice")  # at most `slices` rows per key
    carried = ends.select(*by, "_slice", F.lag("_last").over(per_key).alias("_carried"))
    inside = Window.partitionBy(*by, "_slice").orderBy(order)
    return (
        sliced.withColumn("_before", F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(carried, [*by, "_slice"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
        .drop("_slice", "_before", "_first", "_carried")
    )


def range_scan(
    df: DataFrame, by: Sequence[str], order: str, value: str, name: str, ties: Sequence[str] = (), how: str = "sum", slices: int = 1024
) -> DataFrame:
    """Running sum or maximum of `value` per key in (`order`, *`ties`) order, the row itself included.

    A segmented scan in two passes: every slice of the value range is folded to one number, the numbers of
    the slices before it are carried in, and rows are cumulated inside their slice only.
    """
    by = list(by)
    fold = {"sum": F.sum, "max": F.max}[how]
    sliced = _range_slices(df, order, slices)
    per_slice = sliced.groupBy(*by, "_slice").agg(fold(value).alias("_fold"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most `slices` rows
    carried = per_slice.select(*by, "_slice", fold("_fold").over(before).alias("_carried"))
    if not by:
        carried = F.broadcast(carried)  # at most `slices` rows
    inside = Window.partitionBy(*by, "_slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", fold(value).over(inside)).join(carried, [*by, "_slice"])
    # Both folds skip nulls: the first slice has nothing to carry.
    whole = F.greatest("_local", "_carried") if how == "max" else F.coalesce(F.col("_local") + F.col("_carried"), "_local", "_carried")
    return local.withColumn(name, whole).drop("_slice", "_local", "_carried")


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join that shuffles both sides and sorts them, which spills, whatever the planner thinks of its size.

    Meant for tables that grow with the input. A broadcast is built on the driver, and the planner goes by the bytes
    of the files: packed keys, and arrays that it takes for one value, are many times larger there.
    """
    return df.hint("merge")


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    count_col: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of `rows` with `per_key` (unique `keys`, `count_col` = rows per key).

    Rows of hot keys never travel to one task: they meet a broadcast of the few hot keys where they
    are. All other rows take an ordinary shuffled join.
    """
    keys = list(keys)
    hot = per_key.filter(F.col(count_col) > hot_rows)
    warm = per_key.filter(F.col(count_col) <= hot_rows)
    hot_part = rows.join(F.broadcast(hot), keys)
    warm_part = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(warm, keys)
    return warm_part.unionByName(hot_part)


def _tagged(tag: str, body: Column) -> Column:
    return F.sha2(F.concat(F.lit(tag).cast("binary"), F.unhex(F.lit("00")), body.cast("binary")), 256)


# Most entries that one node of a digest tree holds; inner nodes have at most sixteen.
FAN_IN = 256

# Trees of more groups than this are folded without a broadcast (about 100 bytes a group on the driver).
SHUFFLED_GROUPS = 100_000


def digest_tree(df: DataFrame, group: Sequence[str], digest: str, fan_in: int = FAN_IN) -> DataFrame:
    """Fold 64-digit hex digests to one per group: (*group, tree_sha256, n_members).

    The tree is a radix tree over the hex digits, and its depth follows the members: a prefix with at most
    `fan_in` distinct digests is a leaf, any other has one child per next digit. So no node holds more than
    `fan_in` entries at any number of members, and the result depends on the members alone. Equal digests
    count as one entry digest:count; input order and partitioning do not matter. Rows without a group key or
    without a digest are in no tree.

    Digests travel as 32 bytes, with their count only where it is not one, and become text at their leaf.
    """
    keys = list(group) or ["_g"]
    source = (df if group else df.withColumn("_g", F.lit(0))).dropna(subset=[*keys, digest])
    packed = source.select(*keys, F.unhex(digest).alias("_d"))
    unique = cut(packed.groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_n")), "digests")
    sizes = unique.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.sum("_n").alias("_total"))
    entry = F.when(F.col("_n") == 1, F.col("_d")).otherwise(F.concat("_d", F.col("_n").cast("string").cast("binary")))
    count = lambda e: F.when(F.octet_length(e) == 32, "1").otherwise(F.substring(e, 33, 20).cast("string"))
    text = lambda e: F.concat_ws(":", F.lower(F.hex(F.substring(e, 1, 32))), count(e))
    prefix = lambda digits: F.substring(F.lower(F.hex(F.substring("_d", 1, (digits + 1) // 2))), 1, digits)
    most, n_groups = sizes.agg(F.coalesce(F.max("_size"), F.lit(0)), F.count(F.lit(1))).first()
    met = shuffled if n_groups > SHUFFLED_GROUPS else lambda df: df
    joined = lambda kind, entries: F.sha2(F.concat(F.lit(kind + "\n"), F.array_join(F.array_sort(entries), "\n")), 256)
    leaf = joined("leaf", F.transform(F.collect_list("_e"), text))
    if most <= fan_in:
        roots = unique.withColumn("_e", entry).groupBy(*keys).agg(leaf.alias("tree_sha256"), F.sum("_n").alias("n_members"))
        return roots if group else roots.drop("_g")
    # Digits after which every prefix is a leaf: digests are uniform, so prefixes that hold five eighths of a leaf
    # on average nearly always fit. One digit too many would make the table of prefixes sixteen times as long.
    depth = max(1, math.ceil(math.log(1.6 * most / fan_in, 16)))
    while True:
        counts = cut(unique.groupBy(*keys, prefix(depth).alias("_p")).agg(F.count(F.lit(1)).alias("_c")), "prefixes")
        if counts.filter(F.col("_c") > fan_in).isEmpty():
            break
        depth += 1
    # A leaf is the shortest prefix with few members. Counts of shorter prefixes are sums over the longest ones,
    # at most 16**depth rows per group.
    length = F.lit(depth)
    for digits in reversed(range(depth)):
        short = counts.groupBy(*keys, F.substring("_p", 1, digits).alias("_q")).agg(F.sum("_c").alias(f"_c{digits}"))
        counts = counts.withColumn("_q", F.substring("_p", 1, digits)).join(met(short), [*keys, "_q"]).drop("_q")
        length = F.when(F.col(f"_c{digits}") <= fan_in, digits).otherwise(length)
    leaves = counts.select(*keys, "_p", length.alias("_l"))
    level = (
        unique.withColumn("_p", prefix(depth))
        .join(met(leaves), [*keys, "_p"])
        .select(*keys, F.expr("substring(_p, 1, _l)").alias("_p"), entry.alias("_e"))
        .groupBy(*keys, "_p")
        .agg(leaf.alias("_d"))
    )
    # A long prefix may be a leaf at any depth: nodes climb digit by digit, those already higher wait.
    for digits in reversed(range(depth)):
        below = F.length("_p") > digits
        folded = (
            level.filter(below)
            .select(*keys, F.substring("_p", 1, digits).alias("_q"), F.concat_ws(":", F.substring("_p", digits + 1, 1), "_d").alias("_e"))
            .groupBy(*keys, "_q")
            .agg(joined("node", F.collect_list("_e")).alias("_d"))
            .withColumnRenamed("_q", "_p")
        )
        level = level.filter(~below).unionByName(folded)
        if digits:
            level = cut(level, "tree-level")
    out = level.join(met(sizes), keys).select(*keys, F.col("_d").alias("tree_sha256"), F.col("_total").alias("n_members"))
    return out if group else out.drop("_g")


def member_digest(members: DataFrame, group: str, member: str, tag: str) -> DataFrame:
    """One row per group: `group`, `group_id`, `n_members`.

    `group_id` is the tagged digest of the digest tree over the members. The rule is the same for groups
    of any size; it depends on the set of members only, not on their order or partitioning.
    """
    hashed = members.select(group, F.sha2(F.col(member).cast("string"), 256).alias("_h"))
    return digest_tree(hashed, [group], "_h").select(group, _tagged(tag, F.col("tree_sha256")).alias("group_id"), "n_members")


# Most distinct values of a key that one window task orders, and cells per turn of narrowing.
WINDOW_VALUES = 10_000
CELLS = 512


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: dict[str, float], limit: int = WINDOW_VALUES, cells: int = CELLS
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, one column per entry of `probabilities`.

    Values are collapsed to (value, count) first. Keys of at most `limit` distinct values are cumulated in one
    window. For larger keys the bracket of every wanted rank is narrowed in turns, all keys at once: quantiles
    of a sketch cut the values of a bracket in cells, cells are counted exactly, and the cell that holds the
    rank is the next bracket, until it has at most `limit` distinct values. Cells only have to be even, never
    right, so no rank can be missed, and no task orders more than max(`limit`, `cells`) rows.
    """
    keys = list(group) or ["_g"]
    source = df if group else df.withColumn("_g", F.lit(0))
    data = source.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = cut(data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
    position = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in probabilities.items()}
    lower = {name: F.floor(p) for name, p in position.items()}
    upper = {name: F.least(F.floor(p) + 1, F.col("_n") - 1) for name, p in position.items()}

    def mixed(name: str, low: Column, up: Column) -> Column:
        return (low + (up - low) * (position[name] - lower[name])).alias(name)

    run = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    small = counts.join(sizes.filter(F.col("_d") <= limit), keys).withColumn("_cum", F.sum("_c").over(run))
    first = lambda rank: F.min(F.when(F.col("_cum") > rank, F.col("_v")))
    wide = small.groupBy(*keys, "_n").agg(*[f(n) for n in probabilities for f in (lambda n: first(lower[n]).alias(f"_l_{n}"), lambda n: first(upper[n]).alias(f"_u_{n}"))])
    out = wide.select(*keys, *[mixed(n, F.col(f"_l_{n}"), F.col(f"_u_{n}")) for n in probabilities])
    large = sizes.filter(F.col("_d") > limit)
    if not large.isEmpty():
        found = _values_at_ranks(counts, _rank_targets(large, keys, lower, upper), keys, limit, cells)
        at = lambda name, side: F.max(F.when((F.col("_i") == name) & (F.col("_side") == side), F.col("_v")))
        wide = found.groupBy(*keys).agg(*[f(n) for n in probabilities for f in (lambda n: at(n, 0).alias(f"_l_{n}"), lambda n: at(n, 1).alias(f"_u_{n}"))])
        wide = wide.join(large, keys)
        out = out.unionByName(wide.select(*keys, *[mixed(n, F.col(f"_l_{n}"), F.col(f"_u_{n}")) for n in probabilities]))
    return out if group else out.drop("_g")


def _rank_targets(sizes: DataFrame, keys: list[str], lower: dict[str, Column], upper: dict[str, Column]) -> DataFrame:
    """One row per key, percentile and side: the 0-based rank whose value is wanted, and its bracket so far."""
    entries = [
        F.struct(F.lit(name).alias("_i"), F.lit(side).alias("_side"), rank.cast("long").alias("_rank"))
        for name in lower
        for side, rank in enumerate((lower[name], upper[name]))
    ]
    bounds = {"_lo": F.lit(-math.inf), "_hi": F.lit(math.inf), "_below": F.lit(0).cast("long")}
    return sizes.select(*keys, "_d", F.explode(F.array(*entries)).alias("_t")).select(*keys, "_d", "_t.*").withColumns(bounds)


def _values_at_ranks(counts: DataFrame, targets: DataFrame, keys: list[str], limit: int, cells: int) -> DataFrame:
    """The value at every target's rank, by narrowing its bracket [_lo, _hi]; `_below` rows lie under `_lo`."""
    bracket = [*keys, "_lo", "_hi", "_below"]
    targets = cut(targets, "targets")
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    within = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    while True:
        open_ = targets.filter(F.col("_d") > limit)
        if open_.isEmpty():
            break
        # Few brackets per key: the planner broadcasts them, or the adaptive skew join splits a hot key.
        inside = counts.join(open_.select(*bracket).distinct(), keys).filter(within)
        cuts = inside.groupBy(*bracket).agg(F.percentile_approx("_v", shares, 10 * cells).alias("_cuts"))
        parts = (
            inside.join(cuts, bracket)
            .withColumn("_cell", _passed_cuts(F.col("_v"), cells))
            .groupBy(*bracket, "_cell")
            .agg(F.sum("_c").alias("_w"), F.count(F.lit(1)).alias("_cd"), F.min("_v").alias("_clo"), F.max("_v").alias("_chi"))
        )
        upto = Window.partitionBy(*bracket).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # at most `cells` rows
        parts = parts.withColumn("_upto", F.col("_below") + F.sum("_w").over(upto))
        holds = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_w"))
        narrowed = open_.join(parts, bracket).filter(holds).select(
            *keys, F.col("_cd").alias("_d"), "_i", "_side", "_rank", F.col("_clo").alias("_lo"), F.col("_chi").alias("_hi"), (F.col("_upto") - F.col("_w")).alias("_below")
        )
        targets = cut(targets.filter(F.col("_d") <= limit).unionByName(narrowed), "targets")
    inside = counts.join(targets.select(*bracket).distinct(), keys).filter(within)
    run = Window.partitionBy(*bracket).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # at most `limit` rows
    ranked = inside.withColumn("_upto", F.col("_below") + F.sum("_c").over(run))
    holds = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))
    return targets.join(ranked, bracket).filter(holds).select(*keys, "_i", "_side", "_v")
