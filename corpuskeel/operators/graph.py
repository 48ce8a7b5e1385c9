"""Dependence graphs: edges from shared keys, connected components, levels of a task graph."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut, drop_cut
from . import dedup
from .checks import ContractViolation, require_none
from .skew import HOT_ROWS, join_per_key, member_digest, range_rank, shuffled


def shared_keys(rows: DataFrame, node: str, kinds: Mapping[str, Column]) -> DataFrame:
    """Long table (id, kind, key) of all non-null keys. Each kind is a name space of its own."""
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()])
    return (
        rows.select(F.col(node).alias("id"), F.explode(entries).alias("_e"))
        .select("id", "_e.kind", "_e.key")
        .filter(F.col("key").isNotNull())
    )


def star_edges(keys: DataFrame) -> DataFrame:
    """Edge (src, dst, kind) from each holder of a key to the smallest holder."""
    holders = (
        keys.groupBy("kind", "key")
        .agg(F.min("id").alias("dst"), F.count(F.lit(1)).alias("n_holders"))
        .filter("n_holders > 1")
    )
    return (
        join_per_key(keys, shuffled(holders), ["kind", "key"], "n_holders")
        .filter(F.col("id") != F.col("dst"))
        .select(F.col("id").alias("src"), "dst", "kind")
    )


def edge_counts(keys: DataFrame, near_pairs: int | None = None) -> DataFrame:
    """Edges per kind, counted as sum of (holders - 1); near pairs are counted as pairs."""
    counts = (
        keys.groupBy("kind", "key")
        .agg((F.count(F.lit(1)) - 1).alias("n"))
        .groupBy("kind")
        .agg(F.sum("n").alias("n_edges"))
        .filter("n_edges > 0")
    )
    if near_pairs:
        extra = counts.sparkSession.range(1).select(
            F.lit("coarse_near_pixels").alias("kind"), F.lit(near_pairs).cast("long").alias("n_edges")
        )
        counts = counts.unionByName(extra)
    return counts


# From this many ends of edges on, no table of a contraction is broadcast (about 100 bytes an end on the driver).
SHUFFLED_ENDS = 100_000


def _is_star(edges: DataFrame, met: Callable[[DataFrame], DataFrame]) -> bool:
    """True when no target of an edge points on to another node."""
    return edges.join(met(edges.select(F.col("src").alias("dst"))), "dst", "left_semi").isEmpty()


def _with_minimum(edges: DataFrame, hot_rows: int, met: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (src, dst) with the least neighbour of `src` (itself included) as `low`.

    `hot_rows` = 0 says that the table is too small for any hub to be hot.
    """
    lows = edges.groupBy("src").agg(
        F.least(F.min("dst"), F.first("src")).alias("low"), F.count(F.lit(1)).alias("degree")
    )
    if not hot_rows:
        return edges.join(met(lows), "src")
    return join_per_key(edges, met(lows), ["src"], "degree", hot_rows)


def connected_components(
    nodes: DataFrame, edges: DataFrame, node: str = "id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(`node`, component) where component is the smallest node id of the component.

    Alternating star contraction: a round links every larger neighbour of a node to the least
    neighbour (large star), then every smaller neighbour and the node itself to the least one (small
    star). The edge table is written once per round, which bounds the lineage; nodes without edges
    never enter the loop. A hub that a third of the edges meet is joined by broadcast of the few hubs,
    so no task receives its whole neighbourhood.
    """
    spark = nodes.sparkSession
    current = cut(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct(), "edges")
    # Contraction never adds edges, so this count bounds the degree of every node in every round.
    ends = 2 * current.count()
    hot = hot_rows if ends > hot_rows else 0
    met = shuffled if ends > SHUFFLED_ENDS else lambda df: df
    while True:
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = (
            _with_minimum(both, hot, met)
            .filter((F.col("dst") > F.col("src")) & (F.col("dst") != F.col("low")))
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .distinct()
        )
        downward = _with_minimum(large, hot, met)
        small = downward.select(
            F.explode(
                F.array(
                    F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")),
                    F.struct(F.col("src").alias("src"), F.col("low").alias("dst")),
                )
            ).alias("e")
        ).select("e.src", "e.dst")
        following = cut(small.filter(F.col("src") != F.col("dst")).distinct(), "edges")
        drop_cut(spark, current)
        current = following
        if _is_star(current, met):
            break
    return nodes.select(node).join(met(current.select(F.col("src").alias(node), "dst")), node, "left").select(
        node, F.coalesce("dst", node).alias("component")
    )


def leakage_keys(rows: DataFrame, producers: bool = True) -> DataFrame:
    """Keys of the leakage frame. Rejected rows keep their raw bytes and metadata keys only.

    With `producers`, rows of an unknown producer share one quarantine cohort.
    """
    kinds = {
        "raw": F.col("raw_sha256"),
        "canonical": F.when(F.col("status") == K.STATUS_PASS, F.col("canonical_pixel_sha256")),
        "prompt_group": F.col("prompt_group"),
        "prompt_seed_group": F.col("prompt_seed_group"),
    }
    if producers:
        kinds["producer_group"] = F.col("producer_group")
        kinds["unknown_producer_quarantine"] = F.when(
            F.col("producer_status") == K.STATUS_UNKNOWN_PRODUCER, F.lit(K.UNKNOWN_COHORT_KEY)
        )
    return shared_keys(rows, "id", kinds)


def group_frame(
    rows: DataFrame, keys: DataFrame, near: DataFrame | None = None, tag: str = K.TAG_LEAKAGE_GROUP
) -> DataFrame:
    """(id, group_id, n_members) over key edges and near pairs."""
    edges = star_edges(keys).select("src", "dst")
    if near is not None:
        edges = edges.unionByName(near.select(F.col("right_id").alias("src"), F.col("left_id").alias("dst")))
    return named_groups(cut(connected_components(rows, edges), "components"), tag)


def named_groups(members: DataFrame, tag: str = K.TAG_LEAKAGE_GROUP) -> DataFrame:
    """(id, group_id, n_members) of the components in `members` (id, component)."""
    named = member_digest(members, "component", "id", tag)
    return join_per_key(members, shuffled(named), ["component"], "n_members").select("id", "group_id", "n_members")


def near_classes(rows: DataFrame) -> DataFrame:
    """Rows that may be near to others, folded where all that the near rule reads is equal.

    `rows`: id, status, fp, width, height, tone, shade (a digest of the colour values). Only passing rows
    with a fingerprint take part. A class is named by its smallest id; its rows are near to each other.
    """
    able = rows.filter((F.col("status") == K.STATUS_PASS) & F.col("fp").isNotNull())
    return dedup.fingerprint_classes(able, "fp", ("width", "height", "tone", "shade"))


def near_links(classes: DataFrame, colours: DataFrame, apart: str | None = None, choices=None, blocks: int | None = None) -> DataFrame:
    """All pairs of classes under the whole near rule: fingerprint, aspect, colour.

    The sums of the colours are compared at the probe; the 192 values only travel to pairs that are left.
    """
    pairs = dedup.near_class_pairs(classes, condition=dedup.near_aspect() & dedup.near_tone(), apart=apart, choices=choices, blocks=blocks, bands=dedup.near_bands())
    return dedup.close_in_colour(pairs, colours)


def near_pair_count(classes: DataFrame, links: DataFrame) -> int:
    """Near pairs of rows: those between classes and those inside a class."""
    between = links.agg(F.sum(F.col("n_left") * F.col("n_right"))).first()[0]
    inside = classes.agg(F.sum(F.expr("n_rows * (n_rows - 1) div 2"))).first()[0]
    return (between or 0) + (inside or 0)


def leakage_frame(rows: DataFrame, colours: DataFrame, rounds: int = 1, tag: str = K.TAG_LEAKAGE_GROUP) -> DataFrame:
    """(id, group_id, n_members) of the whole leakage frame: all keys, producers, quarantine and near pairs.

    Key edges and equal classes come first. The near join then takes the choices of blocks in `rounds`
    turns (each costs a probe, a contraction and the crowded buckets again, so one is fastest) and knows of every class the component it is in: classes that are linked already are not compared
    again, and after every turn the components are contracted over the links found. Only links between
    different components are ever written.
    """
    able = (F.col("status") == K.STATUS_PASS) & F.col("fp").isNotNull()
    keys = leakage_keys(rows).unionByName(
        rows.filter(able).select("id", F.lit("class").alias("kind"), F.concat_ws(":", "fp", "width", "height", "tone", "shade").alias("key"))
    )
    members = cut(connected_components(rows, star_edges(keys)), "key-components")
    classes = near_classes(rows).join(shuffled(members.withColumnRenamed("component", "origin")), "id")
    classes = cut(classes, "near-classes")
    blocks = dedup.default_blocks(classes.count())
    labels = classes.select("origin").distinct()
    links, merged = None, labels.withColumn("component", F.col("origin"))
    for choices in dedup.block_choices(blocks, K.NEAR_HAMMING, rounds):
        # One row per origin; a component that holds most classes is split by the adaptive skew join.
        current = classes.join(shuffled(merged), "origin")
        found = near_links(current, colours, apart="component", choices=choices, blocks=blocks)
        origin = classes.select(F.col("id").alias("left_id"), F.col("origin").alias("dst"))
        other = classes.select(F.col("id").alias("right_id"), F.col("origin").alias("src"))
        found = cut(found.join(shuffled(origin), "left_id").join(shuffled(other), "right_id").select("src", "dst").distinct(), "near-links")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        merged = cut(connected_components(labels, links, node="origin"), "near-components")
    total = members.join(shuffled(merged.select(F.col("origin").alias("component"), F.col("component").alias("_c"))), "component", "left")
    # An origin is the least id of its rows, so the least origin is the least id of the merged component.
    whole = cut(total.select("id", F.coalesce("_c", "component").alias("component")), "components")
    return named_groups(whole, tag)


def restrict_groups(groups: DataFrame, selected: DataFrame, reserved: DataFrame) -> DataFrame:
    """Selected members of the components; excluded rows have done their work as bridges by now."""
    require_none(reserved.select("id").join(selected, "id", "left_anti"), "reserved row outside the selection")
    require_none(selected.select("id").join(groups, "id", "left_anti"), "selected row outside the components")
    return (
        groups.join(selected.select("id"), "id", "left_semi")
        .join(reserved.select("id").distinct().withColumn("is_reserved", F.lit(True)), "id", "left")
        .withColumn("is_reserved", F.coalesce("is_reserved", F.lit(False)))
    )


def holdout_closure(groups: DataFrame, holdout: DataFrame) -> DataFrame:
    """Every row of a component that holds at least one holdout row."""
    touched = groups.join(holdout.select("id"), "id", "left_semi").select("group_id").distinct()
    return groups.join(touched, "group_id", "left_semi").select("id", "group_id")


def _follow_chains(single: DataFrame, n: int) -> DataFrame:
    """Pointer doubling over tasks with one open parent: (id, parent, w, low) with `parent` outside `single`.

    A row says level(id) = max(low, level(parent) + w); two such rows compose to one, so every round doubles
    the length of what is known. A chain that never leaves `single` is a cycle.
    """
    for _ in range(n.bit_length() + 1):
        above = single.select(F.col("id").alias("parent"), F.col("parent").alias("_p"), F.col("w").alias("_w"), F.col("low").alias("_low"))
        following = cut(
            single.join(above, "parent", "left").select(
                "id",
                F.coalesce("_p", "parent").alias("parent"),
                (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
                F.greatest("low", F.col("_low") + F.col("w")).alias("low"),
                F.col("_p").isNotNull().alias("_moved"),
            ),
            "chains",
        )
        if following.filter("_moved").isEmpty():
            return following.drop("_moved")
        single = following.drop("_moved")
    raise ContractViolation("task graph contains a cycle")


def task_levels(tasks: DataFrame, edges: DataFrame, preferred: str) -> DataFrame:
    """(id, preferred, level, position): a task's level is the length of the longest way that leads to it.

    `edges` hold (id, parent). A round places tasks without open parents and folds them in their children;
    tasks with a single open parent are then taken out by pointer doubling, and what hung on them hangs on
    the end of their chain. So a chain of n tasks takes about log n steps, not n. They get their levels when
    all others have theirs. A round that changes nothing is a cycle. `position` is the place in the level by
    (preferred, id), numbered by slices.
    """
    zero = F.lit(0).cast("long")
    open_edges = cut(edges.select("id", "parent", F.lit(1).cast("long").alias("w")).distinct(), "task-edges")
    require_none(open_edges.join(tasks.select(F.col("id").alias("parent")), "parent", "left_anti"), "unknown parent task")
    waiting = cut(tasks.select("id", zero.alias("low")), "waiting")  # low: a level that the task reaches in any case
    placed, taken_out = [], []
    while True:
        ready = cut(waiting.join(open_edges, "id", "left_anti").select("id", F.col("low").alias("level")), "ready")
        placed.append(ready)
        waiting = waiting.join(ready, "id", "left_anti")
        met = open_edges.join(ready.select(F.col("id").alias("parent"), "level"), "parent", "left")
        met = cut(met, "met-edges")
        reached = met.filter("level IS NOT NULL").groupBy("id").agg(F.max(F.col("level") + F.col("w")).alias("_low"))
        waiting = cut(waiting.join(reached, "id", "left").select("id", F.greatest("low", "_low").alias("low")), "waiting")
        open_edges = cut(met.filter("level IS NULL").groupBy("id", "parent").agg(F.max("w").alias("w")), "task-edges")
        if open_edges.isEmpty():
            placed.append(waiting.select("id", F.col("low").alias("level")))
            break
        lone = open_edges.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.first("parent").alias("parent"), F.first("w").alias("w")).filter("_n = 1")
        single = cut(lone.join(waiting, "id").select("id", "parent", "w", "low"), "single-parents")
        n = single.count()
        if not n and ready.isEmpty():
            raise ContractViolation("task graph contains a cycle")
        if not n:
            continue
        chains = _follow_chains(single, n)
        taken_out.append(chains)
        rest = open_edges.join(chains.select("id"), "id", "left_anti")
        above = chains.select(F.col("id").alias("parent"), F.col("parent").alias("_p"), F.col("w").alias("_w"), F.col("low").alias("_low"))
        moved = cut(rest.join(above, "parent", "left"), "moved-edges")
        reached = moved.filter("_p IS NOT NULL").groupBy("id").agg(F.max(F.col("_low") + F.col("w")).alias("_l"))
        waiting = waiting.join(chains.select("id"), "id", "left_anti").join(reached, "id", "left")
        waiting = cut(waiting.select("id", F.greatest("low", "_l").alias("low")), "waiting")
        hung = moved.select("id", F.coalesce("_p", "parent").alias("parent"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))
        open_edges = cut(hung.groupBy("id", "parent").agg(F.max("w").alias("w")), "task-edges")
    levels = placed[0]
    for part in placed[1:]:
        levels = levels.unionByName(part)
    for chains in reversed(taken_out):
        ends = levels.select(F.col("id").alias("parent"), "level")
        levels = cut(levels.unionByName(chains.join(ends, "parent").select("id", F.greatest("low", F.col("level") + F.col("w")).alias("level"))), "levels")
    whole = cut(tasks.select("id", preferred).join(levels, "id"), "task-levels")
    return range_rank(whole, ["level"], preferred, ["id"], "position")


def task_order(levels: DataFrame) -> DataFrame:
    return levels.orderBy("level", "position")


def contract_graph(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between coarse nodes: both ends mapped, self-edges dropped, each edge once."""
    child = mapping.select("id", F.col("coarse").alias("coarse_id"))
    parent = mapping.select(F.col("id").alias("parent"), F.col("coarse").alias("coarse_parent"))
    return (
        edges.join(child, "id")
        .join(parent, "parent")
        .filter(F.col("coarse_id") != F.col("coarse_parent"))
        .select(F.col("coarse_id").alias("id"), F.col("coarse_parent").alias("parent"))
        .distinct()
    )
