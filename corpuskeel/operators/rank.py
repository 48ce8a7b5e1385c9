"""Orders and selections by domain-separated digests; the input order never matters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keys import as_bytes, text_digest, uid_hash
from ..session import cut, drop_cut
from .checks import ContractViolation, duplicate_keys, require_none
from .skew import hashed_rank, join_per_key, range_scan

# Up to this many rows per key a row_number filter is pushed below the shuffle by the optimizer.
GROUP_LIMIT = 1_000


def top_by_digest(df: DataFrame, digest: str, ties: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """First `n` rows per key in digest order with their 1-based `position`."""
    if by and n <= GROUP_LIMIT:
        window = Window.partitionBy(*by).orderBy(digest, *ties)
        ranked = df.withColumn("position", F.row_number().over(window).cast("long"))
    else:
        ranked = hashed_rank(df, digest, ties, by, "position")
    return ranked.filter(F.col("position") <= n)


def ranked_partitions(df: DataFrame, part: str, digest: Column, limit: int | None = None) -> DataFrame:
    """Distinct partition keys in digest order (part_rank from 1); optionally only the first `limit`."""
    parts = df.select(part).distinct().withColumn("rank_sha256", digest)
    ranked = hashed_rank(parts, "rank_sha256", [part], (), "part_rank")
    return ranked if limit is None else ranked.filter(F.col("part_rank") <= limit)


def candidate_order(eligible: DataFrame, group: str, group_digest: Column, member: str, member_digest: Column) -> DataFrame:
    """Groups by their rank, members by theirs inside the group: group_rank and member_position.

    Rows without a group are not ordered and take no rank.
    """
    ranked = eligible.filter(F.col(group).isNotNull()).withColumn("group_sha256", group_digest).withColumn("member_sha256", member_digest)
    groups = hashed_rank(
        ranked.groupBy(group).agg(F.first("group_sha256").alias("group_sha256"), F.count(F.lit(1)).alias("n_members")),
        "group_sha256",
        [group],
        (),
        "group_rank",
    )
    placed = hashed_rank(ranked.drop("group_sha256"), "member_sha256", [member], [group], "member_position")
    return join_per_key(placed, groups, [group], "n_members")


def candidates_and_reserves(df: DataFrame, digest: str, key: str, target: int) -> DataFrame:
    """Role and index of every row: the first `target` are candidates, the rest ordered reserves."""
    ranked = hashed_rank(df, digest, [key], (), "position")
    if df.count() < target:
        raise ContractViolation("too few eligible candidates; the target does not shrink")
    return ranked.select(
        key,
        digest,
        "position",
        F.when(F.col("position") <= target, "candidate").otherwise("reserve").alias("role"),
        F.when(F.col("position") > target, F.col("position") - target - 1).alias("reserve_index"),
    )


def admit_first_passing(ordered: DataFrame, digest: str, key: str, passes: Column, target: int) -> DataFrame:
    """Verdict per row: accepted, replacement, excluded or spare.

    The first `target` passing rows in order are taken. A row that stood among the first `target`
    before is `accepted`; a taken reserve is a `replacement` with its reserve index.
    """
    ranked = hashed_rank(ordered.withColumn("_pass", passes), digest, [key], (), "position")
    passing = hashed_rank(ranked.filter("_pass").select(key, digest), digest, [key], (), "_taken").select(key, "_taken")
    if passing.filter(F.col("_taken") == target).isEmpty():
        raise ContractViolation("too few passing candidates; the target does not shrink")
    return ranked.join(passing, key, "left").select(
        key,
        "position",
        F.when(~F.col("_pass"), "excluded")
        .when((F.col("_taken") <= target) & (F.col("position") <= target), "accepted")
        .when(F.col("_taken") <= target, "replacement")
        .otherwise("spare")
        .alias("verdict"),
        F.when((F.col("_taken") <= target) & (F.col("position") > target), F.col("position") - target - 1).alias(
            "reserve_index"
        ),
    )


def reserve_per_domain(
    rows: DataFrame, uid: str, domain: str, group: str, quotas: Mapping[str, int], tag: str = K.TAG_RESERVATION
) -> DataFrame:
    """First rows of `quota` distinct groups per domain; a group taken by an earlier domain is gone.

    Domains are visited in name order. Each visit is one aggregate (best row per group) and one
    limited sort; only the picks, at most the sum of the quotas, are carried on.
    """
    ranked = rows.withColumn("rank_sha256", text_digest(tag, uid))
    taken = None
    for name, quota in sorted(quotas.items()):
        pool = ranked.filter(F.col(domain) == name)
        if taken is not None:
            pool = pool.join(F.broadcast(taken.select(group)), group, "left_anti")
        best = pool.groupBy(group).agg(F.min(F.struct("rank_sha256", F.col(uid).alias("uid"))).alias("_b"))
        picks = cut(
            best.orderBy("_b.rank_sha256", "_b.uid").limit(quota).select(F.lit(name).alias(domain), group, "_b.*"),
            "reservation",
        )
        if picks.count() != quota:
            raise ContractViolation(f"too few distinct groups in {name}")
        taken = picks if taken is None else taken.unionByName(picks)
    return taken


def representatives(rows: DataFrame, group: str, domain: str, member: str, tag: str = K.TAG_REPRESENTATIVE) -> DataFrame:
    """The member with the least digest per (group, domain); rows without a group have no digest, there the id decides."""
    digest = text_digest(tag, F.concat(F.col(group), F.lit(":"), F.col(member)))
    order = F.struct(digest.isNull(), digest.alias("rank_sha256"), F.col(member).isNull(), F.col(member).alias("representative"))
    return rows.groupBy(group, domain).agg(F.min(order).alias("_r")).select(group, domain, "_r.representative", "_r.rank_sha256")


def stratified_cohort(members: DataFrame, group: str, domain: str, uid: str, per_domain: int) -> DataFrame:
    """First `per_domain` groups per domain, each by its least uid."""
    require_none(duplicate_keys(members, [uid]), "uid occurs in several groups")
    groups = members.groupBy(domain, group).agg(F.min(as_bytes(uid)).alias("_raw"))
    ranked = groups.select(
        domain, group, F.col("_raw").cast("string").alias("representative_uid")
    ).withColumn("priority_sha256", uid_hash(K.TAG_COHORT, "representative_uid"))
    return top_by_digest(ranked, "priority_sha256", ["representative_uid"], per_domain, [domain])


def cohort_shortfall(cohort: DataFrame, domains: DataFrame, domain: str, per_domain: int) -> DataFrame:
    """Missing groups per domain, empty domains included."""
    counts = cohort.groupBy(domain).agg(F.count(F.lit(1)).alias("n_selected"))
    return domains.select(domain).distinct().join(counts, domain, "left").select(
        domain,
        F.coalesce("n_selected", F.lit(0)).alias("n_selected"),
        F.greatest(F.lit(0).cast("long"), F.lit(per_domain) - F.coalesce("n_selected", F.lit(0))).alias("shortfall"),
    )


def shortest_prefix(parts: DataFrame, rows: DataFrame, part: str, group: str, target: int, rows_per_part: int | None = None) -> DataFrame:
    """Ranked parts with new and cumulated groups, and which belong to the shortest sufficient prefix.

    `parts` (part, part_rank) are the candidates; `rows` are all their rows, with a null group where a row
    does not qualify. Every candidate is counted, used or not.
    Status: ready, blocked_missing, blocked_incomplete or blocked_insufficient.
    """
    listed = parts.select(part, "part_rank")
    candidates = rows.join(listed, part)
    firsts = candidates.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min("part_rank").alias("part_rank"))
    fresh = firsts.groupBy("part_rank").agg(F.count(F.lit(1)).alias("new_groups"))
    seen = candidates.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"))
    counted = cut(listed.join(fresh, "part_rank", "left").join(seen, part, "left").na.fill(0, ["new_groups", "n_rows"]), "parts")
    table = cut(range_scan(counted, [], "part_rank", "new_groups", "total_groups"), "prefix")
    partial = F.lit(False) if rows_per_part is None else F.max(F.col("n_rows") != rows_per_part)
    verdict = table.agg(  # one row
        F.min(F.when(F.col("total_groups") >= target, F.col("part_rank"))).alias("_need"),
        F.max(F.col("n_rows") == 0).alias("_missing"),
        partial.alias("_partial"),
    )
    status = (
        F.when(F.col("_missing"), "blocked_missing").when(F.col("_partial"), "blocked_incomplete").when(F.col("_need").isNull(), "blocked_insufficient").otherwise("ready")
    )
    judged = table.crossJoin(F.broadcast(verdict)).withColumn("status", status)
    chosen = F.coalesce((F.col("status") == "ready") & (F.col("part_rank") <= F.col("_need")), F.lit(False))
    return judged.withColumn("selected", chosen).drop("_need", "_missing", "_partial")


def propose_sources(members: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """One pick per ranked group; a digest belongs to the first group that wants it.

    `members` holds group, group_sha256, id, member_sha256, digest. Serially, each group in rank
    order takes its first member whose digest is still free. The same result comes from proposals:
    every group proposes its first member, a digest keeps the best-ranked group, the others move to
    their next member with another digest, until nobody has to move. Returns (chosen, skipped).
    """
    spark = members.sparkSession
    key = F.struct("member_sha256", "id", "digest")
    options = cut(
        members.groupBy("group", "group_sha256", "digest").agg(F.min(F.struct("member_sha256", "id")).alias("_m"))
        .select("group", "group_sha256", F.struct("_m.member_sha256", "_m.id", "digest").alias("option")),
        "options",
    )
    sizes = options.groupBy("group").agg(F.count(F.lit(1)).alias("n_options"))
    proposals = cut(
        options.groupBy("group", "group_sha256").agg(F.min("option").alias("option"), F.count(F.lit(1)).alias("n_options")),
        "proposals",
    )
    rank = F.struct("group_sha256", "group")
    while True:
        wanted = (
            proposals.withColumn("digest", F.col("option.digest"))
            .groupBy("digest")
            .agg(F.min(rank).alias("holder"), F.count(F.lit(1)).alias("n_proposals"))
            .filter("n_proposals > 1")
        )
        losers = cut(
            join_per_key(proposals.withColumn("digest", F.col("option.digest")), wanted, ["digest"], "n_proposals")
            .filter(rank > F.col("holder"))
            .select("group", F.col("option").alias("_lost"), "n_options"),
            "losers",
        )
        if losers.isEmpty():
            break
        onward = (
            join_per_key(options, losers, ["group"], "n_options")
            .filter(F.col("option") > F.col("_lost"))
            .groupBy("group", "group_sha256")
            .agg(F.min("option").alias("option"), F.first("n_options").alias("n_options"))
        )
        following = cut(proposals.join(losers.select("group"), "group", "left_anti").unionByName(onward), "proposals")
        drop_cut(spark, proposals)
        proposals = following
    chosen = (
        hashed_rank(proposals.select("group", "group_sha256", "option"), "group_sha256", ["group"], (), "pick")
        .filter(F.col("pick") <= target)
        .select("pick", "group", "group_sha256", "option.id", "option.digest", "option.member_sha256")
    )
    chosen = cut(chosen, "chosen")
    last = chosen.filter(F.col("pick") == target).select("group_sha256", "group").first()
    if last is None:
        raise ContractViolation("too few distinct sources; the target does not shrink")
    reached = (F.col("group_sha256") < last["group_sha256"]) | (
        (F.col("group_sha256") == last["group_sha256"]) & (F.col("group") <= F.lit(last["group"]))
    )
    picks = chosen.select("group", F.struct("member_sha256", "id").alias("_pick"))
    groups = (
        members.filter(reached)
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("n_members"))
        .join(picks, "group", "left")
    )
    skipped = (
        join_per_key(members.filter(reached), groups, ["group"], "n_members")
        .filter(F.col("_pick").isNull() | (F.struct("member_sha256", "id") < F.col("_pick")))
        .select("group", "id", "digest", F.lit("selected_raw_byte_duplicate").alias("reason"))
    )
    return chosen, skipped


def first_hits(df: DataFrame, by: Sequence[str], ordinal: str, hit: Column, score: str, payload: Sequence[str]) -> DataFrame:
    """First hit in enumeration order and best-scored candidate per key (earlier one on ties)."""
    best = F.struct(F.col(score).alias("s"), (-F.col(ordinal)).alias("o"))
    value = F.struct(*payload)
    return df.groupBy(*by).agg(
        F.min_by(value, F.when(hit, F.col(ordinal))).alias("_first"),
        F.max_by(value, best).alias("_best"),
        F.count_if(hit).alias("n_hits"),
    ).select(
        *by,
        "n_hits",
        *[F.when(F.col("n_hits") > 0, F.col(f"_first.{c}")).alias(f"first_{c}") for c in payload],
        *[F.col(f"_best.{c}").alias(f"best_{c}") for c in payload],
    )
