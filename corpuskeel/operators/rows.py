"""Row-level shapes: eligibility, filters with reasons, private projection, manifest view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keys import tagged_digest, text_digest, text_group, uint_be

MANIFEST_FIELDS = (
    "domain", "release_id", "source_split", "source_id", "relative_path", "raw_sha256", "raw_size_bytes",
    "width", "height", "group_id", "source_url", "license_reference", "rights_status", "use_limitations",
)


def eligibility(df: DataFrame, keep: Sequence[str], group: Column | None = None) -> DataFrame:
    """Reason per row with fixed precedence, and the text group of eligible rows.

    A row without scores gets a reason of its own, then score or size, then empty text. `group` is the text
    group where an earlier step has computed it; otherwise it is that of `prompt`.
    """
    blocked = (
        (F.least("width", "height") < K.MIN_SIDE)
        | (F.col("image_nsfw") >= K.SCORE_CEILING)
        | (F.col("prompt_nsfw") >= K.SCORE_CEILING)
    )
    # The text group is null exactly for empty texts, so the text is folded once.
    grouped = df.withColumn("_g", text_group("prompt") if group is None else group)
    reason = (
        F.when(F.col("image_nsfw").isNull() | F.col("prompt_nsfw").isNull(), "no_score")
        .when(blocked, "score_or_size")
        .when(F.col("_g").isNull(), "empty_prompt")
        .otherwise("metadata_eligible")
    )
    return grouped.select(*keep, reason.alias("reason"), "_g").select(
        *keep, "reason", F.when(F.col("reason") == "metadata_eligible", F.col("_g")).alias("prompt_group_sha256")
    )


def in_ranked_prefix(df: DataFrame, parts: DataFrame, part: str) -> DataFrame:
    """Rows of the candidate parts; adaptive execution broadcasts `parts` where its measured size allows."""
    return df.join(parts.select(part), part, "left_semi")


def allow_list_reason(value: Column, allowed: Sequence[str], side: Column, min_side: int) -> Column:
    return (
        F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), "license_label")
        .when(side < min_side, "native_dimensions")
        .otherwise("eligible")
    )


def private_projection(df: DataFrame, key: Column, part: Column, text: str, seed: Column, user: Column) -> DataFrame:
    """Tagged digests and a status only; text and user name do not leave this select."""
    unknown = user.isNull() | user.isin(*K.UNKNOWN_PRODUCERS)
    sound = unknown | user.rlike(K.PATTERN_HEX64)
    producer = F.when(unknown, F.lit(None)).otherwise(text_digest(K.TAG_PRODUCER, user))
    checked = F.when(sound, producer).otherwise(F.raise_error(F.lit("invalid producer metadata")).cast("string"))
    return df.select(
        key.alias("id"),
        part.alias("part_id"),
        text_group(text).alias("prompt_group"),
        checked.alias("producer_group"),
        F.when(unknown, K.STATUS_UNKNOWN_PRODUCER).otherwise(K.STATUS_KNOWN_PRODUCER).alias("producer_status"),
        seed.alias("_seed"),
    ).select(
        "id", "part_id", "prompt_group", "producer_group", "producer_status",
        tagged_digest(K.TAG_TEXT_SEED, F.unhex("prompt_group"), uint_be("_seed", 4)).alias("prompt_seed_group"),
    )


def manifest_view(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """One source in the fixed manifest layout; the group is named after the raw digest."""
    whole = {"group_id": F.concat(F.lit("raw-"), columns["raw_sha256"]), "rights_status": F.lit("pending-image-rights"), **columns}
    return df.select(*[whole[f].cast("string").alias(f) for f in MANIFEST_FIELDS])


def manifest(*views: DataFrame) -> DataFrame:
    whole = views[0]
    for view in views[1:]:
        whole = whole.unionByName(view)
    return whole.orderBy("domain", "source_split", "source_id")
