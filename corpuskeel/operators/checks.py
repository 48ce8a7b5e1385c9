"""Fail-closed checks: every rule yields a table of violations, and `require_none` stops on any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


class ContractViolation(ValueError):
    """Input or result breaks a declared rule; nothing may be computed from it."""


def require_none(violations: DataFrame, message: str, examples: int = 5) -> None:
    found = violations.limit(examples).collect()
    if found:
        raise ContractViolation(f"{message}: " + "; ".join(str(row.asDict()) for row in found))


def row_violations(df: DataFrame, key: Column | str, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, key) for each rule a row breaks. A rule column is true where the row is sound."""
    key = F.col(key) if isinstance(key, str) else key
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def metadata_rules(parts: int, name: str = "image_name") -> dict[str, Column]:
    """Row rules of the metadata table; they hold for excluded rows as well."""

    def score(field: str) -> Column:
        c = F.col(field)
        return c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0)

    return {
        "part_range": F.col("part_id").between(1, parts),
        "name_present": F.col(name).isNotNull() & (F.col(name) != ""),
        "width_positive": F.col("width") > 0,
        "height_positive": F.col("height") > 0,
        "image_score": score("image_nsfw") | (F.col("image_nsfw") == K.SCORE_SENTINEL),
        "prompt_score": score("prompt_nsfw"),
        "prompt_text": F.col("prompt").isNotNull(),
    }


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def dependency_violations(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that carry more than one value (min and max merge map-side; no set is collected)."""
    return (
        df.groupBy(*keys)
        .agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(F.lit(1)).alias("n_rows"))
        .filter(~F.col("least").eqNullSafe(F.col("greatest")))
    )


def cardinality_report(df: DataFrame, key: str, expected: DataFrame, rows_per_key: Column | int) -> DataFrame:
    """Each expected or observed key with its row count and ok / missing / unexpected / wrong_count."""
    rows_per_key = F.lit(rows_per_key) if isinstance(rows_per_key, int) else rows_per_key
    seen = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = expected.select(key, rows_per_key.cast("long").alias("n_expected"))
    return wanted.join(seen, key, "full_outer").select(
        key,
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.col("n_expected"),
        F.when(F.col("n_expected").isNull(), "unexpected")
        .when(F.col("n_rows").isNull(), "missing")
        .when(F.col("n_rows") != F.col("n_expected"), "wrong_count")
        .otherwise("ok")
        .alias("status"),
    )


def coverage_violations(df: DataFrame, key: str, status: str, digest: str, reason: str) -> DataFrame:
    """A pass needs a digest; a reject needs a reason and must not carry a digest."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    passed, rejected = F.col(status) == K.STATUS_PASS, F.col(status) == K.STATUS_REJECT
    return row_violations(
        df,
        key,
        {
            "known_status": F.col(status).isin(K.STATUS_PASS, K.STATUS_REJECT),
            "pass_has_digest": ~passed | has(digest),
            "reject_has_reason": ~rejected | has(reason),
            "reject_has_no_digest": ~rejected | ~has(digest),
        },
    )


def record_violations(
    df: DataFrame,
    key: str,
    body: str,
    required: Mapping[str, str],
    optional: Mapping[str, str] | None = None,
    rules: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Closed-record check of a JSON text column.

    `required` and `optional` map field names to Spark SQL types. Reported per row: unreadable text,
    missing fields, fields outside the contract, values that do not parse as their type, and every
    extra rule (a column over `record.<field>`) that does not hold.
    """
    optional = dict(optional or {})
    fields = {**required, **optional}
    keys = F.json_object_keys(F.col(body))
    parsed = df.withColumn("record", F.from_json(body, ", ".join(f"`{n}` {t}" for n, t in fields.items()))).withColumn("_keys", keys)
    checks: dict[str, Column] = {"readable": F.col("_keys").isNotNull()}
    for name in required:
        checks[f"missing:{name}"] = F.array_contains("_keys", name)
    checks["unknown_field"] = F.size(F.array_except("_keys", F.array(*[F.lit(n) for n in fields]))) == 0
    for name in fields:
        checks[f"type:{name}"] = ~F.array_contains("_keys", name) | F.col(f"record.{name}").isNotNull()
    for name, rule in (rules or {}).items():
        checks[f"rule:{name}"] = rule
    return row_violations(parsed, key, checks)


def coverage_counters(df: DataFrame, by: Sequence[str], example: str) -> DataFrame:
    """Counts per (status, reason, ...) with the smallest id as an example."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.min(example).alias("first_id"))


def first_examples(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 10) -> DataFrame:
    """First `n` rows per key; the row_number filter is pushed below the shuffle as a group limit."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n)


def exclusion_counters(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n_rows"))
