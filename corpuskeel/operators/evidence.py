"""Evidence tables: source contract, claim audit, exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import join_per_key, range_lag, range_rank

DIRECT_KINDS = ("direct-evidence", "author-interpretation")
ASSUMED_KINDS = ("agent-inference", "open-assumption")
INSPECTED = ("full-text", "abstract")


def identity_conflicts(papers: DataFrame, identities: Mapping[str, Column], order: str) -> DataFrame:
    """Each repeated identity against the holder just before it (not against the first one).

    `order` is a numeric column, unique per paper.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in identities.items()])
    long = papers.select("paper_id", F.col(order).alias("_o"), F.explode(entries).alias("_e")).select("paper_id", "_o", "_e.*")
    held = long.filter(F.col("key").isNotNull())
    repeated = held.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_holders")).filter("n_holders > 1")
    # Singletons leave before the series are ordered.
    series = join_per_key(held, repeated, ["kind", "key"], "n_holders")
    return (
        range_lag(series, ["kind", "key"], "_o", "paper_id", "previous_id")
        .filter(F.col("previous_id").isNotNull())
        .select("kind", "paper_id", "previous_id")
    )


def source_contract(papers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings (severity, subject, code) of evidence against its sources and of unverified papers."""
    joined = evidence.join(papers.select(F.col("paper_id").alias("source_id"), "verification"), "source_id", "left")
    located = F.col("locator").isNotNull() & (F.col("locator") != "")
    codes = F.array_compact(
        F.array(
            F.when(F.col("verification").isNull(), "missing_source"),
            F.when(
                (F.col("kind") == "direct-evidence") & F.col("verification").isNotNull() & ((F.col("verification") != "verified") | ~located),
                "direct_without_verified_locator",
            ),
            F.when(F.col("kind").isin(*ASSUMED_KINDS) & (F.size("assumptions") == 0), "unmarked_assumption"),
        )
    )
    errors = joined.select(F.lit("error").alias("severity"), F.col("evidence_id").alias("subject"), F.explode(codes).alias("code"))
    warnings = papers.filter(F.col("verification") != "verified").select(
        F.lit("warning").alias("severity"), F.col("paper_id").alias("subject"), F.concat(F.lit("source_"), F.col("verification")).alias("code")
    )
    return errors.unionByName(warnings)


def inspection_findings(papers: DataFrame, artifacts: DataFrame, identities: Mapping[str, Column], order: str) -> DataFrame:
    """Counted errors (severity, subject, code, n) of the papers themselves.

    A verified paper names an artifact it was inspected in, read as full text or abstract, and its digest;
    `artifacts` (artifact, sha256) are the digests of what is there, e.g. from `files.file_digests`. Paths that
    are absolute or climb with '..' count as missing. Every holder of an id or identity after the first is
    an error. `order` is a numeric column, unique per row.
    """
    held = artifacts.groupBy("artifact").agg(F.min("sha256").alias("_found"))
    safe = ~(F.col("artifact").startswith("/") | F.array_contains(F.split("artifact", "/"), ".."))
    read = F.coalesce(F.col("inspected_content").isin(*INSPECTED), F.lit(False)) & F.col("artifact").isNotNull()
    code = (
        F.when(~read, "inspection_absent")
        .when(F.col("_found").isNull() | ~safe, "inspection_missing")
        .when(~F.col("_found").eqNullSafe(F.col("artifact_sha256")), "inspection_mismatch")
    )
    verified = papers.filter(F.col("verification") == "verified").select("paper_id", "inspected_content", "artifact", "artifact_sha256")
    checked = verified.join(held, "artifact", "left").select("paper_id", code.alias("code")).filter("code IS NOT NULL")
    counted = checked.groupBy("paper_id", "code").agg(F.count(F.lit(1)).alias("n"))
    ids = papers.groupBy("paper_id").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0").select("paper_id", F.lit("duplicate_paper_id").alias("code"), "n")
    repeated = identity_conflicts(papers, identities, order).select("paper_id", F.concat(F.lit("duplicate_"), "kind").alias("code"))
    same = repeated.groupBy("paper_id", "code").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(ids).unionByName(same).select(F.lit("error").alias("severity"), F.col("paper_id").alias("subject"), "code", "n")


def claim_links(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long (claim_id, evidence_id) and (claim_id, run_id) tables of claims that carry id arrays."""
    return (
        claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")),
        claims.select("claim_id", F.explode("run_ids").alias("run_id")),
    )


def claim_support(
    claims: DataFrame, cited: DataFrame, used: DataFrame, evidence: DataFrame, papers: DataFrame, runs: DataFrame, expected: DataFrame
) -> DataFrame:
    """Counted findings per claim: supporting, contradicting, unresolved.

    `cited` (claim_id, evidence_id) and `used` (claim_id, run_id) are the links of the claims. `expected`
    (run_id) are the runs that have to be there. A run that is missing or not completed is a gap; a
    claim that relies on runs is left unresolved by a gap among the runs that are not its own.
    """
    sources = papers.select(F.col("paper_id").alias("source_id"), "verification")
    seen = evidence.select("evidence_id", "source_id", "stance", "kind", F.lit(True).alias("_e"))
    verified = F.col("verification") == "verified"
    from_evidence = (
        cited.join(seen, "evidence_id", "left")
        .join(sources, "source_id", "left")
        .select(
            "claim_id",
            F.when(F.col("_e").isNull() | F.col("verification").isNull() | ~verified, "unresolved")
            .when(F.col("stance") == "contradicting", "contradicting")
            .when((F.col("stance") == "supporting") & F.col("kind").isin(*DIRECT_KINDS), "supporting")
            .otherwise("unresolved")
            .alias("effect"),
        )
    )
    from_runs = used.join(runs.select("run_id", F.col("status").alias("_status")), "run_id", "left").select(
        "claim_id", F.when(F.coalesce(F.col("_status") == "completed", F.lit(False)), "supporting").otherwise("unresolved").alias("effect")
    )
    effects = from_evidence.unionByName(from_runs)
    done = runs.filter(F.col("status") == "completed").select("run_id")
    gaps = cut(expected.select("run_id").distinct().join(done, "run_id", "left_anti"), "run-gaps")
    n_gaps = gaps.count()
    if n_gaps:
        own = used.distinct().join(gaps.withColumn("_gap", F.lit(1)), "run_id", "left").groupBy("claim_id").agg(F.count("_gap").alias("_own"))
        effects = effects.unionByName(own.filter(F.col("_own") < n_gaps).select("claim_id", F.lit("unresolved").alias("effect")))
    counts = effects.groupBy("claim_id").agg(
        *[F.count_if(F.col("effect") == e).alias(f"n_{e}") for e in ("supporting", "contradicting", "unresolved")]
    )
    return claims.select("claim_id").join(counts, "claim_id", "left").na.fill(0)


def classify_claims(support: DataFrame, findings: DataFrame) -> DataFrame:
    """Any contradiction wins; verified needs support, nothing unresolved and no source error.

    `findings` come from `source_contract`; one of severity 'error' anywhere bars every claim.
    """
    clean = (F.col("n_unresolved") == 0) & F.lit(findings.filter(F.col("severity") == "error").isEmpty())
    return support.withColumn(
        "classification",
        F.when(F.col("n_contradicting") > 0, "conflicting")
        .when((F.col("n_supporting") > 0) & clean, "verified")
        .when(F.col("n_supporting") > 0, "partially supported")
        .when(F.col("n_unresolved") > 0, "unverifiable")
        .otherwise("unsupported"),
    )


def self_reviews(claims: DataFrame, reviewer: str) -> DataFrame:
    return claims.filter(F.col("author_id") == reviewer).select("claim_id", "author_id")


def evidence_matrix(papers: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per paper with its limitations in one text and whether it may be cited."""
    return papers.select(
        *fields,
        F.array_join("limitations", "; ").alias("limitations"),
        (F.col("verification") == "verified").alias("citable"),
    )


def ordered_union(df: DataFrame, by: Sequence[str], position: str, values: str) -> DataFrame:
    """Distinct elements of the arrays of a key in order of first appearance, as rows.

    The result stays long (one row per element with its index): the first appearance is a minimum,
    and distinct elements are numbered by slices of the position.
    """
    by = list(by)
    first = (
        df.select(*by, F.col(position).alias("_p"), F.posexplode(values).alias("_i", "element"))
        .groupBy(*by, "element")
        .agg(F.min(F.struct("_p", "_i")).alias("_at"))
        .select(*by, "element", "_at._p", "_at._i")
    )
    return range_rank(first, by, "_p", ["_i"], "index").select(*by, "index", "element")
