"""Queries: projections, filters and predicates (PF), cardinality checks that go with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import keys as X
from ..operators import checks, rank
from ..operators import rows as R
from .registry import query, table
from .views import (
    SQL_META, metadata, sql_digest, sql_fold, sql_revision_rank, sql_text_digest, sql_text_group, sql_uint,
)

_REASON = f"""CASE WHEN image_nsfw IS NULL OR prompt_nsfw IS NULL THEN 'no_score'
  WHEN least(width, height) < {K.MIN_SIDE} OR image_nsfw >= {K.SCORE_CEILING} OR prompt_nsfw >= {K.SCORE_CEILING} THEN 'score_or_size'
  WHEN {sql_fold('prompt')} IS NULL THEN 'empty_prompt' ELSE 'metadata_eligible' END"""
SQL_ELIGIBLE = f"""{SQL_META}, eligible AS (
  SELECT doc_id, part_id, {_REASON} AS reason,
         CASE WHEN {_REASON} = 'metadata_eligible' THEN {sql_text_group('prompt')} END AS prompt_group_sha256 FROM meta)"""


def eligible_rows(spark, folder):
    """Eligibility of every document; texts are folded at the scan."""
    grouped = metadata(spark, folder, X.text_group("text"))
    return R.eligibility(grouped, ["doc_id", "part_id"], F.col("prompt"))


@query("pf1_eligibility", f"WITH {SQL_ELIGIBLE} SELECT * FROM eligible")
def pf1(spark, folder):
    return eligible_rows(spark, folder)


_RULES = {
    "part_range": "part_id BETWEEN 1 AND 2000",
    "name_present": "image_name <> ''",
    "width_positive": "width > 0",
    "height_positive": "height > 0",
    "image_score": "image_nsfw BETWEEN 0 AND 1 OR image_nsfw = 2.0",
    "prompt_score": "prompt_nsfw BETWEEN 0 AND 1",
    "prompt_text": "prompt IS NOT NULL",
}


@query(
    "pf2_row_violations",
    f"WITH {SQL_META} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, CAST(doc_id AS VARCHAR) AS key FROM meta WHERE NOT coalesce({rule}, false)"
        for name, rule in _RULES.items()
    ),
)
def pf2(spark, folder):
    return checks.row_violations(metadata(spark, folder, F.when(F.col("text").isNotNull(), "present")), "doc_id", checks.metadata_rules(2000))


_PART_RANK = sql_revision_rank(K.TAG_PART_RANK, sql_uint("part_id", 2))
SQL_PARTS = f"""parts AS (SELECT part_id, rank_sha256, row_number() OVER (ORDER BY rank_sha256, part_id) AS part_rank
  FROM (SELECT DISTINCT part_id, {_PART_RANK} AS rank_sha256 FROM meta))"""


@query(
    "pf3_ranked_prefix_rows",
    f"WITH {SQL_META}, {SQL_PARTS} SELECT doc_id, part_id FROM meta WHERE part_id IN (SELECT part_id FROM parts WHERE part_rank <= 5)",
)
def pf3(spark, folder):
    meta = metadata(spark, folder)
    parts = rank.ranked_partitions(meta, "part_id", X.part_rank("part_id"), 5)
    return R.in_ranked_prefix(meta.select("doc_id", "part_id"), parts, "part_id")


@query(
    "pf4_exclusions",
    """SELECT CASE WHEN lang NOT IN ('en', 'fr') THEN 'license_label' WHEN n_chars < 64 THEN 'native_dimensions' ELSE 'eligible' END
       AS reason, count(*) AS n_rows FROM documents GROUP BY 1""",
)
def pf4(spark, folder):
    reason = R.allow_list_reason(F.col("lang"), ["en", "fr"], F.col("n_chars"), 64)
    return checks.exclusion_counters(table(spark, folder, "documents").withColumn("reason", reason), "reason")


_PATH = "regexp_replace(url, '^https?://', '')"


@query(
    "pf5_safe_path",
    f"""SELECT page_id, path, (path <> '' AND NOT contains(path, '\\') AND NOT contains(path, ':') AND NOT starts_with(path, '/')
       AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0) AS safe
       FROM (SELECT page_id, {_PATH} AS path FROM pages)""",
)
def pf5(spark, folder):
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, folder, "pages").select("page_id", path.alias("path")).withColumn("safe", X.is_safe_relative_path("path"))


@query(
    "pf6_public_https",
    """SELECT page_id, regexp_matches(url, '^https://[^/?#@]+(/[^?#]*)?$') AND NOT regexp_matches(url, '[\\x00-\\x20]') AS public_https,
       regexp_matches(url, '^https?://[^/?#]*\\.example\\.com([/?#]|$)') AS on_example_com FROM pages""",
)
def pf6(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", X.is_public_https("url").alias("public_https"), X.has_host_suffix("url", ".example.com").alias("on_example_com")
    )


@query(
    "pf7_formats",
    """SELECT page_id, regexp_full_match(tail, '[A-Za-z0-9][A-Za-z0-9._:-]*') AS safe_id,
       regexp_full_match(tail, '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') AS identifier,
       regexp_full_match(tail, '[1-9][0-9]*') AS positive_decimal, regexp_full_match(sha256(html), '[0-9a-f]{64}') AS hex64
       FROM (SELECT page_id, html, string_split(url, '/')[-1] AS tail FROM pages)""",
)
def pf7(spark, folder):
    tail = F.element_at(F.split("url", "/"), -1)
    return table(spark, folder, "pages").select(
        "page_id",
        X.is_safe_id(tail).alias("safe_id"),
        X.is_identifier(tail).alias("identifier"),
        X.is_positive_decimal(tail).alias("positive_decimal"),
        X.is_hex64(F.sha2("html", 256)).alias("hex64"),
    )


def _manifest_sql(domain, split, key, path, text, width, url, limits, source):
    return f"""SELECT '{domain}' AS domain, 'r1' AS release_id, {split} AS source_split, CAST({key} AS VARCHAR) AS source_id,
      {path} AS relative_path, sha256({text}) AS raw_sha256, CAST(octet_length(encode({text})) AS VARCHAR) AS raw_size_bytes,
      CAST({width} AS VARCHAR) AS width, CAST({width} AS VARCHAR) AS height, 'raw-' || sha256({text}) AS group_id, {url} AS source_url,
      'https://example.org/terms' AS license_reference, 'pending-image-rights' AS rights_status, '{limits}' AS use_limitations FROM {source}"""


SQL_MANIFEST = "manifest AS (" + " UNION ALL ".join(
    [
        _manifest_sql("documents", "source", "doc_id", "source || '/' || doc_id || '.txt'", "text", "n_chars",
                      "'https://example.org/' || source", "local use only", "documents"),
        _manifest_sql("benchmark", "'items'", "item_id", "'bench/' || item_id || '.txt'", "text", "length(text)",
                      "'https://example.org/bench'", "held out", "benchmark"),
        _manifest_sql("pages", "'crawl'", "page_id", "'pages/' || page_id || '.html'", "html", "length(html)", "url", "crawled", "pages"),
    ]
) + ")"


def manifest(spark, folder):
    def view(name, domain, split, key, path, text, width, url, limits):
        return R.manifest_view(
            table(spark, folder, name),
            {
                "domain": F.lit(domain), "release_id": F.lit("r1"), "source_split": split, "source_id": F.col(key),
                "relative_path": path, "raw_sha256": F.sha2(text, 256), "raw_size_bytes": F.octet_length(text),
                "width": width, "height": width, "source_url": url,
                "license_reference": F.lit("https://example.org/terms"), "use_limitations": F.lit(limits),
            },
        )

    return R.manifest(
        view("documents", "documents", F.col("source"), "doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")),
             "text", F.col("n_chars"), F.concat(F.lit("https://example.org/"), "source"), "local use only"),
        view("benchmark", "benchmark", F.lit("items"), "item_id", F.concat(F.lit("bench/"), "item_id", F.lit(".txt")),
             "text", F.char_length("text"), F.lit("https://example.org/bench"), "held out"),
        view("pages", "pages", F.lit("crawl"), "page_id", F.concat(F.lit("pages/"), "page_id", F.lit(".html")),
             "html", F.char_length("html"), F.col("url"), "crawled"),
    )


@query("pf8_manifest", f"WITH {SQL_MANIFEST} SELECT * FROM manifest")
def pf8(spark, folder):
    return manifest(spark, folder)


_USER = "CASE WHEN doc_id % 5 = 0 THEN 'deleted_account' WHEN lang <> 'de' THEN sha256(source) END"


@query(
    "pf9_private_projection",
    f"""SELECT 'doc:' || doc_id AS id, CAST(substr(source, 4) AS INTEGER) + 1 AS part_id, {sql_text_group('text')} AS prompt_group,
       CASE WHEN u <> 'deleted_account' THEN {sql_text_digest(K.TAG_PRODUCER, 'u')} END AS producer_group,
       CASE WHEN u IS NULL OR u = 'deleted_account' THEN '{K.STATUS_UNKNOWN_PRODUCER}' ELSE '{K.STATUS_KNOWN_PRODUCER}' END AS producer_status,
       {sql_digest(K.TAG_TEXT_SEED, 'unhex(' + sql_text_group('text') + ')', sql_uint('n_chars', 4))} AS prompt_seed_group
       FROM (SELECT *, {_USER} AS u FROM documents)""",
)
def pf9(spark, folder):
    user = F.when(F.col("doc_id") % 5 == 0, "deleted_account").when(F.col("lang") != "de", F.sha2("source", 256))
    return R.private_projection(
        table(spark, folder, "documents"), F.concat(F.lit("doc:"), "doc_id"),
        F.substring("source", 4, 10).cast("int") + 1, "text", F.col("n_chars"), user,
    )


@query(
    "pf10_record_contract",
    """SELECT 'rule:small' AS rule, CAST(event_id AS VARCHAR) AS key FROM events WHERE CAST(props->>'k' AS INTEGER) >= 50
       UNION ALL SELECT 'missing:tag', CAST(event_id AS VARCHAR) FROM events WHERE (props->>'tag') IS NULL""",
)
def pf10(spark, folder):
    return checks.record_violations(
        table(spark, folder, "events"), "event_id", "props", {"k": "int", "tag": "string"},
        rules={"small": F.col("record.k") < 50},
    )


@query(
    "pf11_coverage_status",
    f"""WITH c AS (SELECT doc_id, CASE WHEN quality = 1 THEN '{K.STATUS_PASS}' WHEN quality = 0 THEN '{K.STATUS_REJECT}' ELSE 'unseen' END AS status,
         CASE WHEN toxic = 0 THEN sha256(text) END AS digest, CASE WHEN quality = 0 AND toxic = 1 THEN 'low' END AS reason
         FROM documents LEFT JOIN labels USING (doc_id))
       SELECT 'known_status' AS rule, CAST(doc_id AS VARCHAR) AS key FROM c WHERE status = 'unseen'
       UNION ALL SELECT 'pass_has_digest', CAST(doc_id AS VARCHAR) FROM c WHERE status = '{K.STATUS_PASS}' AND digest IS NULL
       UNION ALL SELECT 'reject_has_reason', CAST(doc_id AS VARCHAR) FROM c WHERE status = '{K.STATUS_REJECT}' AND reason IS NULL
       UNION ALL SELECT 'reject_has_no_digest', CAST(doc_id AS VARCHAR) FROM c WHERE status = '{K.STATUS_REJECT}' AND digest IS NOT NULL""",
)
def pf11(spark, folder):
    digests = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("_sha256"))
    joined = digests.join(table(spark, folder, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, K.STATUS_PASS).when(F.col("quality") == 0, K.STATUS_REJECT).otherwise("unseen")
    shaped = joined.select(
        "doc_id", status.alias("status"), F.when(F.col("toxic") == 0, F.col("_sha256")).alias("digest"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "low").alias("reason"),
    )
    return checks.coverage_violations(shaped, "doc_id", "status", "digest", "reason")


@query(
    "ag10_cardinality",
    """WITH seen AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY 1),
       wanted AS (SELECT 'src' || i AS source, (SELECT count(*) FROM documents) // 20 AS n_expected FROM range(22) t(i))
       SELECT source, coalesce(n_rows, 0) AS n_rows, n_expected,
         CASE WHEN n_expected IS NULL THEN 'unexpected' WHEN n_rows IS NULL THEN 'missing' WHEN n_rows <> n_expected THEN 'wrong_count' ELSE 'ok' END AS status
       FROM wanted FULL OUTER JOIN seen USING (source)""",
)
def ag10(spark, folder):
    documents = table(spark, folder, "documents")
    total = documents.count()
    wanted = spark.range(22).select(F.concat(F.lit("src"), "id").alias("source"))
    return checks.cardinality_report(documents, "source", wanted, total // 20)


@query(
    "ag11_dependency",
    f"""WITH t AS (SELECT {sql_text_group('text')} AS text_group, source FROM documents)
       SELECT text_group, min(source) AS least, max(source) AS greatest, count(*) AS n_rows FROM t GROUP BY 1
       HAVING count(DISTINCT source) > 1""",
)
def ag11(spark, folder):
    keyed = table(spark, folder, "documents").select(X.text_group("text").alias("text_group"), "source")
    return checks.dependency_violations(keyed, ["text_group"], "source")


@query(
    "ag20_coverage_counters",
    f"WITH {SQL_ELIGIBLE} SELECT reason, part_id, count(*) AS n_rows, min(doc_id) AS first_id FROM eligible GROUP BY 1, 2",
)
def ag20(spark, folder):
    return checks.coverage_counters(eligible_rows(spark, folder), ["reason", "part_id"], "doc_id")


@query(
    "ud1_observed_scan",
    """SELECT lang, count(*) AS n_rows, (SELECT count(*) FROM documents) AS scanned,
       (SELECT sum(n_chars) FROM documents)::BIGINT AS scanned_chars FROM documents GROUP BY 1""",
)
def ud1(spark, folder):
    from ..operators.stats import observed_counts
    from ..session import cut

    documents = table(spark, folder, "documents").select("lang", "n_chars")
    watched, seen = observed_counts(
        documents, f"scan-{id(documents)}", {"rows": F.count(F.lit(1)), "chars": F.sum("n_chars")}
    )
    result = cut(watched.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows")), "observed")
    return result.withColumn("scanned", F.lit(int(seen.get["rows"])).cast("long")).withColumn(
        "scanned_chars", F.lit(int(seen.get["chars"])).cast("long")
    )
