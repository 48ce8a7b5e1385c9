"""Queries: orders and selections (WN1-WN9, WN12), exact duplicates (AG3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import keys as X
from ..operators import dedup, rank
from ..session import cut
from .q_rows import SQL_ELIGIBLE, SQL_PARTS
from .registry import query, table
from .views import (
    SQL_META, SQL_RECORDS, metadata, records, sql_digest, sql_revision_rank, sql_text_digest, sql_text_group, sql_uint,
)


@query("wn1_ranked_parts", f"WITH {SQL_META}, {SQL_PARTS} SELECT part_id, rank_sha256, part_rank FROM parts")
def wn1(spark, folder):
    return rank.ranked_partitions(metadata(spark, folder), "part_id", X.part_rank("part_id"))


_GROUP_RANK = sql_revision_rank(K.TAG_GROUP_RANK, "unhex(g)")
_MEMBER_RANK = sql_revision_rank(K.TAG_MEMBER_RANK, "unhex(md5(CAST(doc_id AS VARCHAR)))")
SQL_GROUPED = f"""grouped AS (SELECT doc_id, g, sha256(text) AS digest, {_GROUP_RANK} AS group_sha256, {_MEMBER_RANK} AS member_sha256
  FROM (SELECT doc_id, text, {sql_text_group('text')} AS g FROM documents))"""


@query(
    "wn2_candidate_order",
    f"""WITH {SQL_GROUPED}, r AS (SELECT g, row_number() OVER (ORDER BY group_sha256, g) AS group_rank, n FROM
         (SELECT g, any_value(group_sha256) AS group_sha256, count(*) AS n FROM grouped GROUP BY 1))
       SELECT doc_id, g AS prompt_group, group_sha256, member_sha256, group_rank, n AS n_members,
         row_number() OVER (PARTITION BY g ORDER BY member_sha256, doc_id) AS member_position FROM grouped JOIN r USING (g)""",
)
def wn2(spark, folder):
    eligible = table(spark, folder, "documents").select("doc_id", X.text_group("text").alias("prompt_group"))
    member = X.revision_rank(K.TAG_MEMBER_RANK, F.unhex(F.md5(F.col("doc_id").cast("string"))))
    return rank.candidate_order(cut(eligible, "eligible"), "prompt_group", X.group_rank("prompt_group"), "doc_id", member)


_CANDIDATE = sql_digest(K.TAG_CANDIDATE_RANK, f"unhex('{K.SOURCE_REVISION}')", sql_uint("doc_id", 8))
_TARGET = 100


def _candidates(spark, folder):
    digest = X.revision_rank(K.TAG_CANDIDATE_RANK, X.uint_be("doc_id", 8))
    return table(spark, folder, "documents").select("doc_id", "n_chars", digest.alias("rank_sha256"))


@query(
    "wn3_candidates_and_reserves",
    f"""WITH r AS (SELECT doc_id, rank_sha256, row_number() OVER (ORDER BY rank_sha256, doc_id) AS position FROM (SELECT doc_id, {_CANDIDATE} AS rank_sha256 FROM documents))
       SELECT *, CASE WHEN position <= {_TARGET} THEN 'candidate' ELSE 'reserve' END AS role,
         CASE WHEN position > {_TARGET} THEN position - {_TARGET} - 1 END AS reserve_index FROM r""",
)
def wn3(spark, folder):
    return rank.candidates_and_reserves(_candidates(spark, folder).drop("n_chars"), "rank_sha256", "doc_id", _TARGET)


@query(
    "wn4_admit_first_passing",
    f"""WITH r AS (SELECT doc_id, n_chars >= 500 AS ok, row_number() OVER (ORDER BY {_CANDIDATE}, doc_id) AS position FROM documents),
       t AS (SELECT *, CASE WHEN ok THEN sum(ok::INT) OVER (ORDER BY position) END AS taken FROM r)
       SELECT doc_id, position, CASE WHEN NOT ok THEN 'excluded' WHEN taken <= {_TARGET} AND position <= {_TARGET} THEN 'accepted'
         WHEN taken <= {_TARGET} THEN 'replacement' ELSE 'spare' END AS verdict,
         CASE WHEN taken <= {_TARGET} AND position > {_TARGET} THEN position - {_TARGET} - 1 END AS reserve_index FROM t""",
)
def wn4(spark, folder):
    return rank.admit_first_passing(_candidates(spark, folder), "rank_sha256", "doc_id", F.col("n_chars") >= 500, _TARGET)


_QUOTAS = {"de": 8, "en": 12, "es": 8, "fr": 8}


def _reservation_sql() -> str:
    parts, names = [], []
    for d, q in sorted(_QUOTAS.items()):
        taken = "".join(f" AND g NOT IN (SELECT g FROM t_{n})" for n in names)
        parts.append(
            f"""t_{d} AS (SELECT lang, g, rank_sha256, uid FROM (SELECT lang, g, uid, rank_sha256, row_number() OVER (PARTITION BY g ORDER BY rank_sha256, uid) AS rn
            FROM u WHERE lang = '{d}'{taken}) WHERE rn = 1 ORDER BY rank_sha256, uid LIMIT {q})"""
        )
        names.append(d)
    union = " UNION ALL ".join(f"SELECT * FROM t_{d}" for d in names)
    uid = "lang || ':' || source || ':' || doc_id"
    return f"""WITH u AS (SELECT lang, {sql_text_group('text')} AS g, {uid} AS uid, {sql_text_digest(K.TAG_RESERVATION, uid)} AS rank_sha256 FROM documents),
      {', '.join(parts)} {union}"""


@query("wn5_reservation", _reservation_sql())
def wn5(spark, folder):
    rows = table(spark, folder, "documents").select("lang", X.text_group("text").alias("g"), X.source_uid("lang", "source", "doc_id").alias("uid"))
    return rank.reserve_per_domain(cut(rows, "reservable"), "uid", "lang", "g", _QUOTAS)


@query(
    "wn6_representatives",
    f"""WITH u AS (SELECT {sql_text_group('text')} AS g, lang, CAST(doc_id AS VARCHAR) AS id FROM documents),
       r AS (SELECT *, {sql_text_digest(K.TAG_REPRESENTATIVE, "g || ':' || id")} AS rank_sha256 FROM u)
       SELECT g, lang, id AS representative, rank_sha256 FROM r QUALIFY row_number() OVER (PARTITION BY g, lang ORDER BY rank_sha256, id) = 1""",
)
def wn6(spark, folder):
    rows = table(spark, folder, "documents").select(X.text_group("text").alias("g"), "lang", F.col("doc_id").cast("string").alias("id"))
    return rank.representatives(rows, "g", "lang", "id")


_UID = "source || ':' || lpad(CAST(doc_id AS VARCHAR), 9, '0')"
_PRIORITY = sql_digest(K.TAG_COHORT, sql_uint("octet_length(encode(uid))", 4), "encode(uid)")
SQL_COHORT = f"""u AS (SELECT lang AS domain, {sql_text_group('text')} AS g, min({_UID}) AS uid FROM documents GROUP BY 1, 2),
p AS (SELECT domain, g, uid AS representative_uid, {_PRIORITY} AS priority_sha256 FROM u),
cohort AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority_sha256, representative_uid) AS position FROM p QUALIFY position <= 30)"""


def _cohort(spark, folder):
    uid = F.concat_ws(":", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    rows = table(spark, folder, "documents").select(F.col("lang").alias("domain"), X.text_group("text").alias("g"), uid.alias("uid"))
    return rank.stratified_cohort(rows, "g", "domain", "uid", 30)


@query("wn7_cohort", f"WITH {SQL_COHORT} SELECT domain, g, representative_uid, priority_sha256, position FROM cohort")
def wn7(spark, folder):
    return _cohort(spark, folder)


@query(
    "wn7_shortfall",
    f"""WITH {SQL_COHORT}, d AS (SELECT DISTINCT lang AS domain FROM documents UNION SELECT 'none-' || r_name FROM region)
       SELECT d.domain, count(c.g) AS n_selected, CAST(greatest(0, 30 - count(c.g)) AS BIGINT) AS shortfall FROM d LEFT JOIN cohort c USING (domain) GROUP BY 1""",
)
def wn7_shortfall(spark, folder):
    domains = table(spark, folder, "documents").select(F.col("lang").alias("domain")).unionByName(
        table(spark, folder, "region").select(F.concat(F.lit("none-"), "r_name").alias("domain"))
    )
    return rank.cohort_shortfall(_cohort(spark, folder), domains, "domain", 30)


def _prefix_sql(expected: str) -> str:
    return f"""WITH {SQL_ELIGIBLE}, {SQL_PARTS}, c AS (SELECT * FROM parts WHERE part_rank <= 14),
       goal AS (SELECT CAST(count(*) // 5 AS BIGINT) AS target, {expected} AS expected FROM documents),
       e AS (SELECT part_rank, prompt_group_sha256 AS g FROM eligible JOIN c USING (part_id)),
       f AS (SELECT g, min(part_rank) AS part_rank FROM e WHERE g IS NOT NULL GROUP BY 1),
       t AS (SELECT c.part_id, c.part_rank, (SELECT count(*) FROM f WHERE f.part_rank = c.part_rank) AS new_groups,
             (SELECT count(*) FROM e WHERE e.part_rank = c.part_rank) AS n_rows FROM c),
       r AS (SELECT *, CAST(sum(new_groups) OVER (ORDER BY part_rank) AS BIGINT) AS total_groups FROM t),
       s AS (SELECT *, CASE WHEN min(n_rows) OVER () = 0 THEN 'blocked_missing' WHEN bool_or(n_rows <> expected) OVER () THEN 'blocked_incomplete'
             WHEN max(total_groups) OVER () < target THEN 'blocked_insufficient' ELSE 'ready' END AS status,
             min(CASE WHEN total_groups >= target THEN part_rank END) OVER () AS need FROM r, goal)
       SELECT part_id, part_rank, new_groups, n_rows, total_groups, status, coalesce(status = 'ready' AND part_rank <= need, false) AS selected FROM s"""


def _prefix(spark, folder, expected):
    """The prefix over all rows of the parts; `expected` reads the rows that a part has to have from all documents."""
    from .q_rows import eligible_rows

    rows = cut(eligible_rows(spark, folder), "ledger")
    parts = rank.ranked_partitions(metadata(spark, folder), "part_id", X.part_rank("part_id"), 14)
    n, per_part = table(spark, folder, "documents").agg(F.count(F.lit(1)), expected).first()
    return rank.shortest_prefix(parts, rows, "part_id", "prompt_group_sha256", n // 5, per_part).select(
        "part_id", "part_rank", "new_groups", "n_rows", "total_groups", "status", "selected"
    )


@query("wn8_shortest_prefix", _prefix_sql("count(*) // count(DISTINCT source)"))
def wn8(spark, folder):
    return _prefix(spark, folder, F.floor(F.count(F.lit(1)) / F.count_distinct("source")))


@query("wn8_incomplete_parts", _prefix_sql("1 + count(*) // count(DISTINCT source)"))
def wn8_incomplete(spark, folder):
    """Every part is a row short of what it has to have, so nothing is selected."""
    return _prefix(spark, folder, F.floor(F.count(F.lit(1)) / F.count_distinct("source")) + 1)


# Groups of documents by (source, size class): their texts collide across sources, so picks compete.
_POOL_GROUP = "source || ':' || (n_chars % 5)"


def _pool(spark, folder):
    member = X.revision_rank(K.TAG_MEMBER_RANK, F.unhex(F.md5(F.col("doc_id").cast("string"))))
    return table(spark, folder, "documents").select(
        F.concat_ws(":", "source", F.col("n_chars") % 5).alias("group"), F.col("doc_id").alias("id"),
        F.sha2("text", 256).alias("digest"), member.alias("member_sha256"),
    ).withColumn("group_sha256", X.text_digest(K.TAG_GROUP_RANK, "group"))


# The serial rule as a recursive query: groups in rank order, each with the digests taken so far.
SQL_PICKS = f"""WITH RECURSIVE pool AS (SELECT doc_id, {_POOL_GROUP} AS grp, sha256(text) AS digest, {_MEMBER_RANK} AS member_sha256 FROM documents),
ranked AS (SELECT grp, row_number() OVER (ORDER BY {sql_text_digest(K.TAG_GROUP_RANK, 'grp')}, grp) AS gr,
   list({{'id': doc_id, 'digest': digest}} ORDER BY member_sha256, doc_id) AS members FROM pool GROUP BY grp),
walk AS (
  SELECT 0::BIGINT AS gr, NULL::VARCHAR AS grp, NULL::STRUCT(id BIGINT, digest VARCHAR) AS pick, []::VARCHAR[] AS used
  UNION ALL
  SELECT gr, grp, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.digest) END FROM (
    SELECT r.gr, r.grp, w.used, list_filter(r.members, lambda x: NOT list_contains(w.used, x.digest))[1] AS pick
    FROM walk w JOIN ranked r ON r.gr = w.gr + 1)),
chosen AS (SELECT row_number() OVER (ORDER BY gr) AS pick_no, gr, grp, pick FROM walk WHERE pick IS NOT NULL)"""


@query(
    "wn9_proposals",
    f"{SQL_PICKS} SELECT pick_no AS pick, grp AS \"group\", pick.id AS id, pick.digest AS digest FROM chosen WHERE pick_no <= 80",
)
def wn9(spark, folder):
    chosen, _ = rank.propose_sources(cut(_pool(spark, folder), "pool"), 80)
    return chosen.select("pick", "group", "id", "digest")


@query(
    "wn9_skipped",
    f"""{SQL_PICKS}, last AS (SELECT max(gr) AS gr FROM chosen WHERE pick_no <= 80),
       m AS (SELECT r.gr, r.grp, unnest(r.members) AS m, generate_subscripts(r.members, 1) AS i, c.pick,
               list_position(list_transform(r.members, lambda x: x.id), c.pick.id) AS spot
             FROM ranked r LEFT JOIN chosen c USING (gr) WHERE r.gr <= (SELECT gr FROM last))
       SELECT grp AS "group", m.id AS id, m.digest AS digest, 'selected_raw_byte_duplicate' AS reason FROM m WHERE spot IS NULL OR i < spot""",
)
def wn9_skipped(spark, folder):
    _, skipped = rank.propose_sources(cut(_pool(spark, folder), "pool"), 80)
    return skipped


@query(
    "wn12_first_hits",
    """SELECT conv_id, count(*) FILTER (length(text) > 400) AS n_hits, arg_min(turn, turn) FILTER (length(text) > 400) AS first_turn,
       arg_min(role, turn) FILTER (length(text) > 400) AS first_role, arg_max(turn, length(text) * 1000 - turn) AS best_turn,
       arg_max(role, length(text) * 1000 - turn) AS best_role FROM conversations GROUP BY 1""",
)
def wn12(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("n", F.char_length("text"))
    return rank.first_hits(turns, ["conv_id"], "turn", F.col("n") > 400, "n", ["turn", "role"])


_RAW_GROUP = sql_digest(K.TAG_RAW_GROUP, "unhex(sha256)")
SQL_DUPLICATES = f"""dups AS (SELECT sha256, count(*) AS n_members, min(id) AS first_id,
  min(CASE WHEN domain = 'bench' THEN 'bench' ELSE 'documents' END) <> max(CASE WHEN domain = 'bench' THEN 'bench' ELSE 'documents' END) AS cross_source,
  min(domain) <> max(domain) AS cross_domain, min(bytes) <> max(bytes) OR min(width) <> max(width) OR min(height) <> max(height) AS conflict,
  {_RAW_GROUP} AS group_id FROM records GROUP BY sha256 HAVING count(*) > 1)"""


def _duplicates(spark, folder):
    whole = cut(records(spark, folder), "records")
    source = F.when(F.col("domain") == "bench", "bench").otherwise("documents")
    return whole, dedup.duplicate_groups(whole, source)


@query("ag3_duplicate_groups", f"WITH {SQL_RECORDS}, {SQL_DUPLICATES} SELECT * FROM dups")
def ag3(spark, folder):
    return _duplicates(spark, folder)[1]


@query("ag3_duplicate_members", f"WITH {SQL_RECORDS}, {SQL_DUPLICATES} SELECT d.group_id, r.id, d.n_members FROM records r JOIN dups d USING (sha256)")
def ag3_members(spark, folder):
    return dedup.duplicate_members(*_duplicates(spark, folder))
