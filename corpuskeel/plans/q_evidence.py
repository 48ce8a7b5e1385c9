"""Queries: evidence tables (JN13, JN14, AG12, AG19, PF12).

Suppliers are sources, line items are evidence, orders are claims, customers are runs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import title_key
from ..operators import evidence as E
from .registry import query, table

SQL_EVIDENCE = """papers AS (SELECT CAST(s_suppkey AS VARCHAR) AS paper_id, s_name AS title, s_nationkey,
    CASE WHEN s_acctbal < 0 THEN 'inaccessible' WHEN s_acctbal < 2000 THEN 'unverified' ELSE 'verified' END AS verification FROM supplier),
evid AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS evidence_id, CAST(l_orderkey AS VARCHAR) AS claim_id,
    CAST(l_suppkey AS VARCHAR) AS source_id,
    CASE WHEN l_discount < 0.05 THEN 'direct-evidence' WHEN l_discount < 0.08 THEN 'author-interpretation' ELSE 'agent-inference' END AS kind,
    CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'contradicting' WHEN l_returnflag = 'N' THEN 'inconclusive' ELSE 'supporting' END AS stance,
    CASE WHEN l_linenumber % 4 > 0 THEN 'p.' || l_linenumber END AS locator, l_tax > 0.02 AS assumed FROM lineitem),
runs AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'completed' END AS status FROM customer)"""


def papers(spark, folder):
    balance = F.col("s_acctbal")
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("paper_id"), F.col("s_name").alias("title"), "s_nationkey",
        F.when(balance < 0, "inaccessible").when(balance < 2000, "unverified").otherwise("verified").alias("verification"),
    )


def ledger(spark, folder):
    discount = F.col("l_discount")
    return table(spark, folder, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"),
        F.col("l_orderkey").cast("string").alias("claim_id"),
        F.col("l_suppkey").cast("string").alias("source_id"),
        F.when(discount < 0.05, "direct-evidence").when(discount < 0.08, "author-interpretation").otherwise("agent-inference").alias("kind"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "contradicting")
        .when(F.col("l_returnflag") == "N", "inconclusive").otherwise("supporting").alias("stance"),
        F.when(F.col("l_linenumber") % 4 > 0, F.concat(F.lit("p."), "l_linenumber")).alias("locator"),
        F.when(F.col("l_tax") > 0.02, F.array(F.lit("stated"))).otherwise(F.array().cast("array<string>")).alias("assumptions"),
    )


def runs(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("run_id"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("completed").alias("status")
    )


def claims(spark, folder):
    """(claims, cited, used): orders cite their lines, finished ones also use the run of their customer."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("claim_id"), "o_orderstatus", F.col("o_custkey").cast("string").alias("run_id"))
    cited = ledger(spark, folder).select("claim_id", "evidence_id").distinct()
    return orders.select("claim_id"), cited, orders.filter("o_orderstatus = 'F'").select("claim_id", "run_id")


_SUPPORT = f"""{SQL_EVIDENCE}, effects AS (
  SELECT e.claim_id, CASE WHEN p.verification IS NULL OR p.verification <> 'verified' THEN 'u' WHEN stance = 'contradicting' THEN 'c'
    WHEN stance = 'supporting' AND kind IN ('direct-evidence', 'author-interpretation') THEN 's' ELSE 'u' END AS effect
  FROM (SELECT DISTINCT * FROM evid) e LEFT JOIN papers p ON p.paper_id = e.source_id
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CASE WHEN r.status = 'completed' THEN 's' ELSE 'u' END
  FROM orders LEFT JOIN runs r ON r.run_id = CAST(o_custkey AS VARCHAR) WHERE o_orderstatus = 'F'
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'u' FROM orders WHERE o_orderstatus = 'F' AND EXISTS (
    SELECT 1 FROM runs g WHERE g.status <> 'completed' AND g.run_id <> CAST(o_custkey AS VARCHAR))),
support AS (SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, count(*) FILTER (effect = 's') AS n_supporting, count(*) FILTER (effect = 'c') AS n_contradicting,
  count(*) FILTER (effect = 'u') AS n_unresolved FROM orders LEFT JOIN effects ON claim_id = CAST(o_orderkey AS VARCHAR) GROUP BY 1)"""


def _support(spark, folder):
    return E.claim_support(
        *claims(spark, folder), ledger(spark, folder).distinct(), papers(spark, folder), runs(spark, folder), runs(spark, folder)
    )


@query("jn13_claim_support", f"WITH {_SUPPORT} SELECT * FROM support")
def jn13(spark, folder):
    return _support(spark, folder)


_FINDINGS = """j AS (SELECT e.*, p.verification FROM evid e LEFT JOIN papers p ON p.paper_id = e.source_id),
findings AS (SELECT 'error' AS severity, evidence_id AS subject, 'missing_source' AS code FROM j WHERE verification IS NULL
       UNION ALL SELECT 'error', evidence_id, 'direct_without_verified_locator' FROM j WHERE kind = 'direct-evidence' AND verification IS NOT NULL AND (verification <> 'verified' OR locator IS NULL)
       UNION ALL SELECT 'error', evidence_id, 'unmarked_assumption' FROM j WHERE kind = 'agent-inference' AND NOT assumed
       UNION ALL SELECT 'warning', paper_id, 'source_' || verification FROM papers WHERE verification <> 'verified')"""


@query(
    "ag19_classification",
    f"""WITH {_SUPPORT}, {_FINDINGS} SELECT *, CASE WHEN n_contradicting > 0 THEN 'conflicting' WHEN n_supporting > 0 AND n_unresolved = 0 AND NOT EXISTS (SELECT 1 FROM findings WHERE severity = 'error') THEN 'verified'
       WHEN n_supporting > 0 THEN 'partially supported' WHEN n_unresolved > 0 THEN 'unverifiable' ELSE 'unsupported' END AS classification FROM support""",
)
def ag19(spark, folder):
    return E.classify_claims(_support(spark, folder), E.source_contract(papers(spark, folder), ledger(spark, folder)))


@query(
    "jn14_source_contract",
    f"""WITH {SQL_EVIDENCE}, {_FINDINGS} SELECT * FROM findings""",
)
def jn14(spark, folder):
    return E.source_contract(papers(spark, folder), ledger(spark, folder))


@query(
    "ag12_identity_conflicts",
    """WITH ids AS (SELECT p_partkey AS k, 'title' AS kind, lower(regexp_replace(p_name, '\\W+', '', 'g')) AS key FROM part
         UNION ALL SELECT p_partkey, 'price', CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) FROM part
         UNION ALL SELECT p_partkey, 'doi', CASE WHEN p_size > 25 THEN lower(p_brand || '/' || p_size || '/' || p_type) END FROM part)
       SELECT kind, CAST(k AS VARCHAR) AS paper_id, CAST(p AS VARCHAR) AS previous_id FROM (
         SELECT kind, k, lag(k) OVER (PARTITION BY kind, key ORDER BY k) AS p FROM ids WHERE key IS NOT NULL) WHERE p IS NOT NULL""",
)
def ag12(spark, folder):
    part = table(spark, folder, "part").withColumn("paper_id", F.col("p_partkey").cast("string"))
    identities = {
        "title": title_key("p_name"),
        "price": F.round(F.col("p_retailprice") * 100).cast("long").cast("string"),
        "doi": F.when(F.col("p_size") > 25, F.lower(F.concat_ws("/", "p_brand", "p_size", "p_type"))),
    }
    return E.identity_conflicts(part, identities, "p_partkey")


@query(
    "pf12_evidence_matrix",
    f"""WITH {SQL_EVIDENCE} SELECT paper_id, title, verification, concat_ws('; ', title, CASE WHEN s_nationkey > 10 THEN 'far' END) AS limitations,
       verification = 'verified' AS citable FROM papers""",
)
def pf12(spark, folder):
    noted = papers(spark, folder).withColumn(
        "limitations", F.array_compact(F.array(F.col("title"), F.when(F.col("s_nationkey") > 10, "far")))
    )
    return E.evidence_matrix(noted, ["paper_id", "title", "verification"])


@query("ag19_self_reviews", "SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, 'seg-' || c_mktsegment AS author_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def self_reviews(spark, folder):
    authors = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("seg-"), "c_mktsegment").alias("author_id"))
    written = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("claim_id"), "o_custkey").join(authors, "o_custkey")
    return E.self_reviews(written, "seg-BUILDING")


@query(
    "jn14_inspections",
    """WITH a AS (SELECT 'pages/' || page_id || '.html' AS artifact, min(sha256(coalesce(html, ''))) AS found FROM pages GROUP BY 1),
    s AS (SELECT s_suppkey, s_nationkey || ':' || s_suppkey % 40 AS paper_id, 't' || s_suppkey // 3 AS title,
      CASE WHEN s_acctbal < 0 THEN 'inaccessible' WHEN s_acctbal < 2000 THEN 'unverified' ELSE 'verified' END AS verification,
      CASE s_suppkey % 4 WHEN 0 THEN 'abstract' WHEN 3 THEN 'metadata' ELSE 'full-text' END AS inspected,
      CASE WHEN s_suppkey % 7 > 0 THEN CASE WHEN s_suppkey % 11 = 0 THEN '../' ELSE '' END || 'pages/' || s_suppkey * 3 || '.html' END AS artifact FROM supplier),
    v AS (SELECT s.*, a.found, CASE WHEN s_suppkey % 5 = 0 THEN sha256(a.found) ELSE a.found END AS pin FROM s LEFT JOIN a USING (artifact) WHERE verification = 'verified'),
    f AS (SELECT paper_id, CASE WHEN inspected NOT IN ('full-text', 'abstract') OR artifact IS NULL THEN 'inspection_absent'
        WHEN found IS NULL THEN 'inspection_missing' WHEN found <> pin THEN 'inspection_mismatch' END AS code FROM v
      UNION ALL SELECT paper_id, CASE WHEN row_number() OVER (PARTITION BY paper_id ORDER BY s_suppkey) > 1 THEN 'duplicate_paper_id' END FROM s
      UNION ALL SELECT paper_id, CASE WHEN row_number() OVER (PARTITION BY title ORDER BY s_suppkey) > 1 THEN 'duplicate_title' END FROM s)
    SELECT 'error' AS severity, paper_id AS subject, code, count(*) AS n FROM f WHERE code IS NOT NULL GROUP BY ALL""",
)
def jn14_inspections(spark, folder):
    """Suppliers are papers that were inspected in pages; some pins are altered, some paths leave the root."""
    artifacts = table(spark, folder, "pages").select(
        F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("artifact"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256")
    )
    number, balance = F.col("s_suppkey"), F.col("s_acctbal")
    path = F.concat(F.when(number % 11 == 0, "../").otherwise(""), F.lit("pages/"), number * 3, F.lit(".html"))
    inspected = table(spark, folder, "supplier").select(
        "s_suppkey",
        F.concat_ws(":", "s_nationkey", number % 40).alias("paper_id"),
        F.concat(F.lit("t"), F.floor(number / 3)).alias("title"),
        F.when(balance < 0, "inaccessible").when(balance < 2000, "unverified").otherwise("verified").alias("verification"),
        F.when(number % 4 == 0, "abstract").when(number % 4 == 3, "metadata").otherwise("full-text").alias("inspected_content"),
        F.when(number % 7 > 0, path).alias("artifact"),
    )
    found = artifacts.groupBy("artifact").agg(F.min("sha256").alias("_pin"))
    pin = F.when(number % 5 == 0, F.sha2("_pin", 256)).otherwise(F.col("_pin")).alias("artifact_sha256")
    declared = inspected.join(found, "artifact", "left").select(*inspected.columns, pin)
    return E.inspection_findings(declared, artifacts, {"title": F.col("title")}, "s_suppkey")
