"""Queries: joins that compare (JN), set operations (SO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keys import text_group
from ..operators import dedup, evidence, graph, reconcile
from ..session import cut
from .q_rows import SQL_MANIFEST, manifest
from .registry import query, table
from .views import SQL_RECORDS, frame_tables, records, sql_fold, sql_text_group


@query(
    "jn1_total_join",
    """SELECT o_orderpriority, l_returnflag, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def jn1(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_returnflag", "l_quantity")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderpriority")
    joined = reconcile.total_join(lines, orders, ["orderkey"])
    return joined.groupBy("o_orderpriority", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "jn2_reconcile",
    """WITH a AS (SELECT o_orderkey AS orderkey, o_orderstatus AS status_code, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
       b AS (SELECT l_orderkey AS orderkey, CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'P' ELSE min(l_linestatus) END AS status_code,
             CAST(min(year(l_shipdate)) AS INTEGER) AS year FROM lineitem GROUP BY 1)
       SELECT orderkey, CASE WHEN b.status_code IS NULL THEN 'left_only' WHEN a.status_code IS NULL THEN 'right_only'
         WHEN a.status_code <> b.status_code OR a.year <> b.year THEN 'differs' ELSE 'match' END AS status,
         CASE WHEN a.status_code IS NOT NULL AND b.status_code IS NOT NULL THEN
           concat_ws(',', CASE WHEN a.status_code <> b.status_code THEN 'status_code' END, CASE WHEN a.year <> b.year THEN 'year' END) END AS differing
       FROM a FULL OUTER JOIN b USING (orderkey)""",
)
def jn2(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status_code"), F.year("o_orderdate").alias("year")
    )
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.when(F.min("l_linestatus") != F.max("l_linestatus"), "P").otherwise(F.min("l_linestatus")).alias("status_code"),
        F.min(F.year("l_shipdate")).alias("year"),
    )
    return reconcile.reconcile(orders, lines, ["orderkey"], ["status_code", "year"])


@query(
    "jn3_missing_unexpected",
    """SELECT s_suppkey AS key, 'missing' AS status FROM supplier WHERE s_suppkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)
       UNION ALL SELECT DISTINCT user_id, 'unexpected' FROM events WHERE event_type = 'signup' AND value > 100 AND user_id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def jn3(spark, folder):
    observed = table(spark, folder, "events").filter("event_type = 'signup' and value > 100")
    return reconcile.missing_and_unexpected(
        table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key")), observed.select(F.col("user_id").alias("key")), ["key"]
    )


@query(
    "jn4_members_only",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def jn4(spark, folder):
    allowed = table(spark, folder, "labels").filter("quality = 1")
    return reconcile.members_only(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), allowed, ["doc_id"])


@query(
    "jn5_dimension_lookup",
    """SELECT r_name, n_name, count(*) AS n_customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def jn5(spark, folder):
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dimension = nations.select(F.col("n_nationkey").alias("nationkey"), "n_name", "r_name")
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return reconcile.dimension_lookup(customers, dimension, ["nationkey"]).groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("n_customers")
    )


@query(
    "jn6_admission_join",
    f"""WITH r AS (SELECT doc_id, sha256(trim(text)) AS d FROM documents),
       m AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE n_chars >= 64),
       s AS (SELECT doc_id, sha256(text) AS d, CASE WHEN toxic = 1 THEN 'test' ELSE 'development' END AS split FROM documents JOIN labels USING (doc_id))
       SELECT r.doc_id, CASE WHEN m.d IS NULL THEN 'not_in_manifest' WHEN s.d IS NULL THEN 'not_in_splits'
         WHEN m.d <> r.d OR s.d <> r.d THEN 'digest_differs' WHEN split <> 'development' THEN 'wrong_split' ELSE 'admitted' END AS verdict
       FROM r LEFT JOIN m USING (doc_id) LEFT JOIN s USING (doc_id)""",
)
def jn6(spark, folder):
    documents = table(spark, folder, "documents")
    digest = F.sha2("text", 256).alias("raw_sha256")
    splits = documents.select("doc_id", digest).join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id", "raw_sha256", F.when(F.col("toxic") == 1, "test").otherwise("development").alias("split")
    )
    return reconcile.admission_join(
        documents.filter("n_chars >= 64").select("doc_id", digest),
        splits,
        documents.select("doc_id", F.sha2(F.trim("text"), 256).alias("raw_sha256")),
        ["doc_id"], "raw_sha256", "development",
    )


_BITS = ", ".join(
    f"sum(CASE WHEN ({'lo' if b < 32 else 'hi'} >> {b % 32}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(64)
)
_HALF = lambda start: " + ".join(f"CASE WHEN b{start + b} > 0 THEN {1 << b} ELSE 0 END" for b in range(32))
# The near rule of the frame: fingerprints, aspect and colours of passing rows; equal rows form one class.
SQL_FINGERPRINTS = f"""words AS (SELECT doc_id, n_chars, unnest(string_split({sql_fold('text')}, ' ')) AS word FROM documents WHERE n_chars >= 64),
hashed AS (SELECT doc_id, n_chars, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) AS hi, CAST(('0x' || substr(md5(word), 9, 8)) AS BIGINT) AS lo FROM words),
bits AS (SELECT doc_id, n_chars, {_BITS} FROM hashed GROUP BY 1, 2),
shares AS (SELECT doc_id, hi % {K.COLOUR_BYTES} AS k, count(*) AS c FROM hashed GROUP BY 1, 2),
colours AS (SELECT doc_id, list(CAST(least(255, coalesce(c, 0) * 4080 // t) AS INTEGER) ORDER BY k) AS colour
  FROM (SELECT doc_id, t, range AS k FROM (SELECT doc_id, sum(c) AS t FROM shares GROUP BY 1), range({K.COLOUR_BYTES})) LEFT JOIN shares USING (doc_id, k) GROUP BY 1),
prints AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS width, CAST({_HALF(32)} AS BIGINT) AS fhi, CAST({_HALF(0)} AS BIGINT) AS flo, colour FROM bits JOIN colours USING (doc_id)),
classes AS (SELECT fhi, flo, width, colour, min(id) AS id, count(*) AS n_rows FROM prints GROUP BY 1, 2, 3, 4),
near AS (SELECT a.id AS left_id, b.id AS right_id, a.n_rows AS n_left, b.n_rows AS n_right,
    CAST(bit_count(xor(a.fhi, b.fhi)) AS INTEGER) + CAST(bit_count(xor(a.flo, b.flo)) AS INTEGER) AS distance
  FROM classes a JOIN classes b ON a.id < b.id AND 100 * abs(a.width - b.width) <= {K.NEAR_ASPECT_PERCENT} * greatest(a.width, b.width)
    AND CAST(bit_count(xor(a.fhi, b.fhi)) AS INTEGER) + CAST(bit_count(xor(a.flo, b.flo)) AS INTEGER) <= {K.NEAR_HAMMING}
  WHERE list_sum(list_transform(list_zip(a.colour, b.colour), lambda z: abs(z[1] - z[2]))) <= {K.NEAR_COLOUR_MAE * K.COLOUR_BYTES})"""


@query("jn7_near_pairs", f"WITH {SQL_FINGERPRINTS} SELECT left_id, right_id, n_left, n_right, distance FROM near")
def jn7(spark, folder):
    rows, colours = frame_tables(spark, folder)
    return graph.near_links(cut(graph.near_classes(rows), "classes"), colours)


@query(
    "jn8_scenario_cases",
    """SELECT doc_id, s AS scenario, doc_id || '::' || s AS case_id FROM documents, (VALUES ('repeat'), ('recompressed'), ('different')) t(s)""",
)
def jn8(spark, folder):
    return reconcile.scenario_cases(table(spark, folder, "documents").select("doc_id"), "doc_id", ["repeat", "recompressed", "different"])


@query(
    "jn9_ring_pairs",
    """SELECT c_nationkey AS domain, c_custkey AS item, coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER w) AS paired_item
       FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""",
)
def jn9(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("domain"), F.col("c_custkey").alias("item"))
    return reconcile.ring_pairs(customers, "domain", "item")


_LOCK = "SELECT source || '/' || doc_id AS path, n_chars AS bytes, sha256(text) AS sha256 FROM documents"
_ACTUAL = """SELECT source || '/' || doc_id AS path, n_chars + CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS bytes,
  CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(lower(text)) END AS sha256 FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'bench/' || item_id, length(text), sha256(text) FROM benchmark"""
_COMPARED = f"""lock AS ({_LOCK}), actual AS ({_ACTUAL}), compared AS (
  SELECT path, CASE WHEN a.sha256 IS NULL THEN 'missing' WHEN l.sha256 IS NULL THEN 'unlisted' WHEN a.bytes <> l.bytes THEN 'size_mismatch'
    WHEN a.sha256 <> l.sha256 THEN 'digest_mismatch' ELSE 'match' END AS status FROM lock l FULL OUTER JOIN actual a USING (path))"""


def _compared(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    path = F.concat_ws("/", "source", "doc_id").alias("path")
    lock = documents.select(path, F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    # Digests first: only narrow rows meet the labels.
    digests = documents.select(
        "doc_id", path, "n_chars", F.sha2("text", 256).alias("_as_is"), F.sha2(F.lower("text"), 256).alias("_lowered")
    )
    kept = digests.join(labels, "doc_id").select(
        "path",
        (F.col("n_chars") + F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bytes"),
        F.when(F.col("quality") == 1, F.col("_as_is")).otherwise(F.col("_lowered")).alias("sha256"),
    )
    extra = table(spark, folder, "benchmark").select(
        F.concat_ws("/", F.lit("bench"), "item_id").alias("path"), F.char_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256")
    )
    return reconcile.lock_comparison(lock, kept.unionByName(extra))


@query("jn10_lock_comparison", f"WITH {_COMPARED} SELECT path, status FROM compared")
def jn10(spark, folder):
    return _compared(spark, folder)


@query(
    "jn10_package_verdicts",
    f"""WITH {_COMPARED} SELECT string_split(path, '/')[1] AS package, count(*) AS n_files, count(*) FILTER (status <> 'match') AS n_failed,
       CASE WHEN count(*) FILTER (status <> 'match') = 0 THEN 'payload-match' ELSE 'payload-mismatch' END AS verdict FROM compared GROUP BY 1""",
)
def jn10_packages(spark, folder):
    return reconcile.package_verdicts(_compared(spark, folder), F.split("path", "/")[0])


@query(
    "jn11_candidate_audit",
    """WITH installed AS (SELECT DISTINCT p_brand AS name, p_size AS version FROM part WHERE p_type <> 'PROMO'),
       offers AS (SELECT DISTINCT p_brand AS name, p_size AS version, md5(p_name) AS d FROM part WHERE p_type <> 'SMALL'),
       pins AS (SELECT p_brand AS name, p_size AS version, min(md5(p_name)) AS d FROM part WHERE p_type IN ('SMALL', 'PROMO') GROUP BY 1, 2),
       counted AS (SELECT name, version, count(*) AS n FROM offers GROUP BY 1, 2),
       pinned AS (SELECT p.name, p.version, o.d IS NOT NULL AS ok FROM pins p LEFT JOIN offers o USING (name, version, d)),
       keys AS (SELECT coalesce(i.name, p.name) AS name, coalesce(i.version, p.version) AS version, i.name IS NOT NULL AS inst, p.name IS NOT NULL AS pin, p.ok
         FROM installed i FULL OUTER JOIN pinned p ON i.name = p.name AND i.version = p.version)
       SELECT name, version, coalesce(n, 0) AS n_candidates, CASE WHEN pin AND NOT inst THEN 'not-installed' WHEN pin AND NOT ok THEN 'locked-digest-missing'
         WHEN n IS NULL THEN 'no-candidate' WHEN n > 1 THEN 'several-candidates' ELSE 'single-candidate' END AS status
       FROM keys LEFT JOIN counted USING (name, version)""",
)
def jn11(spark, folder):
    part = table(spark, folder, "part").select(
        F.col("p_brand").alias("name"), F.col("p_size").alias("version"), F.md5("p_name").alias("digest"), "p_type"
    )
    locked = part.filter(F.col("p_type").isin("SMALL", "PROMO")).groupBy("name", "version").agg(F.min("digest").alias("digest"))
    return reconcile.candidate_audit(
        part.filter("p_type <> 'PROMO'"), part.filter("p_type <> 'SMALL'"), locked, ["name", "version"], "digest"
    )


@query(
    "jn12_approval_check",
    """WITH v AS (SELECT o_orderkey AS run_id, max(CASE WHEN l_orderkey IS NULL THEN 0
           WHEN md5(l_linestatus) <> md5(o_orderstatus) THEN 1
           WHEN NOT (l_shipdate - INTERVAL 60 DAY <= o_orderdate + INTERVAL 30 DAY AND o_orderdate + INTERVAL 30 DAY < l_shipdate + INTERVAL 60 DAY) THEN 2
           WHEN l_returnflag = 'R' THEN 3 WHEN 20 > l_quantity OR o_totalprice / 8 > l_extendedprice THEN 4 ELSE 5 END) AS lv
         FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
       SELECT run_id, ['no_approval', 'digest_mismatch', 'outside_window', 'not_approved', 'budget_exceeded', 'approved'][lv + 1] AS verdict FROM v""",
)
def jn12(spark, folder):
    runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.md5("o_orderstatus").alias("manifest"), F.lit(20.0).alias("max_seconds"),
        (F.col("o_totalprice") / 8).alias("max_usd"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("now"),
    )
    approvals = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.md5("l_linestatus").alias("manifest"),
        (F.col("l_shipdate") - F.expr("INTERVAL 60 DAYS")).alias("issued_at"),
        (F.col("l_shipdate") + F.expr("INTERVAL 60 DAYS")).alias("expires_at"),
        F.when(F.col("l_returnflag") == "R", "reject").otherwise("approve").alias("decision"),
        F.col("l_quantity").alias("max_seconds"), F.col("l_extendedprice").alias("max_usd"),
    )
    return reconcile.approval_check(runs, approvals, ["run_id"], "manifest", F.col("now"))


@query(
    "jn15_appended_only",
    """SELECT c_custkey AS custkey, CASE WHEN NOT has THEN 'removed' ELSE 'changed' END AS status
       FROM (SELECT c_custkey, c_acctbal, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer) WHERE NOT has OR c_acctbal < 0""",
)
def jn15(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment", "c_acctbal")
    active = table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"))
    later = customers.join(active, "custkey", "left_semi").withColumn(
        "c_mktsegment", F.when(F.col("c_acctbal") < 0, "CLOSED").otherwise(F.col("c_mktsegment"))
    )
    return reconcile.appended_only(customers, later, ["custkey"], ["c_mktsegment"])


@query("so1_union_inventories", f"WITH {SQL_RECORDS} SELECT * FROM records")
def so1(spark, folder):
    whole = records(spark, folder)
    return dedup.union_inventories(whole.filter("domain <> 'bench'"), whole.filter("domain = 'bench'"))


@query(
    "so2_key_difference",
    f"""WITH a AS (SELECT DISTINCT {sql_text_group('text')} AS g FROM documents), b AS (SELECT DISTINCT {sql_text_group('text')} AS g FROM benchmark)
       SELECT g, 'left' AS side FROM a WHERE g NOT IN (SELECT g FROM b) UNION ALL SELECT g, 'right' FROM b WHERE g NOT IN (SELECT g FROM a)""",
)
def so2(spark, folder):
    groups = [table(spark, folder, n).select(text_group("text").alias("g")) for n in ("documents", "benchmark")]
    return reconcile.key_set_difference(*groups, ["g"])


@query(
    "so3_ordered_union",
    """WITH e AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS element, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
       f AS (SELECT conv_id, element, min(turn * 1000000 + i) AS spot FROM e GROUP BY 1, 2)
       SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS "index", element FROM f""",
)
def so3(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    return evidence.ordered_union(turns, ["conv_id"], "turn", "words")


@query(
    "so4_group_intersection",
    f"""SELECT {sql_text_group('text')} AS text_group, count(*) AS n_selected FROM documents
       WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1""",
)
def so4(spark, folder):
    members = table(spark, folder, "documents").select("doc_id", text_group("text").alias("text_group"))
    kept = reconcile.members_only(members, table(spark, folder, "labels"), ["doc_id"], subset=False)
    return kept.groupBy("text_group").agg(F.count(F.lit(1)).alias("n_selected"))


@query("sl1_total_order", f"WITH {SQL_MANIFEST} SELECT domain, source_split, source_id, raw_sha256 FROM manifest ORDER BY 1, 2, 3")
def sl1(spark, folder):
    return manifest(spark, folder).select("domain", "source_split", "source_id", "raw_sha256")


@query(
    "sl2_first_examples",
    f"""WITH {_COMPARED}, f AS (SELECT string_split(path, '/')[1] AS package, path, status FROM compared WHERE status <> 'match')
       SELECT package, path, status, CAST(row_number() OVER (PARTITION BY package ORDER BY path) AS INTEGER) AS position FROM f
       QUALIFY row_number() OVER (PARTITION BY package ORDER BY path) <= 10""",
)
def sl2(spark, folder):
    from ..operators.checks import first_examples

    failed = _compared(spark, folder).filter("status <> 'match'").withColumn("package", F.split("path", "/")[0])
    return first_examples(failed, ["package"], ["path"], 10)
