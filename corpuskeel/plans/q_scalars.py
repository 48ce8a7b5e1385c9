"""Queries: scalar functions (SF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import bounds as B
from ..functions import codes as C
from ..functions import keys as X
from ..operators.skew import exact_quantiles
from .registry import query, spread_table, table
from .views import sql_bounds, sql_digest, sql_fold, sql_text_digest, sql_text_group, sql_uint

DIMENSION = 64
_ZERO_SEED = bytes(32)


@query("sf1_text_group", f"SELECT doc_id, {sql_fold('text')} AS folded, {sql_text_group('text')} AS prompt_group FROM documents")
def sf1(spark, folder):
    return spread_table(spark, folder, "documents", "doc_id").select(
        "doc_id", X.folded_text("text").alias("folded"), X.text_group("text").alias("prompt_group")
    )


@query("sf2_tagged_digest", f"SELECT page_id, {sql_text_digest('example-tag', 'html')} AS digest FROM pages")
def sf2(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.text_digest("example-tag", "html").alias("digest"))


def _pack_sql(*blobs: str) -> str:
    return " || ".join(f"{sql_uint(f'octet_length({b})', 4)} || {b}" for b in blobs)


@query("sf3_pack_fields", f"SELECT page_id, lower(hex({_pack_sql('encode(url)', 'encode(html)')})) AS packed_hex FROM pages")
def sf3(spark, folder):
    packed = X.pack_fields(X.as_bytes("url"), X.as_bytes("html"))
    return table(spark, folder, "pages").select("page_id", F.lower(F.hex(packed)).alias("packed_hex"))


def _uid64_sql(tag: str, uid: str) -> str:
    digest = sql_digest(tag, _pack_sql(f"encode({uid})"))
    return f"(CAST(('0x' || substr({digest}, 1, 8)) AS HUGEINT) * 4294967296 + CAST(('0x' || substr({digest}, 9, 8)) AS HUGEINT))"


_UID = "source || ':' || doc_id"


@query(
    "sf4_bucket_and_seed",
    f"""SELECT {_UID} AS uid, CAST({_uid64_sql(K.TAG_OWNER_BUCKET, _UID)} % 16 AS INTEGER) AS bucket,
       CAST(({_uid64_sql(K.TAG_OWNER_BUCKET, _UID)} + 1) % 16 AS INTEGER) AS wrong_bucket,
       CAST({_uid64_sql(K.TAG_SEED, _UID)} AS VARCHAR) AS seed FROM documents""",
)
def sf4(spark, folder):
    return table(spark, folder, "documents").select(F.concat_ws(":", "source", "doc_id").alias("uid")).select(
        "uid",
        X.owner_bucket("uid").alias("bucket"),
        X.wrong_owner_bucket("uid").alias("wrong_bucket"),
        X.uid_seed("uid").cast("string").alias("seed"),
    )


@query(
    "sf5_canonical_owner",
    """SELECT page_id, CASE WHEN octet_length(encode(nfc_normalize(html))) BETWEEN 1 AND 256 THEN nfc_normalize(html) END AS long_owner,
       CASE WHEN octet_length(encode(nfc_normalize(url))) BETWEEN 1 AND 256 THEN nfc_normalize(url) END AS owner FROM pages""",
)
def sf5(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", X.canonical_owner("html").alias("long_owner"), X.canonical_owner("url").alias("owner")
    )


_Q = f"({sql_uint('doc_id % 256', 1)} || {sql_uint('(doc_id // 256) % 16', 1)})"
_H = f"unhex(substr(sha256(text), 1, 8))"


@query(
    "sf6_signatures",
    f"""SELECT doc_id, sha256({_pack_sql(f"'{K.TAG_SIGNATURE_SEMANTIC}'::BLOB", _Q, 'encode(source)')}) AS ws,
       sha256({_pack_sql(f"'{K.TAG_SIGNATURE_INSTANCE}'::BLOB", _Q, _H, 'encode(source)')}) AS wi, source <> lang AS differs FROM documents""",
)
def sf6(spark, folder):
    q = F.concat(X.uint_be(F.col("doc_id") % 256, 1), X.uint_be(F.floor(F.col("doc_id") / 256) % 16, 1))
    h = F.unhex(F.substring(F.sha2("text", 256), 1, 8))
    return table(spark, folder, "documents").select(
        "doc_id",
        X.semantic_signature(q, "source").alias("ws"),
        X.instance_signature(q, h, "source").alias("wi"),
        X.owners_differ("source", "lang").alias("differs"),
    )


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query(
    "sf7_vector_check",
    f"""SELECT vec_id, CASE WHEN len(embedding) <> {DIMENSION} THEN 'dimension' WHEN abs({_NORM} - 1) > 1e-5 THEN 'not_unit_norm' END AS violation,
       CASE WHEN len(embedding) <> 512 THEN 'dimension' END AS violation_512 FROM embeddings""",
)
def sf7(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id",
        C.vector_violation("embedding", DIMENSION).alias("violation"),
        C.vector_violation("embedding", 512).alias("violation_512"),
    )


_SIGNS = C.sign_table(K.SEMANTIC_BITS, DIMENSION, _ZERO_SEED)


def _projection_sql(row: int) -> str:
    signs = "[" + ",".join(str(int(s)) for s in _SIGNS[row]) + "]"
    return f"list_sum(list_transform(list_zip(embedding, {signs}), lambda p: CAST(p[1] AS DOUBLE) * p[2] * {1 / DIMENSION**0.5}))"


SQL_CODES = "codes AS (SELECT vec_id, label, embedding, " + " + ".join(
    f"CASE WHEN {_projection_sql(r)} >= 0 THEN {1 << r} ELSE 0 END" for r in range(K.SEMANTIC_BITS)
) + " AS code FROM embeddings)"


@query("sf8_sign_code", f"WITH {SQL_CODES} SELECT vec_id, code FROM codes")
def sf8(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", C.sign_projection("embedding", DIMENSION).getField("code").alias("code")
    )


_HEX_DISTANCE = " + ".join(
    f"CAST(bit_count(xor(CAST(('0x' || substr(a.key_hex, {i}, 8)) AS BIGINT), CAST(('0x' || substr(b.key_hex, {i}, 8)) AS BIGINT))) AS INTEGER)"
    for i in range(1, 65, 8)
)


@query(
    "sf9_distances",
    f"""WITH {SQL_CODES}, k AS (SELECT *, sha256(CAST(code AS VARCHAR)) AS key_hex FROM codes)
       SELECT a.vec_id, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS feature_distance,
         CAST(bit_count(xor(a.code, b.code)) AS INTEGER) AS code_distance, CAST({_HEX_DISTANCE} AS INTEGER) AS key_distance
       FROM k a JOIN k b ON b.vec_id = a.vec_id + 1""",
)
def sf9(spark, folder):
    coded = table(spark, folder, "embeddings").select(
        "vec_id", "embedding", C.sign_projection("embedding", DIMENSION).getField("code").alias("code")
    ).withColumn("key_hex", F.sha2(F.col("code").cast("string"), 256))
    other = coded.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"), F.col("code").alias("c2"), F.col("key_hex").alias("k2")
    )
    return coded.join(other, "vec_id").select(
        "vec_id",
        F.round(1 - C.dot("embedding", "e2"), 6).alias("feature_distance"),
        C.code_distance(F.col("code"), F.col("c2")).cast("int").alias("code_distance"),
        C.hex_distance("key_hex", "k2").cast("int").alias("key_distance"),
    )


@query(
    "sf10_radius_one",
    f"""WITH {SQL_CODES} SELECT vec_id, CAST(o AS INTEGER) AS ordinal, CAST(CASE WHEN o = 0 THEN code ELSE xor(code, (1 << CAST(o - 1 AS INTEGER))) END AS BIGINT) AS candidate
       FROM codes, range({K.SEMANTIC_BITS + 1}) t(o)""",
)
def sf10(spark, folder):
    coded = table(spark, folder, "embeddings").select(
        "vec_id", C.sign_projection("embedding", DIMENSION).getField("code").alias("code")
    )
    return coded.select("vec_id", F.posexplode(C.radius_one("code", K.SEMANTIC_BITS)).alias("ordinal", "candidate"))


@query(
    "sf11_cell_bounds",
    f"""SELECT source, lang, count(*) AS n, round({B.Z_95} / (2 * sqrt(count(*) + {B.Z_95 * B.Z_95})), 6) AS wilson,
       round(1 - exp(ln(0.05) / count(*)), 6) AS zero_upper, count(*) >= 299 AS resolves FROM documents GROUP BY 1, 2""",
)
def sf11(spark, folder):
    cells = table(spark, folder, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return cells.select(
        "source", "lang", "n",
        F.round(B.wilson_half_width("n"), 6).alias("wilson"),
        F.round(B.zero_failure_upper("n"), 6).alias("zero_upper"),
        B.resolves_one_percent("n").alias("resolves"),
    )


@query(
    "sf12_exact_bounds",
    f"""WITH RECURSIVE cells AS (SELECT source, lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS x FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
       {sql_bounds('cells', 'source, lang')} SELECT source, lang, n, x, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound FROM bounds""",
)
def sf12(spark, folder):
    cells = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("x")
    )
    return cells.select(
        "source", "lang", "n", "x",
        F.round(B.exact_one_sided("x", "n", lower=True), 6).alias("lower_bound"),
        F.round(B.exact_one_sided("x", "n", lower=False), 6).alias("upper_bound"),
    )


@query(
    "sf13_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS middle,
       round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1""",
)
def sf13(spark, folder):
    found = exact_quantiles(table(spark, folder, "events"), ["event_type"], "value", {"low": 0.025, "middle": 0.5, "high": 0.975})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


@query(
    "sf14_redaction",
    f"""SELECT doc_id, redacted, redacted <> text AS changed FROM (SELECT doc_id, text,
       regexp_replace(regexp_replace(text, '{K.BEARER_PATTERN}', '\\1[REDACTED]', 'g'), '{K.ASSIGNMENT_PATTERN}', '\\1[REDACTED]', 'g') AS redacted FROM documents)""",
)
def sf14(spark, folder):
    documents = spread_table(spark, folder, "documents", "doc_id")
    return documents.select("doc_id", "text", X.redacted("text").alias("redacted")).select(
        "doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed")
    )


@query(
    "sf15_canonical_forms",
    """SELECT page_id, regexp_extract(url, '^https?://', 0) || lower(regexp_extract(url, '^https?://([^/?#]*)', 1))
         || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')
         || regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1) AS canonical_url,
       replace(lower(regexp_replace(html, '[^\\p{L}\\p{N}_]+', '', 'g')), 'ß', 'ss') AS title_key,
       lower(regexp_replace(string_split(url, '/')[3], '[-_.]+', '-', 'g')) AS package FROM pages""",
)
def sf15(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        X.canonical_url("url").alias("canonical_url"),
        X.title_key("html").alias("title_key"),
        X.package_name(F.split("url", "/")[2]).alias("package"),
    )


@query(
    "sf17_uid_round_trip",
    """SELECT lang || ':' || source || ':' || doc_id AS uid, lang AS domain, source AS release, CAST(doc_id AS VARCHAR) AS item FROM documents""",
)
def sf17(spark, folder):
    uids = table(spark, folder, "documents").select(X.source_uid("lang", "source", "doc_id").alias("uid"))
    return uids.select("uid", *X.split_uid("uid", "domain", "release", "item"))
