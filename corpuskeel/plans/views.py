"""Readings of the given tables in the roles the operators expect, and the same readings in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.codes import text_prints
from ..functions.keys import folded_text, tagged_digest, text_digest, text_group, uint_be
from ..operators.skew import shuffled
from ..session import cut
from .registry import spread_table, table

# --- SQL fragments ----------------------------------------------------------------------------


def sql_digest(tag: str, *blobs: str) -> str:
    return f"sha256({' || '.join([repr(tag) + '::BLOB', chr(39) + chr(92) + 'x00' + chr(39) + '::BLOB', *blobs])})"


def sql_text_digest(tag: str, text: str) -> str:
    return sql_digest(tag, f"encode({text})")


def sql_uint(value: str, width: int) -> str:
    return f"unhex(printf('%0{2 * width}x', CAST({value} AS BIGINT)))"


def sql_fold(text: str) -> str:
    """Folded text; the only letter of the data whose casefold is not its lower case is ß."""
    return f"nullif(trim(regexp_replace(replace(lower(nfc_normalize({text})), 'ß', 'ss'), '\\s+', ' ', 'g')), '')"


def sql_text_group(text: str) -> str:
    return sql_text_digest(K.TAG_TEXT_GROUP, sql_fold(text))


def sql_revision_rank(tag: str, key: str) -> str:
    return sql_digest(tag, f"unhex('{K.SOURCE_REVISION}')", key)


def sql_hex_int(text: str) -> str:
    """Hex digits (at most 15) as a BIGINT."""
    return f"CAST(('0x' || {text}) AS BIGINT)"


def sql_bounds(cells: str, keys: str) -> str:
    """Exact one-sided bounds of `cells` (keys, x, n) by the same 53 bisections, as a recursive query."""
    parts = []
    for name, lower in (("lower_bound", True), ("upper_bound", False)):
        ks = "range(x, n + 1)" if lower else "range(0, x + 1)"
        tail = f"""least(1.0, list_sum(list_transform({ks}, lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
          + k * ln(mid) + (n - k) * ln(1 - mid)))))"""
        up = f"(tail < {K.ONE_SIDED_ALPHA}) = {str(lower).lower()}"
        parts.append(f"""walk_{name} AS (SELECT {keys}, x, n, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM {cells}
          UNION ALL SELECT {keys}, x, n, step + 1, CASE WHEN {up} THEN mid ELSE lo END, CASE WHEN {up} THEN hi ELSE mid END
          FROM (SELECT *, {tail} AS tail FROM (SELECT *, (lo + hi) / 2 AS mid FROM walk_{name} WHERE step < 53)))""")
    edge = f"CASE WHEN x = 0 THEN 0.0 WHEN x = n THEN {K.ONE_SIDED_ALPHA} ** (1.0 / n) ELSE (lo + hi) / 2 END"
    edge2 = f"CASE WHEN x = n THEN 1.0 WHEN x = 0 THEN 1 - {K.ONE_SIDED_ALPHA} ** (1.0 / n) ELSE (lo + hi) / 2 END"
    return ", ".join(parts) + f""", bounds AS (SELECT {keys}, x, n, a.b AS lower_bound, c.b AS upper_bound FROM
      (SELECT {keys}, x, n, {edge} AS b FROM walk_lower_bound WHERE step = 53) a JOIN (SELECT {keys}, {edge2} AS b FROM walk_upper_bound WHERE step = 53) c USING ({keys}))"""


# --- metadata ---------------------------------------------------------------------------------

SQL_META = """meta AS (
  SELECT d.doc_id, CAST(substr(d.source, 4) AS INTEGER) + 1 AS part_id, CAST(d.doc_id AS VARCHAR) AS image_name,
         d.text AS prompt, d.n_chars AS width, d.n_chars AS height,
         CASE WHEN l.toxic = 1 THEN 1.0 WHEN l.toxic = 0 THEN 0.0 END AS image_nsfw,
         CASE WHEN l.quality = 1 THEN 0.0 WHEN l.quality = 0 THEN 0.2 END AS prompt_nsfw
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def metadata(spark: SparkSession, folder: str, prompt: Column | None = None) -> DataFrame:
    """documents with their labels as the metadata table: part = source, size = characters.

    `prompt` is what a query needs of the text (its group, its presence). It is taken at the scan, so that
    texts stay out of the shuffle to the labels; without it the column is null.
    """
    documents, labels = spread_table(spark, folder, "documents", "doc_id"), table(spark, folder, "labels")
    prompt = F.lit(None).cast("string") if prompt is None else prompt
    narrow = documents.select("doc_id", "source", "n_chars", prompt.alias("prompt"))
    return narrow.join(labels, "doc_id", "left").select(
        "doc_id",
        (F.substring("source", 4, 10).cast("int") + 1).alias("part_id"),
        F.col("doc_id").cast("string").alias("image_name"),
        "prompt",
        F.col("n_chars").alias("width"),
        F.col("n_chars").alias("height"),
        F.when(F.col("toxic") == 1, 1.0).when(F.col("toxic") == 0, 0.0).alias("image_nsfw"),
        F.when(F.col("quality") == 1, 0.0).when(F.col("quality") == 0, 0.2).alias("prompt_nsfw"),
    )


SQL_RECORDS = """records AS (
  SELECT source || ':' || doc_id AS id, source AS domain, sha256(text) AS sha256, octet_length(encode(text)) AS bytes,
         n_chars AS width, n_chars AS height FROM documents
  UNION ALL
  SELECT 'bench:' || item_id, 'bench', sha256(text), octet_length(encode(text)), length(text), length(text) FROM benchmark)"""


def records(spark: SparkSession, folder: str) -> DataFrame:
    """documents and benchmark as two inventories in the common record view."""
    documents, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    one = documents.select(
        F.concat_ws(":", "source", "doc_id").alias("id"),
        F.col("source").alias("domain"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.col("n_chars").alias("width"),
        F.col("n_chars").alias("height"),
    )
    two = benchmark.select(
        F.concat_ws(":", F.lit("bench"), "item_id").alias("id"),
        F.lit("bench").alias("domain"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.char_length("text").cast("long").alias("width"),
        F.char_length("text").cast("long").alias("height"),
    )
    return one.unionByName(two)


SQL_NODES = f"""nodes AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, sha256(d.text) AS raw_sha256,
         CASE WHEN d.n_chars >= 64 THEN '{K.STATUS_PASS}' ELSE '{K.STATUS_REJECT}' END AS status,
         CASE WHEN d.n_chars >= 64 THEN sha256(trim(d.text)) END AS canonical_pixel_sha256,
         {sql_text_group('d.text')} AS prompt_group,
         {sql_digest(K.TAG_TEXT_SEED, 'unhex(' + sql_text_group('d.text') + ')', sql_uint('d.n_chars', 4))} AS prompt_seed_group,
         CASE WHEN l.toxic = 1 THEN NULL ELSE {sql_text_digest(K.TAG_PRODUCER, "d.source || ':' || d.n_chars")} END AS producer_group,
         CASE WHEN l.toxic = 1 THEN '{K.STATUS_UNKNOWN_PRODUCER}' ELSE '{K.STATUS_KNOWN_PRODUCER}' END AS producer_status,
         d.lang AS domain, d.n_chars
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def node_digests(documents: DataFrame, *more: str) -> DataFrame:
    """All that the frame needs of a document's text; the text itself stays at the scan."""
    return documents.withColumn("prompt_group", text_group("text")).select(
        "doc_id",
        F.sha2("text", 256).alias("raw_sha256"),
        F.when(F.col("n_chars") >= 64, F.sha2(F.trim("text"), 256)).alias("canonical_pixel_sha256"),
        "prompt_group",
        F.concat_ws(":", "source", "n_chars").alias("_producer"),
        "lang",
        "source",
        "n_chars",
        *more,
    )


def labelled_nodes(digests: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """Rows of the leakage frame; toxic ones have no known producer. `more` names further columns to keep."""
    unknown = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return digests.join(shuffled(labels), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        "raw_sha256",
        F.when(F.col("n_chars") >= 64, K.STATUS_PASS).otherwise(K.STATUS_REJECT).alias("status"),
        "canonical_pixel_sha256",
        "prompt_group",
        tagged_digest(K.TAG_TEXT_SEED, F.unhex("prompt_group"), uint_be("n_chars", 4)).alias("prompt_seed_group"),
        F.when(~unknown, text_digest(K.TAG_PRODUCER, F.col("_producer"))).alias("producer_group"),
        F.when(unknown, K.STATUS_UNKNOWN_PRODUCER).otherwise(K.STATUS_KNOWN_PRODUCER).alias("producer_status"),
        F.col("lang").alias("domain"),
        "n_chars",
        *more,
    )


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """documents as rows of the leakage frame."""
    return labelled_nodes(node_digests(spread_table(spark, folder, "documents", "doc_id")), table(spark, folder, "labels"))


def frame_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, colours): the leakage frame with the columns of the near rule, from one scan of the texts.

    Texts without words keep a null fingerprint and are near to nothing.
    """
    documents = spread_table(spark, folder, "documents", "doc_id")
    prints = documents.select("*", text_prints(folded_text("text")).alias("_p"))
    digests = node_digests(prints, "_p.fp", "_p.tone", "_p.shade", "_p.colour")
    digests = cut(digests.withColumns({"width": F.col("n_chars"), "height": F.lit(1).cast("long")}), "digests")
    narrow = digests.drop("colour")
    rows = labelled_nodes(narrow, table(spark, folder, "labels"), "quality", "toxic", "source", "fp", "tone", "shade", "width", "height")
    return cut(rows, "frame"), digests.select(F.col("doc_id").cast("string").alias("id"), "colour")


# --- scores -----------------------------------------------------------------------------------

_CONDITIONS = (K.POSITIVE_CONDITION, *K.NEGATIVE_CONDITIONS)
ABSENT_ABOVE = 0.42

_BASE = "16 * c.ci + 4 * k.q"
SQL_SCORES = f"""conds AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_CONDITIONS))}) t(ci, condition)),
roster AS (SELECT 'D' || (label % 3) AS domain, CAST(vec_id AS VARCHAR) AS uid, embedding FROM embeddings),
observed AS (SELECT r.domain, r.uid, c.condition FROM roster r, conds c WHERE CAST(r.embedding[16 * c.ci + 1] AS DOUBLE) <= {ABSENT_ABOVE}),
scores AS (
  SELECT r.domain, r.uid, c.condition, CAST(k.q AS BIGINT) AS q,
    CASE WHEN CAST(embedding[{_BASE} + 3] AS DOUBLE) > 0.2 THEN NULL ELSE
      greatest(-1.0, least(1.0, CAST(embedding[{_BASE} + 1] AS DOUBLE) + CASE WHEN c.ci = 0 THEN 0.5 ELSE 0.0 END)) END AS s,
    CASE WHEN CAST(embedding[{_BASE} + 4] AS DOUBLE) > 0.25 THEN NULL ELSE
      greatest(-1.0, least(1.0, CAST(embedding[{_BASE} + 2] AS DOUBLE) + CASE WHEN c.ci = 0 THEN 0.5 ELSE 0.0 END)) END AS i
  FROM roster r, conds c, (VALUES (0), (1), (2), (3)) k(q)
  WHERE CAST(r.embedding[16 * c.ci + 1] AS DOUBLE) <= {ABSENT_ABOVE})"""


def scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roster, observed, scores) read from embeddings: four conditions, four candidates each."""
    vectors = table(spark, folder, "embeddings")
    base = vectors.select(
        F.concat(F.lit("D"), F.col("label") % 3).alias("domain"), F.col("vec_id").cast("string").alias("uid"), "embedding"
    )
    long = base.withColumn("ci", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    at = lambda offset: F.element_at("embedding", offset).cast("double")
    names = F.array(*[F.lit(c) for c in _CONDITIONS])
    present = long.filter(at(F.col("ci") * 16 + 1) <= ABSENT_ABOVE).withColumn("condition", F.element_at(names, F.col("ci") + 1))
    candidates = present.withColumn("q", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    place = F.col("ci") * 16 + F.col("q") * 4
    lift = F.when(F.col("ci") == 0, 0.5).otherwise(0.0)

    def clipped(offset: int, veto: int, limit: float):
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at(place + offset) + lift))
        return F.when(at(place + veto) <= limit, value)

    table_ = candidates.select(
        "domain", "uid", "condition", F.col("q").cast("long").alias("q"), clipped(1, 3, 0.2).alias("s"), clipped(2, 4, 0.25).alias("i")
    )
    return base.select("domain", "uid"), present.select("domain", "uid", "condition"), table_


# --- journal ----------------------------------------------------------------------------------

SQL_JOURNAL = """journal AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, event_id AS seq,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS status,
         CASE WHEN value > 400 THEN 'other' ELSE 'planned' END AS identity FROM events),
planned AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, 'planned' AS identity FROM customer)"""


def as_journal(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("progress").alias("status"),
        F.when(F.col("value") > 400, "other").otherwise("planned").alias("identity"),
    )


def planned_cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"), F.lit("planned").alias("identity")
    )


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """events as a file stream."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
