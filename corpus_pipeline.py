"""A training-data pipeline over `documents`: quality rules, near-dedup, secrets, mixing, tokens.

Every stage is a function (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the
next one's docs. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskeel.llm import bpe, mixing, near, quality, secrets
from corpuskeel.session import cut

# BPE has no SQL.
ORACLE_SQL = None


def whole_rows(docs: DataFrame, key: Column) -> DataFrame:
    """(_row, key): every document as one struct beside a key made of its columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id, and of its equal rows one.

    Rows of one id with different texts all stay if their group does. Rows without an id are compared with
    nothing but one another: of those with equal texts one stays.
    """
    gone = near.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = whole_rows(docs, F.struct(F.col("doc_id").alias("id"), content.alias("content")).alias("_k")).select("_row", F.col("_k.id").alias("_id"), F.col("_k.content").alias("_content"))
    kept = rows.join(gone, "_id", "left_anti")
    return kept.groupBy("_id", "_content").agg(F.first("_row").alias("_row")).select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret replaced by the name of its kind.

    A text meets its findings by content, so rows with null or repeated ids are masked like all others.
    The document travels as one struct: no column of its own can clash with those of the join.
    """
    _, ledger = secrets.scan(docs)
    kinds = [r.kind for r in secrets.RULES]
    hits = secrets.blob_spans(ledger).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    joined = whole_rows(docs, F.sha2(F.coalesce("text", F.lit("")), 256).alias("_blob")).join(hits, "_blob", "left")
    text, spans = F.col("_row.text"), F.col("_spans")
    clean = F.when(spans.isNull(), text).otherwise(secrets.masked(text, spans, kinds))
    size = F.when(spans.isNull(), F.col("_row.n_chars")).otherwise(F.char_length(clean).cast("long"))
    return joined.select([clean.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Rows that agree in source, id and text share what the mix takes of them: each gets an equal number of
    repetitions and the first ones, in the order of their other columns, one more.
    """
    taken = mixing.mix(docs).groupBy("source", "place").agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows")).filter("_sum > 0")
    taken = taken.select(F.col("source").alias("_source"), F.col("place").alias("_place"), "_sum", "_rows")
    rows = whole_rows(docs, mixing.seeded_place(mixing.SEED, "doc_id", "text").alias("_place"))
    met = rows.join(taken, (rows["_place"] == taken["_place"]) & F.col("_row.source").eqNullSafe(F.col("_source"))).drop(rows["_place"])
    single = met.filter("_rows = 1").select("_row", F.col("_sum").alias("_copies"))
    equal = Window.partitionBy("_source", "_place").orderBy("_order")
    several = met.filter("_rows > 1").withColumn("_order", F.to_json("_row")).withColumn("_i", F.row_number().over(equal))
    shared = F.expr("_sum div _rows + CASE WHEN _i <= _sum % _rows THEN 1 ELSE 0 END")
    whole = single.unionByName(several.select("_row", shared.alias("_copies"))).filter("_copies > 0")
    repeated = whole.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_i"))
    return repeated.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the token ids and of the decoded text of every row."""
    return bpe.encode_texts(docs, bpe.word_bpe())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
