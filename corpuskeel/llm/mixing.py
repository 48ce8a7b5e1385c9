"""Operator 4: mixing sources to target weights by capped water-filling.

Native: sizes, sums, targets and choices are DataFrame expressions. The driver sees one row of three
sums per round of the water-filling.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import WORD, narrow, query, table

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = "mix-1"

# Documents of a source that share a slot of the seeded order, on average; only the slot in which the
# fractional repetition ends is ordered document by document.
SLOT_ROWS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_place(seed: str, key: str, text: str) -> Column:
    """Place of a document in the seeded order: a digest of the seed, its key and its text."""
    content = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), content), 256)


def ranked_sources(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Add `weight`: the weights repeat along the sources in code-point order, null last.

    The order is cut into slices by the source's first bytes, so no task numbers all sources.
    """
    by_slice = sizes.withColumn("_slice", F.coalesce(F.hex(F.substring(F.encode("source", "utf-8"), 1, 2)), F.lit("~")))
    counts = by_slice.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # 65,537 rows at most
    inside = Window.partitionBy("_slice").orderBy("source")
    place = F.row_number().over(inside) - 1
    numbered = by_slice.withColumn("_row", place).join(offsets, "_slice")
    number = (F.col("_row") + F.col("_offset")) % len(weights)
    return numbered.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (number + 1).cast("int"))).drop(
        "_slice", "_row", "_offset"
    )


def water_level(sources: DataFrame, epochs: int) -> Fraction | None:
    """The level x at which the targets min(epochs * size, weight * x) use up the sum of all sizes.

    Every round clamps the sources above their cap and shares the rest by weight among the others; the
    level only rises, so the rounds end. None when there is nothing to share.
    """
    level: Fraction | None = None
    cap = (F.col("size") * epochs).cast("decimal(38,0)")
    weight = F.col("weight").cast("decimal(38,0)")
    while True:
        clamped = F.lit(False)
        if level is not None:
            # cap <= weight * level, in integers
            clamped = cap * F.lit(level.denominator).cast("decimal(38,0)") <= weight * F.lit(level.numerator).cast("decimal(38,0)")
        total, taken, free = sources.agg(
            F.sum("size"), F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~clamped, weight)), F.lit(0))
        ).first()
        if not total or not free:
            return level
        following = Fraction(int(total) - int(taken), int(free))
        if following == level:
            return level
        level = following


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(`key`, size, source_size, target, copies, taken, place, source): how often the mix takes every document.

    A source whose target is r times its size takes each document floor(r) times and, for the rest,
    once more the documents that come first in a seeded order until the target is reached; the last
    one counts in if that comes closer to the target. Whole documents are taken, so the words taken of
    a source miss its target by at most half of one document. No document is taken more than `epochs`
    times. The order depends on the seed, the key and the text only, so reruns agree.

    A null text has size 0, a null source is a source of its own, null keys are ordered by their text;
    documents that agree in key and text are ordered by nothing else and may stand for each other.
    A source of size 0 has target 0. Further columns are ignored; an empty table gives an empty one.
    """
    rows = narrow(documents, [key, text, source]).select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), seeded_place(seed, key, text).alias("place")
    )
    rows = cut(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    sources = cut(ranked_sources(sizes, weights), "mix-sources")
    level = water_level(sources, epochs) or Fraction(0)
    cap = (F.col("size") * epochs).cast("decimal(38,0)")
    share = F.col("weight").cast("decimal(38,0)") * F.lit(level.numerator).cast("decimal(38,0)")
    under = share < cap * F.lit(level.denominator).cast("decimal(38,0)")
    target = F.when(under, share.cast("double") / F.lit(float(level.denominator))).otherwise(cap.cast("double"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    hexdigits = max(1, min(5, math.ceil(math.log(max(rows.count(), 1) / SLOT_ROWS + 1, 16))))
    plan = sources.select(F.coalesce(F.col("source"), F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"), F.col("size").alias("source_size"), target.alias("target"))
    plan = plan.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))

    slot = rows.select(
        "id", "size", "place",
        F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"),
        F.substring("place", 1, hexdigits).alias("_slot"),
    )
    keys = ["_s", "_null"]
    filled = slot.groupBy(*keys, "_slot").agg(F.sum("size").alias("_in"))
    run = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # 16**5 rows at most
    spans = filled.withColumn("_before", F.coalesce(F.sum("_in").over(run), F.lit(0)))
    # A slot lies before, behind or across the end of its source's fractional repetition. Documents meet
    # their slot, not their source, so a source of any size is spread over its slots.
    ending = (F.col("_rest") > 0) & (F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_in"))
    early = (F.col("_rest") > 0) & (F.col("_before") + F.col("_in") <= F.col("_rest"))
    verdicts = spans.join(plan, keys).withColumn("_ending", ending).withColumn("_more", early.cast("long"))
    placed = slot.join(verdicts, [*keys, "_slot"])
    settled = placed.filter("NOT _ending")
    within = Window.partitionBy(*keys, "_slot").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ended = placed.filter("_ending").withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    ended = ended.withColumn("_more", (F.col("_at") + F.col("size") / 2 <= F.col("_rest")).cast("long")).drop("_at")
    copies = F.col("_whole") + F.col("_more")
    return settled.unionByName(ended).select(
        F.col("id").alias(key), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "place", F.when(~F.col("_null"), F.col("_s")).alias("source")
    )


SQL_MIX = r"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  sha256('mix-1' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || sha256(coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, sum(size) AS size, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
lvl AS (SELECT 0 AS step, CAST(0 AS HUGEINT) AS num, CAST(1 AS HUGEINT) AS den
  UNION ALL SELECT step + 1, n2, d2 FROM (SELECT l.step, l.num, l.den,
      (SELECT sum(size) - coalesce(sum(3 * size) FILTER (l.step > 0 AND 3 * size * l.den <= w * l.num), 0) FROM s) AS n2,
      (SELECT coalesce(sum(w) FILTER (NOT (l.step > 0 AND 3 * size * l.den <= w * l.num)), 0) FROM s) AS d2 FROM lvl l)
    WHERE d2 > 0 AND (step = 0 OR n2 * den <> num * d2)),
last AS (SELECT * FROM lvl ORDER BY step DESC LIMIT 1),
t AS (SELECT source, CAST(size AS BIGINT) AS source_size, CASE WHEN w * num < 3 * size * den THEN CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) ELSE CAST(3 * size AS DOUBLE) END AS target FROM s, last),
r AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
p AS (SELECT d.*, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, whole + CAST(pos + size / 2 <= rest AND rest > 0 AS BIGINT) AS copies FROM p)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c"""


@query("op4_mix", SQL_MIX)
def op4(spark, folder):
    return mix(table(spark, folder, "documents")).drop("place", "source")
