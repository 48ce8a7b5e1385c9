"""Queries: pixel tables (IM1, IM4, AG14). The pixel table is the bytes of every whole document."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import detect
from ..operators import images as I
from .registry import query, spread_table
from .views import sql_digest, sql_uint

WIDTH = 64
_HEIGHT = f"greatest(32, CAST(ceil(octet_length(encode(text)) / {3 * WIDTH}.0) AS INTEGER))"
SQL_PIXELS = f"""pixels AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_HEIGHT} AS height,
  encode(text) || repeat('\\x00'::BLOB, {3 * WIDTH} * {_HEIGHT} - octet_length(encode(text))) AS rgb FROM documents)"""


def pixels(spark, folder):
    return I.pixels_of_text(spread_table(spark, folder, "documents", "doc_id"), "doc_id", "text", WIDTH)


@query("im1_pixel_digest", f"WITH {SQL_PIXELS} SELECT id, {sql_digest(K.TAG_PIXELS, sql_uint(str(WIDTH), 4), sql_uint('height', 4), 'rgb')} AS pixel_sha256 FROM pixels")
def im1(spark, folder):
    return pixels(spark, folder).select("id", I.pixel_digest().alias("pixel_sha256"))


# Pixels as rows, luminance, and the orthonormal 8x8 cosine sums of the eight frequencies. Blocks at
# the lower edge repeat the last line of pixels.
_FREQUENCIES = [("semantic", i, u, v) for i, (u, v) in enumerate(K.SEMANTIC_FREQUENCIES)] + [
    ("instance", i, u, v) for i, (u, v) in enumerate(K.INSTANCE_FREQUENCIES)
]
_COSINE = "0.25 * cos(pi() * (y % 8 + 0.5) * f.u / 8) * cos(pi() * (x % 8 + 0.5) * f.v / 8)"
SQL_COEFFICIENTS = f"""{SQL_PIXELS}, b AS (SELECT id, height, regexp_extract_all(hex(rgb), '..') AS h FROM pixels),
px AS (SELECT id, x, y, least(y, height - 1) * {WIDTH} + x AS p, h FROM b, range({WIDTH}) a(x), LATERAL (SELECT unnest(range((height + 7) // 8 * 8)) AS y)),
luma AS (SELECT id, x, y, (0.299 * CAST('0x' || h[3 * p + 1] AS INTEGER) + 0.587 * CAST('0x' || h[3 * p + 2] AS INTEGER) + 0.114 * CAST('0x' || h[3 * p + 3] AS INTEGER)) / 255 AS l FROM px),
f AS (SELECT * FROM (VALUES {', '.join(str(t) for t in _FREQUENCIES)}) t(component, frequency, u, v)),
coef AS (SELECT id, CAST((y // 8) * {WIDTH // 8} + x // 8 AS INTEGER) AS block, component, frequency, sum(l * {_COSINE}) AS value FROM luma, f GROUP BY 1, 2, 3, 4)"""


@query(
    "im4_block_coefficients",
    f"WITH {SQL_COEFFICIENTS} SELECT id, component, frequency, count(*) AS n_blocks, round(sum(value), 5) AS total, round(sum(value * value), 5) AS energy FROM coef GROUP BY 1, 2, 3",
)
def im4(spark, folder):
    return I.block_coefficients(pixels(spark, folder)).groupBy("id", "component", "frequency").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.round(F.sum("value"), 5).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 5).alias("energy")
    )


@query(
    "ag14_centred_cosine",
    f"""WITH {SQL_COEFFICIENTS}, s AS (SELECT *, CASE WHEN ascii(md5(block || ':' || frequency)) % 2 = 0 THEN 1.0 ELSE -1.0 END AS t FROM coef),
       m AS (SELECT *, value - avg(value) OVER w AS cv, t - avg(t) OVER w AS ct FROM s WINDOW w AS (PARTITION BY id, component, frequency))
       SELECT id, component, round(sum(cv * ct) / sqrt(sum(cv * cv) * sum(ct * ct)), 5) AS score, false AS zero_variance FROM m GROUP BY 1, 2""",
)
def ag14(spark, folder):
    sign = F.when(F.ascii(F.md5(F.concat_ws(":", "block", "frequency"))) % 2 == 0, 1).otherwise(-1)
    blocks = I.block_coefficients(pixels(spark, folder)).withColumn("sign", sign)
    return detect.centred_cosine(blocks, ["id", "component"], "frequency", "value", "sign").withColumn("score", F.round("score", 5))
