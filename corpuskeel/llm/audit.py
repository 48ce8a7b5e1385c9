"""Operator 13: interaction audit of filters by the potential of Hart and Mas-Colell.

Every document gets the set of filters it fails. A coalition of filters removes the documents that fail any
of its members; that count is the worth v of the coalition in the removal game, one game per part. Potentials
follow recursively over the coalitions, P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, and the share
of a filter is P(all) - P(all without it). Applied in some order, a filter removes v(before with it) - v(before),
so all orders and steps are differences of the same few numbers.

Only counts per (part, failed set) leave the scan; they are summed map-side, so a part that holds most of the
documents costs no more than any other. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_per_key
from ..session import cut
from .common import narrow, query, table

SPLIT = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "#$%&*|"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text (null counts as empty); none of them is ever null."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, SPLIT), lambda w: w != "")
    n, size = F.size(words), F.char_length(whole)
    without = lambda letters: size - F.char_length(F.translate(whole, letters, ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * without(CAPITALS) > 5 * size,
        "D": without(SIGNS) > 0,
    }


def failed_set(conditions: Mapping[str, Column]) -> Column:
    """Bit i is set if the i-th condition holds."""
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())]
    return reduce(lambda a, b: a + b, bits)


def repeats_smaller_id(rows: DataFrame, key: str, content: str) -> DataFrame:
    """`rows` with `repeats`: some row of smaller `key` has the same `content`.

    Rows without a key repeat nothing and are repeated by none. Of each content that several rows share one
    row travels; a content that a third of all rows share is met by broadcast of the few such contents.
    """
    first = rows.groupBy(content).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    met = join_per_key(rows, first, [content], "_rows")
    return met.withColumn("repeats", F.coalesce(F.col(key) > F.col("_first"), F.lit(False))).drop("_first", "_rows")


def interaction_report(counts: DataFrame, filters: str, totals: Mapping[str, str]) -> DataFrame:
    """The audit of `counts` (part, failed, and the count columns named in `totals`).

    `filters` holds one letter per bit of `failed`. One row per part, order of the filters and step, zeros
    included. `totals` names the column of all documents ("all") and those of further classes of documents,
    whose losses are reported as <class>_lost.
    """
    n = len(filters)
    states = 1 << n
    full = states - 1
    classes = list(totals)
    # Documents per failed set, then the worth of every coalition: documents that fail any member.
    per_set = [F.sum(F.when(F.col("failed") == m, F.col(c)).otherwise(0)).cast("long") for c in totals.values() for m in range(states)]
    wide = counts.groupBy("part").agg(F.array(*per_set).alias("_n"))
    coalitions = F.sequence(F.lit(0), F.lit(full))

    def worth(offset: int) -> Column:
        hit = lambda s: F.aggregate(
            coalitions, F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(s.bitwiseAND(m) > 0, F.get("_n", m + offset)).otherwise(0)
        )
        return F.transform(coalitions, hit)

    games = wide.select(
        "part",
        F.aggregate(F.slice("_n", 1, states), F.lit(0).cast("long"), lambda a, x: a + x).alias("_total"),
        F.slice("_n", 1, states).alias("_sets"),
        *[worth(k * states).alias(f"_v_{c}") for k, c in enumerate(classes)],
    )
    # Potentials as multiples of 1/scale, which is the least common denominator of all of them.
    scale = lcm(*range(1, n + 1))

    def potential(known: Column, s: Column) -> Column:
        below = [F.when(s.bitwiseAND(F.lit(1 << i)) > 0, F.get(known, s - (1 << i))).otherwise(0) for i in range(n)]
        total = F.get("_v_all", s) * scale + reduce(lambda a, b: a + b, below)
        return F.concat(known, F.array((total / F.bit_count(s)).cast("long")))

    start = F.array(F.lit(0).cast("long"))
    games = games.withColumn("_p", F.aggregate(F.sequence(F.lit(1), F.lit(full)), start, potential))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    bit = reduce(lambda a, i: a.when(letter == filters[i], 1 << i), range(1, n), F.when(letter == filters[0], 1))
    place = lambda x: F.instr(F.col("filter_order"), F.lit(x))
    before = reduce(lambda a, b: a + b, [F.when(place(x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(filters)])
    steps = steps.withColumn("_bit", bit).withColumn("_before", before)
    with_it = F.col("_before").bitwiseOR(F.col("_bit"))
    gain = lambda c: F.get(f"_v_{c}", with_it) - F.get(f"_v_{c}", "_before")
    rest = F.lit(full) - F.col("_bit")
    share = (F.get("_p", F.lit(full)) - F.get("_p", rest)) * (factorial(n) // scale)
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("_total") - F.get("_v_all", with_it)).alias("kept"),
        gain("all").alias("removed"),
        (F.get("_v_all", "_bit") - gain("all")).alias("redundant"),
        F.get("_sets", "_bit").alias("unique_fails"),
        *[gain(c).alias(f"{c}_lost") for c in classes if c != "all"],
        share.cast("long").alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit of the filters A to E over whole documents, one part per source.

    A null text counts as empty, a null source as the empty string. Rows without doc_id never fail E and make
    none fail it. Repeated rows count each; of repeated labels of a document the largest holds, null labels
    count as 0. Further columns are ignored; an empty table gives an empty report.
    """
    docs = narrow(documents, ["doc_id", "text", "source"])
    slim = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"),
        failed_set(text_filters(F.col("text"))).alias("failed"),
    )
    marks = (
        narrow(labels, ["doc_id", "quality", "toxic"])
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    # The texts are read once; three joins follow on ids and digests only.
    slim = cut(slim, "filter-audit")
    judged = repeats_smaller_id(slim, "doc_id", "content").join(marks, "doc_id", "left")
    one = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = judged.groupBy("part", (F.col("failed") + F.when(F.col("repeats"), 16).otherwise(0)).alias("failed")).agg(
        F.count(F.lit(1)).alias("n"), one("good").alias("good"), one("toxic").alias("toxic")
    )
    return interaction_report(counts, "ABCDE", {"all": "n", "good": "good", "toxic": "toxic"})


_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
stats AS (SELECT doc_id, part, {_WORDS} AS words, length(text) AS size, text, min(doc_id) OVER (PARTITION BY text) AS first_id FROM docs),
bits AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * size,
   regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM stats LEFT JOIN marks USING (doc_id)),
orders AS (SELECT a || b || c || d || e AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) u(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(b),
  (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) w(c), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(d), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) y(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5),
classes AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY 1, 2),
steps AS (SELECT *, ascii(filter_order[step]) - 64 AS f, list_transform(string_split(filter_order[:step - 1], ''), lambda x: ascii(x) - 64) AS earlier
  FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step)),
walked AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS own,
  len(list_filter(earlier, lambda i: i > 0 AND fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS single FROM steps, classes),
sums AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT own AND NOT gone) AS kept, sum(n) FILTER (own AND NOT gone) AS removed,
  sum(n) FILTER (own AND gone) AS redundant, sum(n) FILTER (own AND single) AS unique_fails,
  sum(good) FILTER (own AND NOT gone) AS good_lost, sum(toxic) FILTER (own AND NOT gone) AS toxic_lost FROM walked GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums"""


@query("op13_filter_audit", SQL)
def op13(spark, folder):
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
