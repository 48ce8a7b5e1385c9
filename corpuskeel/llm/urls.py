"""Operator 3: URL filters by a temporal list join.

Native. Dated list entries (add, remove) become validity intervals; a capture is evaluated against the
intervals that were open when it was fetched (an as-of join). Intervals are cut at months, so the join
is an equi-join on (pattern, month) with a range test: a pattern that a third of all captures fall
under is spread over the months, and adaptive execution splits what is still large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, query, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
FIRST_FOLDER = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def patterns_of(url: Column) -> Column:
    """The patterns that a URL falls under: its host, every parent domain of two labels or more, and
    host/first-folder. As many as the host has labels, all lower-case; none for a URL without host."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    folder = F.lower(F.regexp_extract(url, FIRST_FOLDER, 1))
    path = F.when(folder != "", F.array(F.concat_ws("/", host, folder))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(F.concat(parents, path))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until): the days [since, until) on which an entry is active; `until` null: open.

    `entries` has list, pattern, day, action ('add' or 'remove') and seq. Of several entries of a list and
    pattern on one day the last seq decides ('remove' on a tie). After that a key has one row per day at
    most, so the window over it is bounded by the calendar, whatever the number of entries. Entries with
    a null pattern, day or list take no part.
    """
    daily = (
        narrow(entries, ["list", "pattern", "day", "action", "seq"])
        .filter("list IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
        .groupBy("list", "pattern", "day")
        .agg(F.max(F.struct("seq", "action"))["action"].alias("action"))
    )
    series = Window.partitionBy("list", "pattern").orderBy("day")
    return (
        daily.withColumn("until", F.lead("day").over(series))
        .filter(F.col("action") == "add")
        .select("list", "pattern", F.col("day").alias("since"), "until")
    )


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """`captures` with active_lists (sorted, comma-joined), n_active and blocked.

    A capture without URL, host or fetch day matches nothing and is not blocked. Repeated rows stay
    repeated; the capture's other columns pass through under any name, but those three are replaced. An empty
    table on either side gives no matches.
    """
    asked = narrow(captures, [url, fetched]).toDF("_url", "_day").filter("_url IS NOT NULL AND _day IS NOT NULL").distinct()
    under = asked.select("_url", "_day", F.explode(patterns_of(F.col("_url"))).alias("pattern")).withColumn("_month", F.trunc("_day", "month"))
    # An open interval is cut at the last fetch day: one value, known after one pass over the days.
    last = asked.agg(F.max("_day")).first()[0]
    spans = intervals(entries).withColumn("_to", F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date")))
    monthly = spans.filter("since <= _to").select(
        "list", "pattern", "since", "_to",
        F.explode(F.sequence(F.trunc("since", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))).alias("_month"),
    )
    hits = (
        under.join(monthly, ["pattern", "_month"])
        .filter((F.col("since") <= F.col("_day")) & (F.col("_day") <= F.col("_to")))
        .groupBy("_url", "_day", "list")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("_url", "_day")
        .agg(F.array_join(F.array_sort(F.collect_list("list")), ",").alias("_lists"), F.sum("_n").alias("_n"))
    )
    # A capture travels as one struct: no column of its own can clash with those of the join.
    rest = [c for c in captures.columns if c.lower() not in ("active_lists", "n_active", "blocked")]
    whole = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")
    rows = captures.select(whole, F.struct(F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("day")).alias("_k"))
    joined = rows.select("_row", F.col("_k.url").alias("_url"), F.col("_k.day").alias("_day")).join(hits, ["_url", "_day"], "left")
    return joined.select(
        *[F.col(f"_row.`{c}`") for c in rest],
        F.coalesce("_lists", F.lit("")).alias("active_lists"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_active"),
        F.col("_n").isNotNull().alias("blocked"),
    )


# The pages come without fetch days and lists. Both are derived from them by digests, over all rows:
# a page is fetched on a day of two years, and half of the patterns have entries in one of three lists.
START, DAYS = "2023-01-01", 730
LISTS = ("ads", "malware", "spam")


def _number(text: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, 7), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.lit(START).cast("date"), (F.col("page_id") * 37 % DAYS).cast("int")).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Entries for half of the patterns of the pages: added, removed later, and half of those added again."""
    pattern = pages.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).distinct()
    p = F.col("pattern")
    first = F.date_add(F.lit(START).cast("date"), _number(p, "add") % DAYS)
    removed = F.date_add(first, 1 + _number(p, "remove") % 200)
    again = F.date_add(removed, _number(p, "again") % 100)
    entry = lambda day, action, seq: F.struct(day.alias("day"), F.lit(action).alias("action"), F.lit(seq).alias("seq"))
    series = F.concat(
        F.array(entry(first, "add", 1), entry(removed, "remove", 2)),
        F.when(_number(p, "twice") % 2 == 0, F.array(entry(again, "add", 3))).otherwise(F.array().cast("array<struct<day:date,action:string,seq:int>>")),
    )
    name = F.element_at(F.array(*[F.lit(x) for x in LISTS]), _number(p, "list") % 3 + 1)
    chosen = pattern.filter(_number(p, "in") % 2 == 0)
    return chosen.select(name.alias("list"), "pattern", F.explode(series).alias("e")).select("list", "pattern", "e.*")


def _sql_number(salt: str) -> str:
    return f"CAST('0x' || substr(md5('{salt}' || pattern), 1, 7) AS INTEGER)"


SQL_URLS = rf"""WITH h AS (SELECT page_id, url, CAST(DATE '{START}' + CAST(page_id * 37 % {DAYS} AS INTEGER) AS DATE) AS fetched, lower(regexp_extract(url, '{HOST}', 1)) AS host,
  lower(regexp_extract(url, '{FIRST_FOLDER}', 1)) AS folder FROM pages),
u AS (SELECT *, string_split(host, '.') AS l FROM h WHERE host <> ''),
pat AS (SELECT url, unnest(list_distinct(list_concat(list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.')),
  CASE WHEN folder <> '' THEN [host || '/' || folder] ELSE [] END))) AS pattern FROM u),
c AS (SELECT DISTINCT pattern FROM pat WHERE {_sql_number('in')} % 2 = 0),
d AS (SELECT pattern, ['ads', 'malware', 'spam'][{_sql_number('list')} % 3 + 1] AS list, CAST(DATE '{START}' + {_sql_number('add')} % {DAYS} AS DATE) AS first,
  1 + {_sql_number('remove')} % 200 AS gap, {_sql_number('again')} % 100 AS pause, {_sql_number('twice')} % 2 = 0 AS twice FROM c),
e AS (SELECT list, pattern, first AS day, 'add' AS action, 1 AS seq FROM d UNION ALL SELECT list, pattern, first + gap, 'remove', 2 FROM d
  UNION ALL SELECT list, pattern, first + gap + pause, 'add', 3 FROM d WHERE twice),
o AS (SELECT list, pattern, day, arg_max(action, seq) AS action FROM e GROUP BY ALL),
i AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM o),
hit AS (SELECT h.url, h.fetched, i.list FROM (SELECT DISTINCT url, fetched FROM h) h JOIN (SELECT DISTINCT * FROM pat) p USING (url) JOIN i ON i.pattern = p.pattern AND i.action = 'add' AND i.day <= h.fetched AND (i.until IS NULL OR h.fetched < i.until)),
v AS (SELECT url, fetched, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n FROM hit GROUP BY ALL)
SELECT h.page_id, h.url, h.fetched, coalesce(v.lists, '') AS active_lists, coalesce(v.n, 0) AS n_active, v.n IS NOT NULL AS blocked FROM h LEFT JOIN v USING (url, fetched)"""


@query("op3_urls", SQL_URLS)
def op3(spark, folder):
    pages = table(spark, folder, "pages")
    return evaluate(page_captures(pages), page_entries(pages))
