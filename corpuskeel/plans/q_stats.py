"""Queries: summaries and comparisons (AG1, AG2, AG7-AG9, AG17, AG18, DX2-DX4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import text_group
from ..operators import stats
from ..session import cut
from .registry import query, table
from .views import sql_text_group


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("ag1_counts", "SELECT source, lang, count(*) AS n_rows FROM documents GROUP BY 1, 2")
def ag1(spark, folder):
    return table(spark, folder, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "ag2_exact_distinct",
    f"SELECT lang, count(DISTINCT sha256(text)) AS n_texts, count(DISTINCT {sql_text_group('text')}) AS n_groups FROM documents GROUP BY 1",
)
def ag2(spark, folder):
    keyed = table(spark, folder, "documents").select("lang", F.sha2("text", 256).alias("d"), text_group("text").alias("g"))
    return keyed.groupBy("lang").agg(F.count_distinct("d").alias("n_texts"), F.count_distinct("g").alias("n_groups"))


_SUMMARY = """count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd,
  round(min(value), 6) AS min, round(max(value), 6) AS max"""


@query("ag7_describe", f"SELECT event_type, {_SUMMARY} FROM events GROUP BY 1")
def ag7(spark, folder):
    return _rounded(stats.describe(table(spark, folder, "events"), ["event_type"], "value"), "mean", "median", "sd", "min", "max")


@query(
    "ag8_histogram_map",
    """SELECT role, string_agg(v || '=' || n, ',' ORDER BY v) AS histogram FROM (
       SELECT role, len(string_split(text, ' ')) AS v, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1""",
)
def ag8(spark, folder):
    sized = table(spark, folder, "conversations").select("role", F.size(F.split("text", " ")).alias("v"))
    shown = F.transform(F.map_entries("histogram"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return stats.histogram_map(sized, ["role"], "v").select("role", F.array_join(shown, ",").alias("histogram"))


@query(
    "ag9_summary_levels",
    f"""SELECT event_type, CAST(user_id % 3 AS BIGINT) AS domain, CAST(grouping(user_id % 3) AS INTEGER) AS is_total, {_SUMMARY} FROM events
       GROUP BY GROUPING SETS ((event_type), (event_type, user_id % 3))""",
)
def ag9(spark, folder):
    events = table(spark, folder, "events").select("event_type", (F.col("user_id") % 3).alias("domain"), "value")
    return _rounded(stats.describe_levels(events, "event_type", "domain", "value"), "mean", "median", "sd", "min", "max")


_MEANS = """means AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2),
pairs AS (SELECT a.user_id, b.v - a.v AS difference FROM means a JOIN means b USING (user_id) WHERE a.event_type = 'view' AND b.event_type = 'click')"""


def _differences(spark, folder):
    means = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return stats.paired_differences(means, "user_id", "event_type", "v", "view", "click")


@query(
    "ag17_paired_effect",
    f"""WITH {_MEANS} SELECT count(*) AS n, round(avg(difference), 6) AS mean_difference,
       round(avg(difference) / stddev_samp(difference), 6) AS cohens_dz FROM pairs""",
)
def ag17(spark, folder):
    return _rounded(stats.paired_effect(_differences(spark, folder)), "mean_difference", "cohens_dz")


def _boot_sql(units: str, samples: int, seed: int) -> str:
    """`units` (unit, total, weight) resampled by Poisson multiplicities from md5(seed:unit:sample div 4)."""
    times = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in stats.POISSON_CUTS)
    return f"""draws AS (SELECT s.s AS sample, total, weight, CAST(('0x' || substr(md5('{seed}:' || u.unit || ':' || s.s // 4), 1 + 8 * (s.s % 4), 8)) AS BIGINT) AS u
  FROM {units} u, (SELECT CAST(range AS BIGINT) AS s FROM range({samples})) s),
boot AS (SELECT sample, sum(({times}) * total) / nullif(sum(({times}) * weight), 0) AS estimate FROM draws GROUP BY 1)"""


_PAIRED = f"{_MEANS}, units AS (SELECT user_id AS unit, difference AS total, 1.0::DOUBLE AS weight FROM pairs), {_boot_sql('units', 200, 7)}"


@query(
    "ag18_paired_bootstrap",
    f"""WITH {_PAIRED} SELECT (SELECT count(*) FROM units) AS n, round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high, false AS withheld FROM boot""",
)
def ag18(spark, folder):
    differences = cut(_differences(spark, folder), "differences")
    return _rounded(stats.paired_bootstrap(differences, "user_id", 200, 7, complete=True), "low", "high")


@query(
    "ag18_withheld_bootstrap",
    f"""WITH {_PAIRED}, seen AS (SELECT (SELECT count(*) FROM units) AS n, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT unit FROM units)) AS n_missing)
       SELECT n, CASE WHEN n_missing = 0 THEN round((SELECT quantile_cont(estimate, 0.025) FROM boot), 6) END AS low,
         CASE WHEN n_missing = 0 THEN round((SELECT quantile_cont(estimate, 0.975) FROM boot), 6) END AS high, n_missing > 0 AS withheld FROM seen""",
)
def ag18_withheld(spark, folder):
    """Every customer is expected to have a pair: with one missing, the interval is withheld."""
    differences = cut(_differences(spark, folder), "differences")
    expected = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    complete = expected.join(differences, "user_id", "left_anti").isEmpty()
    return _rounded(stats.paired_bootstrap(differences, "user_id", 200, 7, complete), "low", "high")


@query(
    "ag18_run_states",
    """WITH e AS (SELECT c_custkey, 'r' || c_custkey AS run_id, c_custkey AS seed FROM customer),
       o AS (SELECT 'r' || user_id AS run_id, count(*) AS n, any_value(user_id) AS seed, min(CASE WHEN value < 0 THEN 'failed' ELSE 'completed' END) AS s FROM events
         WHERE event_type = 'signup' GROUP BY 1)
       SELECT run_id, CASE WHEN e.seed IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE s END AS state
       FROM e FULL OUTER JOIN o USING (run_id)""",
)
def ag18_states(spark, folder):
    run = lambda c: F.concat(F.lit("r"), c).alias("run_id")
    expected = table(spark, folder, "customer").select(run("c_custkey"), F.col("c_custkey").alias("seed"), F.lit("signup").alias("condition"))
    observed = table(spark, folder, "events").filter("event_type = 'signup'").select(
        run("user_id"), F.col("user_id").alias("seed"), F.col("event_type").alias("condition"),
        F.when(F.col("value") < 0, "failed").otherwise("completed").alias("status"),
    )
    return stats.run_states(expected, observed)


def _draws_sql(units: str, samples: int, seed: int) -> str:
    """`units` (position, total, weight) resampled by md5(seed:sample:slot) mod n, n draws each."""
    return f"""n AS (SELECT count(*) AS n FROM {units}),
draws AS (SELECT s.s AS sample, CAST(('0x' || substr(md5('{seed}:' || s.s || ':' || u.position), 1, 12)) AS BIGINT) % n.n AS position
  FROM {units} u, range({samples}) s(s), n),
boot AS (SELECT d.sample, sum(u.total) / sum(u.weight) AS estimate FROM draws d JOIN {units} u USING (position) GROUP BY 1)"""


@query(
    "dx2_clustered_bootstrap",
    f"""WITH g AS (SELECT user_id, sum(value) AS total, count(value)::DOUBLE AS weight FROM events GROUP BY 1),
       units AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS position, total, weight FROM g), {_draws_sql('units', 200, 11)}
       SELECT round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high FROM boot""",
)
def dx2(spark, folder):
    return _rounded(stats.clustered_bootstrap(table(spark, folder, "events"), "user_id", "value", 200, 11), "low", "high")


@query(
    "dx3_holm",
    """WITH p AS (SELECT lang, source, count(*)::DOUBLE / 1000 / (1 + max(n_chars)) AS p FROM documents GROUP BY 1, 2),
       s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY lang) - row_number() OVER (PARTITION BY lang ORDER BY p, source) + 1) * p) AS step FROM p)
       SELECT lang, source, round(p, 9) AS p, round(max(step) OVER (PARTITION BY lang ORDER BY p, source), 9) AS adjusted FROM s""",
)
def dx3(spark, folder):
    tests = table(spark, folder, "documents").groupBy("lang", "source").agg(
        (F.count(F.lit(1)).cast("double") / 1000 / (1 + F.max("n_chars"))).alias("p")
    )
    return stats.holm(tests, ["lang"], "p").select("lang", "source", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"))


@query(
    "dx4_quality_profile",
    """WITH v AS (SELECT event_type, CASE WHEN value >= 5 THEN value END AS v FROM events)
       SELECT event_type, count(*) AS attempted, count(v) AS valid, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1,
         round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max, count(*) FILTER (v > 35) AS passes,
         round(count(*) FILTER (v > 35) / count(*), 6) AS full_share, round(count(*) FILTER (v > 35) / count(v), 6) AS valid_share
       FROM v GROUP BY 1""",
)
def dx4(spark, folder):
    measured = table(spark, folder, "events").select("event_type", F.when(F.col("value") >= 5, F.col("value")).alias("v"))
    profile = stats.quality_profile(measured, ["event_type"], "v", F.col("v") > 35)
    return _rounded(profile, "min", "q1", "median", "q3", "max", "full_share", "valid_share")
