"""Queries: journals in batch and as streams (ST). `events` is the journal, `customer` the plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.reconcile import reconcile
from ..streaming import journal as J
from .registry import query, table
from .views import SQL_JOURNAL, as_journal, event_stream, planned_cases

_REPLAY = """folded AS (SELECT case_id, arg_min(status, seq) FILTER (status IN ('completed', 'failed')) AS ended,
  count(*) FILTER (status IN ('completed', 'failed')) AS n_terminal, count(*) FILTER (status NOT IN ('completed', 'failed')) AS n_other,
  bool_or(identity <> 'planned') AS rewritten FROM journal GROUP BY 1),
states AS (SELECT p.case_id, coalesce(ended, 'pending') AS state, CAST(greatest(coalesce(n_terminal, 0) - 1, 0) AS BIGINT) AS n_repeated,
  coalesce(n_other, 0) AS n_nonterminal, coalesce(rewritten, false) AS rewritten FROM planned p LEFT JOIN folded f USING (case_id))"""


def _states(spark, folder):
    return J.replay(planned_cases(spark, folder), as_journal(table(spark, folder, "events")))


@query("st1_replay", f"WITH {SQL_JOURNAL}, {_REPLAY} SELECT * FROM states")
def st1(spark, folder):
    return _states(spark, folder)


@query(
    "st1_unknown_cases",
    "SELECT CAST(user_id AS VARCHAR) AS case_id, count(*) AS n_events FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
)
def st1_unknown(spark, folder):
    planned = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("case_id"))
    return J.unknown_cases(planned, as_journal(table(spark, folder, "events")))


# Suppliers as the plan: many users of the journal are not among them, so unexpected cases occur.
_STREAMED = """small AS (SELECT CAST(s_suppkey AS VARCHAR) AS case_id FROM supplier),
streamed AS (SELECT case_id, coalesce(ended, 'pending') AS state, CAST(greatest(coalesce(n_terminal, 0) - 1, 0) AS BIGINT) AS n_repeated, coalesce(n_other, 0) AS n_nonterminal,
  coalesce(rewritten, false) AND case_id IN (SELECT case_id FROM small) AS rewritten, case_id NOT IN (SELECT case_id FROM small) AS unexpected
  FROM small FULL OUTER JOIN folded USING (case_id))"""


def _streamed(spark, folder):
    planned = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("case_id"), F.lit("planned").alias("identity"))
    return J.stream_replay(planned, as_journal(event_stream(spark, folder)))


@query("st1_stream_replay", f"WITH {SQL_JOURNAL}, {_REPLAY}, {_STREAMED} SELECT * FROM streamed")
def st1_stream(spark, folder):
    return _streamed(spark, folder)


@query(
    "st2_snapshot",
    f"""WITH {SQL_JOURNAL}, {_REPLAY}, r AS (SELECT c_mktsegment AS run, s.state FROM states s JOIN customer ON case_id = CAST(c_custkey AS VARCHAR)),
       n AS (SELECT run, count(*) FILTER (state = 'pending') AS n_pending, count(*) FILTER (state = 'completed') AS n_completed, count(*) FILTER (state = 'failed') AS n_failed FROM r GROUP BY 1)
       SELECT *, CASE WHEN n_pending > 0 THEN 'incomplete' WHEN n_failed > 0 THEN 'failed' ELSE 'completed' END AS run_status FROM n""",
)
def st2(spark, folder):
    runs = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), F.col("c_mktsegment").alias("run"))
    return J.snapshot(_states(spark, folder).join(runs, "case_id"), "run")


@query("st2_stream_snapshot", f"WITH {SQL_JOURNAL} SELECT status, identity, count(*) AS n_events FROM journal GROUP BY 1, 2")
def st2_stream(spark, folder):
    return J.stream_snapshot(as_journal(event_stream(spark, folder)), ["status", "identity"])


# A report that knows nothing of the journal: the state of a case is read from the customer's balance.
_REPORTED = "CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 1000 THEN 'pending' ELSE 'completed' END"


@query(
    "st3_journal_vs_report",
    f"""WITH {SQL_JOURNAL}, {_REPLAY}, {_STREAMED}, report AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, {_REPORTED} AS reported FROM customer)
       SELECT case_id, CASE WHEN reported IS NULL THEN 'left_only' WHEN state IS NULL THEN 'right_only' WHEN state <> reported THEN 'differs' ELSE 'match' END AS status,
         CASE WHEN reported IS NULL OR state IS NULL THEN NULL WHEN state <> reported THEN 'state' ELSE '' END AS differing
       FROM streamed FULL OUTER JOIN report USING (case_id)""",
)
def st3(spark, folder):
    """The streamed replay against an independent report: cases missing on either side, other states."""
    report = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), F.expr(_REPORTED).alias("state"))
    return reconcile(_streamed(spark, folder), report, ["case_id"], ["state"])


@query(
    "st4_interrupted_runs",
    """SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'
       AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)""",
)
def st4(spark, folder):
    events = table(spark, folder, "events")
    return J.interrupted_runs(events.filter("event_type = 'signup'"), events.filter("event_type = 'purchase' and value > 150"), "user_id")


@query(
    "st4_stream_interrupted",
    """WITH o AS (SELECT user_id, ts, event_type = 'purchase' AS fin, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
       s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM o),
       w AS (SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS timed_out_at, count(*) AS n_events, bool_or(fin) AS fin FROM s GROUP BY user_id, n)
       SELECT user_id, started_at, timed_out_at, n_events FROM w WHERE NOT fin
       AND timed_out_at <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 6 HOUR FROM events)""",
)
def st4_sessions(spark, folder):
    events = event_stream(spark, folder).select("user_id", "ts", "event_type")
    return J.stream_silent_sessions(events, "user_id", "ts", F.col("event_type") == "purchase", "6 hours")


@query(
    "st4_stream_runs",
    """WITH r AS (SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, count(*) AS n_events, bool_or(event_type = 'purchase' AND value > 100) AS fin FROM events GROUP BY 1)
       SELECT user_id, started_at, last_at, n_events, last_at + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) AS timed_out FROM r WHERE NOT fin""",
)
def st4_stream(spark, folder):
    events = event_stream(spark, folder).select("user_id", "ts", "event_type", "value")
    return J.stream_interrupted(events, "user_id", "ts", F.expr("event_type = 'purchase' AND value > 100"), "6 hours")


@query(
    "st5_changes",
    """SELECT user_id, event_id, event_type AS token FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
       WHERE event_type IS DISTINCT FROM before""",
)
def st5(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    return J.changes(events, "user_id", "event_id", F.col("event_type")).select("user_id", "event_id", "token")


@query(
    "st5_stream_changes",
    """SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, md5(event_type) AS token FROM (
       SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before""",
)
def st5_stream(spark, folder):
    return J.stream_changes(event_stream(spark, folder), "user_id", "event_id", F.md5("event_type"))
