"""Queries: detector decisions, calibration and bounds (AG13, AG15, AG16, WN11, DX1, UD2)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import detect
from ..session import cut
from .registry import query
from .views import SQL_SCORES, scores, sql_bounds

_TAU_S, _TAU_I = 0.1, 0.05
_PER_Q = f"perq AS (SELECT domain, uid, condition, q, max(s) AS s, max(i) AS i FROM scores GROUP BY 1, 2, 3, 4)"


@query(
    "ag13_joint_decision",
    f"""WITH {SQL_SCORES}, {_PER_Q}, h AS (SELECT *, coalesce(s > {_TAU_S}, false) AS sh, coalesce(i > {_TAU_I}, false) AS ih FROM perq)
       SELECT uid, condition, bool_or(sh) AS semantic_hit, bool_or(ih) AS instance_hit, bool_or(sh AND ih) AS both_match,
         min(CASE WHEN sh AND ih THEN q END) AS first_joint_q, bool_or(sh) AND bool_or(ih) AND NOT bool_or(sh AND ih) AS cross_q_only FROM h GROUP BY 1, 2""",
)
def ag13(spark, folder):
    return detect.joint_decision(scores(spark, folder)[2], ["uid", "condition"], _TAU_S, _TAU_I)


_GRID = f"""cells AS (SELECT domain, condition, js, ji FROM (SELECT DISTINCT domain FROM roster), (SELECT condition FROM conds), range({K.GRID_POINTS}) a(js), range({K.GRID_POINTS}) b(ji)),
ok AS (SELECT * FROM scores WHERE s IS NOT NULL AND i IS NOT NULL),
reached AS (SELECT domain, uid, condition, (SELECT count(*) FROM range({K.GRID_POINTS}) g(j) WHERE (j - 50) / 50.0::DOUBLE < s) AS hs,
    (SELECT count(*) FROM range({K.GRID_POINTS}) g(j) WHERE (j - 50) / 50.0::DOUBLE < i) AS hi FROM ok),
lines AS (SELECT r.domain, r.uid, r.condition, j.js, max(r.hi) AS hi FROM reached r JOIN range({K.GRID_POINTS}) j(js) ON j.js < r.hs GROUP BY 1, 2, 3, 4),
hits AS (SELECT domain, condition, js, ji, count(*) AS n FROM lines JOIN range({K.GRID_POINTS}) k(ji) ON ji < hi GROUP BY 1, 2, 3, 4),
missing AS (SELECT r.domain, c.condition, count(*) AS n FROM roster r, conds c WHERE c.ci > 0 AND NOT EXISTS (SELECT 1 FROM observed o WHERE o.uid = r.uid AND o.condition = c.condition) GROUP BY 1, 2),
grid AS (SELECT domain, condition, CAST(js AS INTEGER) AS js, CAST(ji AS INTEGER) AS ji, coalesce(h.n, 0) + coalesce(m.n, 0) AS n_matches
  FROM cells LEFT JOIN hits h USING (domain, condition, js, ji) LEFT JOIN missing m USING (domain, condition)),
planned AS (SELECT domain, count(*) AS planned FROM roster GROUP BY 1)"""


@query("ag15_grid_counts", f"WITH {SQL_SCORES}, {_GRID} SELECT * FROM grid")
def ag15(spark, folder):
    return detect.grid_counts(*scores(spark, folder))


_BEST = f"""pairs AS (SELECT js, ji, sum(CASE WHEN condition = '{K.POSITIVE_CONDITION}' THEN n_matches / planned END) / count(DISTINCT domain) AS rate,
    bool_or(condition <> '{K.POSITIVE_CONDITION}' AND 100 * n_matches > planned) AS excess FROM grid JOIN planned USING (domain) GROUP BY 1, 2),
best AS (SELECT CAST(js AS BIGINT) AS js, CAST(ji AS BIGINT) AS ji, rate FROM pairs WHERE NOT excess ORDER BY round(rate, 12) DESC, js DESC, ji DESC LIMIT 1)"""


def _calibrated(spark, folder):
    roster, observed, table = scores(spark, folder)
    counts = cut(detect.grid_counts(roster, observed, table), "grid")
    planned = detect.planned_counts(roster)
    return counts, planned, detect.best_thresholds(counts, planned)


@query(
    "wn11_best_thresholds",
    f"WITH {SQL_SCORES}, {_GRID}, {_BEST} SELECT js, ji, (js - 50) / 50.0::DOUBLE AS tau_s, (ji - 50) / 50.0::DOUBLE AS tau_i, round(rate, 6) AS macro_rate FROM best",
)
def wn11(spark, folder):
    return _calibrated(spark, folder)[2].withColumn("macro_rate", F.round("macro_rate", 6))


def _chosen_cells(spark, folder):
    counts, planned, best = _calibrated(spark, folder)
    at = best.select(F.col("js").cast("int").alias("js"), F.col("ji").cast("int").alias("ji"))
    return counts.join(F.broadcast(at), ["js", "ji"]).join(F.broadcast(planned), "domain")


_CELLS = f"""spot AS (SELECT domain, condition, CAST(n_matches AS BIGINT) AS x, planned AS n FROM grid JOIN best USING (js, ji) JOIN planned USING (domain)),
{sql_bounds('spot', 'domain, condition')},
judged AS (SELECT domain, condition, x AS n_matches, n AS planned, CASE WHEN condition = '{K.POSITIVE_CONDITION}' THEN lower_bound ELSE upper_bound END AS bound,
  CASE WHEN condition = '{K.POSITIVE_CONDITION}' THEN lower_bound >= {K.POSITIVE_FLOOR} ELSE upper_bound <= {K.NEGATIVE_CEILING} END AS holds FROM bounds)"""


@query(
    "ag16_objective_cells",
    f"WITH RECURSIVE {SQL_SCORES}, {_GRID}, {_BEST}, {_CELLS} SELECT domain, condition, n_matches, planned, round(bound, 6) AS bound, holds FROM judged",
)
def ag16(spark, folder):
    cells = detect.joint_objective(_chosen_cells(spark, folder))
    return cells.select("domain", "condition", "n_matches", "planned", F.round("bound", 6).alias("bound"), "holds")


@query(
    "ag16_objective", f"WITH RECURSIVE {SQL_SCORES}, {_GRID}, {_BEST}, {_CELLS} SELECT bool_and(holds) AS met, count(*) AS n_cells FROM judged"
)
def ag16_met(spark, folder):
    cells = cut(detect.joint_objective(_chosen_cells(spark, folder)), "cells")
    return detect.objective_met(cells, scores(spark, folder)[0])


_MARGINS = f"""margins AS (SELECT uid, condition, coalesce(max(CASE WHEN s IS NOT NULL AND i IS NOT NULL THEN least(s - {_TAU_S}, i - {_TAU_I}) END), {K.VETO_MARGIN}) AS margin,
  max(CASE WHEN s IS NOT NULL AND i IS NOT NULL THEN least(s - {_TAU_S}, i - {_TAU_I}) END) IS NULL AS all_vetoed FROM perq GROUP BY 1, 2)"""


@query("dx1_joint_margin", f"WITH {SQL_SCORES}, {_PER_Q}, {_MARGINS} SELECT uid, condition, round(margin, 6) AS margin, all_vetoed FROM margins")
def dx1(spark, folder):
    margins = detect.joint_margin(scores(spark, folder)[2], ["uid", "condition"], _TAU_S, _TAU_I)
    return margins.withColumn("margin", F.round("margin", 6))


@query(
    "dx1_auc",
    f"""WITH {SQL_SCORES}, {_PER_Q}, {_MARGINS}, p AS (SELECT margin FROM margins WHERE condition = '{K.POSITIVE_CONDITION}'),
       n AS (SELECT margin FROM margins WHERE condition <> '{K.POSITIVE_CONDITION}')
       SELECT (SELECT count(*) FROM p) AS n_positive, (SELECT count(*) FROM n) AS n_negative,
         round((SELECT sum(CASE WHEN p.margin > n.margin THEN 1.0 WHEN p.margin = n.margin THEN 0.5 ELSE 0 END) FROM p, n)::DOUBLE / ((SELECT count(*) FROM p) * (SELECT count(*) FROM n)), 6) AS auc""",
)
def dx1_auc(spark, folder):
    margins = detect.joint_margin(scores(spark, folder)[2], ["uid", "condition"], _TAU_S, _TAU_I)
    return detect.auc_by_ranks(margins, F.col("condition") == K.POSITIVE_CONDITION).withColumn("auc", F.round("auc", 6))


@query(
    "ud2_score_callback",
    f"WITH {SQL_SCORES} SELECT uid, condition, q, round(coalesce(s, 0.0) * 0.5 + coalesce(i, 0.0) * 0.5, 6) AS score, s IS NULL OR i IS NULL AS veto FROM scores",
)
def ud2(spark, folder):
    @F.pandas_udf("score double, veto boolean")
    def mean_score(s: pd.Series, i: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"score": s.fillna(0.0) * 0.5 + i.fillna(0.0) * 0.5, "veto": s.isna() | i.isna()})

    scored = detect.scored_candidates(scores(spark, folder)[2], mean_score, ["s", "i"])
    return scored.select("uid", "condition", "q", F.round("score", 6).alias("score"), "veto")


@query(
    "wn12_score_violations",
    f"WITH {SQL_SCORES} SELECT uid, condition, q, s, i FROM scores WHERE s NOT BETWEEN -1 AND 1 OR i NOT BETWEEN -1 AND 1",
)
def score_rules(spark, folder):
    return detect.score_violations(scores(spark, folder)[2])
