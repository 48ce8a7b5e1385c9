"""Calibration, statistics, evidence and journals."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskeel import constants as K
from corpuskeel.operators import detect, evidence, reconcile, stats
from corpuskeel.streaming import journal as J

CONDITIONS = (K.POSITIVE_CONDITION, *K.NEGATIVE_CONDITIONS)
GRID = [(j - 50) / 50 for j in range(101)]


def tables(spark, sources, observations):
    """observations: (uid, condition) -> list of (q, s, i) or absent."""
    domain = {u: d for d, u in sources}
    roster = spark.createDataFrame(sources, "domain string, uid string")
    observed = spark.createDataFrame([(u, c) for (u, c) in observations], "uid string, condition string")
    rows = [(domain[u], u, c, q, s, i) for (u, c), cs in observations.items() for q, s, i in cs]
    scores = spark.createDataFrame(rows, "domain string, uid string, condition string, q long, s double, i double")
    return roster, observed, scores


def calibrated(spark, sources, observations):
    roster, observed, scores = tables(spark, sources, observations)
    return detect.best_thresholds(detect.grid_counts(roster, observed, scores), detect.planned_counts(roster)).collect()


SOURCES = [("A", "a"), ("B", "b"), ("C", "c")]
PLAIN = {(u, c): [(0, 0.5, 0.5)] if c == "C1" else [(0, 0.2, 0.2)] for _, u in SOURCES for c in CONDITIONS}


def test_calibration_vector_and_adverse_missing(spark):
    (row,) = calibrated(spark, SOURCES, PLAIN)
    assert (row.js, row.ji, row.tau_s, row.tau_i, row.macro_rate) == (74, 74, 0.48, 0.48, 1.0)
    missing = {k: v for k, v in PLAIN.items() if k != ("a", "C2")}
    assert calibrated(spark, SOURCES, missing) == []
    empty = {**PLAIN, ("a", "C2"): []}
    assert calibrated(spark, SOURCES, empty)[0].js == 74


def test_grid_counts_match_brute_force(spark):
    rng = random.Random(2)
    sources = [(d, f"{d}{i}") for d in "AB" for i in range(4)]
    obs = {}
    for _, u in sources:
        for c in CONDITIONS:
            if rng.random() < 0.85:
                score = lambda: rng.choice([None, 1.0, -1.0, round(rng.uniform(-1, 1), 2), rng.choice(GRID)])
                obs[u, c] = [(q, score(), score()) for q in range(rng.randrange(4))]
    roster, observed, scores = tables(spark, sources, obs)
    got = {(r.domain, r.condition, r.js, r.ji): r.n_matches for r in detect.grid_counts(roster, observed, scores).collect()}
    assert len(got) == 2 * 4 * 101 * 101
    for js, ji in [(rng.randrange(101), rng.randrange(101)) for _ in range(150)] + [(0, 0), (100, 100), (50, 50)]:
        for d in "AB":
            for c in CONDITIONS:
                n = 0
                for dd, u in sources:
                    if dd == d:
                        seen = obs.get((u, c))
                        n += c != "C1" if seen is None else any(s is not None and i is not None and s > GRID[js] and i > GRID[ji] for _, s, i in seen)
                assert got[d, c, js, ji] == n


def test_thresholds_below_is_a_left_bisection(spark):
    from bisect import bisect_left

    values = GRID + [v + 1e-12 for v in GRID] + [v - 1e-12 for v in GRID] + [-1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", detect.thresholds_below(F.col("v")).alias("n")).collect():
        assert r.n == bisect_left(GRID, r.v)


def test_joint_decision_needs_one_q(spark):
    rows = [("x", 0, 0.9, None), ("x", 1, None, 0.9), ("y", 0, 0.9, 0.1), ("y", 1, 0.6, 0.6), ("z", 0, None, None)]
    df = spark.createDataFrame(rows, "uid string, q int, s double, i double")
    got = {r.uid: (r.both_match, r.cross_q_only, r.first_joint_q) for r in detect.joint_decision(df, ["uid"], 0.5, 0.5).collect()}
    assert got == {"x": (False, True, None), "y": (True, False, 1), "z": (False, False, None)}
    margins = {r.uid: (r.margin, r.all_vetoed) for r in detect.joint_margin(df, ["uid"], 0.5, 0.5).collect()}
    assert margins["x"] == (-3.0, True) and margins["y"] == (pytest.approx(0.1), False)


def test_objective_needs_every_cell(spark):
    from corpuskeel.operators.checks import ContractViolation

    cells = [(d, c, 300 if c == "C1" else 0, 300) for d in "ABC" for c in CONDITIONS]
    schema = "domain string, condition string, n_matches long, planned long"
    domains = spark.createDataFrame([(d,) for d in "ABC"], "domain string")
    good = detect.joint_objective(spark.createDataFrame(cells, schema))
    assert detect.objective_met(good, domains).first().met
    worse = detect.joint_objective(spark.createDataFrame([(d, c, 1 if (d, c) == ("A", "C2") else n, p) for d, c, n, p in cells], schema))
    assert not detect.objective_met(worse, domains).first().met
    with pytest.raises(ContractViolation):
        detect.objective_met(detect.joint_objective(spark.createDataFrame(cells[1:], schema)), domains)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    pos, neg = np.round(rng.normal(0.3, 0.4, 60), 1), np.round(rng.normal(0, 0.4, 80), 1)
    df = spark.createDataFrame([(float(v), True) for v in pos] + [(float(v), False) for v in neg], "margin double, p boolean")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert detect.auc_by_ranks(df, F.col("p")).first().auc == pytest.approx(want)


def test_describe_paired_effect_and_withheld_interval(spark):
    rows = [(c, s, s + (1.0 if c == "b" else 0.0)) for c in "ab" for s in range(6)]
    df = spark.createDataFrame(rows, "condition string, seed long, value double")
    assert {r.condition: (r.n, r.median) for r in stats.describe(df, ["condition"], "value").collect()} == {"a": (6, 2.5), "b": (6, 3.5)}
    single = stats.describe(df.limit(1), ["condition"], "value").first()
    assert single.sd is None and single.n == 1
    diffs = stats.paired_differences(df, "seed", "condition", "value", "a", "b")
    effect = stats.paired_effect(diffs).first()
    assert (effect.n, effect.mean_difference, effect.cohens_dz) == (6, 1.0, None)
    ci = stats.paired_bootstrap(diffs, "seed", 100, 7, complete=True).first()
    assert (ci.low, ci.high, ci.withheld) == (1.0, 1.0, False)
    assert stats.paired_bootstrap(diffs, "seed", 100, 7, complete=False).first().withheld
    assert stats.paired_bootstrap(diffs.limit(4), "seed", 100, 7, complete=True).first().withheld


def test_run_states_keep_failed_and_missing(spark):
    expected = spark.createDataFrame([(f"r{i}", i, "a") for i in range(4)], "run_id string, seed long, condition string")
    seen = spark.createDataFrame(
        [("r0", 0, "a", "completed"), ("r1", 1, "a", "failed"), ("r2", 9, "a", "completed"), ("r9", 1, "a", "completed")],
        "run_id string, seed long, condition string, status string",
    )
    got = {r.run_id: r.state for r in stats.run_states(expected, seen).collect()}
    assert got == {"r0": "completed", "r1": "failed", "r2": "mismatch", "r3": "missing", "r9": "unexpected"}


def test_approval_window_is_half_open(spark):
    t = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    runs = spark.createDataFrame([(str(i), "m", 10.0, 1.0) for i in range(6)], "run_id string, manifest string, max_seconds double, max_usd double")
    schema = "run_id string, manifest string, issued_at timestamp, expires_at timestamp, decision string, max_seconds double, max_usd double"
    approvals = [("0", "m", t, t + day, "approve", 10.0, 1.0), ("1", "m", t - day, t, "approve", 10.0, 1.0), ("2", "x", t, t + day, "approve", 10.0, 1.0),
                 ("3", "m", t, t + day, "reject", 10.0, 1.0), ("4", "m", t, t + day, "approve", 9.0, 1.0)]
    got = {r.run_id: r.verdict for r in reconcile.approval_check(runs, spark.createDataFrame(approvals, schema), ["run_id"], "manifest", F.lit(t)).collect()}
    assert got == {"0": "approved", "1": "outside_window", "2": "digest_mismatch", "3": "not_approved", "4": "budget_exceeded", "5": "no_approval"}


def test_claim_classes_and_previous_holder(spark):
    papers = spark.createDataFrame([("p1", "verified"), ("p2", "unverified")], "paper_id string, verification string")
    ledger = spark.createDataFrame(
        [("e1", "p1", "supporting", "direct-evidence"), ("e2", "p1", "contradicting", "direct-evidence"), ("e3", "p2", "supporting", "direct-evidence")],
        "evidence_id string, source_id string, stance string, kind string",
    )
    claims = spark.createDataFrame(
        [("c1", ["e1"], []), ("c2", ["e1", "e2"], []), ("c3", ["e1", "e3"], []), ("c4", ["e9"], []), ("c5", [], []), ("c6", [], ["r1"]), ("c7", [], ["r2"])],
        "claim_id string, evidence_ids array<string>, run_ids array<string>",
    )
    runs = spark.createDataFrame([("r1", "completed"), ("r2", "failed")], "run_id string, status string")
    support = evidence.claim_support(claims, *evidence.claim_links(claims), ledger, papers, runs, runs.filter("status = 'completed'"))
    clean = spark.createDataFrame([("warning", "p", "source_unverified")], "severity string, subject string, code string")
    got = {r.claim_id: r.classification for r in evidence.classify_claims(support, clean).collect()}
    assert got == {"c1": "verified", "c2": "conflicting", "c3": "partially supported", "c4": "unverifiable", "c5": "unsupported", "c6": "verified", "c7": "unverifiable"}
    held = spark.createDataFrame([("a", 1, "T"), ("b", 2, "T"), ("c", 3, "T"), ("d", 4, None)], "paper_id string, o int, title string")
    conflicts = {(r.paper_id, r.previous_id) for r in evidence.identity_conflicts(held, {"title": F.col("title")}, "o").collect()}
    assert conflicts == {("b", "a"), ("c", "b")}


def test_replay_names_repeats_rewrites_and_pending(spark):
    planned = spark.createDataFrame([(c, "id") for c in "abcd"], "case_id string, identity string")
    rows = [("a", 1, "completed", "id"), ("b", 2, "failed", "id"), ("b", 3, "completed", "id"), ("c", 4, "running", "other"), ("z", 5, "completed", "id")]
    journal = spark.createDataFrame(rows, "case_id string, seq long, status string, identity string")
    got = {r.case_id: (r.state, r.n_repeated, r.n_nonterminal, r.rewritten) for r in J.replay(planned, journal).collect()}
    assert got == {"a": ("completed", 0, 0, False), "b": ("failed", 1, 0, False), "c": ("pending", 0, 1, True), "d": ("pending", 0, 0, False)}
    assert [r.case_id for r in J.unknown_cases(planned, journal).collect()] == ["z"]


def test_streams_over_several_files_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(6)}", i, rng.choice(["completed", "failed", "progress"]), "id") for i in range(200)]
    schema = "case_id string, seq long, status string, identity string"
    folder = str(tmp_path / "journal")
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(folder)
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    batch = spark.createDataFrame(rows, schema)
    planned = spark.createDataFrame([(c, "other" if c == "c1" else "id") for c in ("c0", "c1", "c2", "c3", "silent")], "case_id string, identity string")
    names = ("case_id", "state", "n_repeated", "n_nonterminal", "rewritten")
    streamed = J.stream_replay(planned, source()).collect()
    assert {tuple(r[n] for n in names) for r in streamed if not r.unexpected} == {tuple(r[n] for n in names) for r in J.replay(planned, batch).collect()}
    assert {r.case_id for r in streamed if r.unexpected} == {"c4", "c5"} and {r.case_id for r in streamed if r.rewritten} == {"c1"}
    runs = {}
    for case, seq, status, _ in rows:
        runs.setdefault(case, []).append((seq, status))
    timed = lambda: source().withColumn("at", F.timestamp_seconds("seq"))
    final = F.col("status").isin("failed") & (F.col("seq") > 170)
    got = {r.case_id: (r.n_events, r.timed_out) for r in J.stream_interrupted(timed(), "case_id", "at", final, "5 seconds").collect()}
    assert got == {c: (len(e), e[-1][0] + 5 <= 199) for c, e in runs.items() if not any(s == "failed" and q > 170 for q, s in e)}
    counts = {(r.status, r.n_events) for r in J.stream_snapshot(source(), ["status"]).collect()}
    assert counts == {(r.status, r["count"]) for r in batch.groupBy("status").count().collect()}
    wanted = {(r.case_id, r.seq) for r in J.changes(batch, "case_id", "seq", F.col("status"), slices=7).collect()}
    brute, last = set(), {}
    for case, seq, status, _ in rows:
        if last.get(case) != status:
            brute.add((case, seq))
        last[case] = status
    assert wanted == brute
    assert {(r.key, r.seq) for r in J.stream_changes(source(), "case_id", "seq", F.col("status")).collect()} == brute


def test_holm_of_one_large_family_with_ties(spark):
    rng = random.Random(8)
    ps = [rng.choice([1.0, 0.5, 0.04, rng.random() / 50, rng.random() / 1000]) for _ in range(1500)]
    rows = [("f", i, p) for i, p in enumerate(ps)] + [("g", 0, 0.01), ("g", 1, None), ("g", 2, 0.04)]
    got = {(r.f, r.t): r.adjusted for r in stats.holm(spark.createDataFrame(rows, "f string, t int, p double"), ["f"], "p").collect()}
    top = 0.0
    for k, (p, i) in enumerate(sorted((p, i) for i, p in enumerate(ps))):
        top = max(top, min(1.0, (1500 - k) * p))
        assert got["f", i] == pytest.approx(top)
    assert (got["g", 0], got["g", 1], got["g", 2]) == (pytest.approx(0.02), None, pytest.approx(0.04))


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_folds_by_slices(spark, how):
    from corpuskeel.operators.skew import range_scan

    rng = random.Random(9)
    rows = [(rng.choice("aab"), rng.randrange(400), i, rng.choice([None, rng.randrange(-50, 50)])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int").repartition(6)
    got = {r.i: r.x for r in range_scan(df, ["k"], "o", "v", "x", ["i"], how, slices=13).collect()}
    state = {}
    for k, _, i, v in sorted(rows, key=lambda r: r[1:3]):
        if v is not None:
            state[k] = v if k not in state else state[k] + v if how == "sum" else max(state[k], v)
        assert got[i] == state.get(k)


def test_multiplicities_are_poisson(spark):
    n = F.count(F.lit(1))
    drawn = spark.range(20_000).select(stats.bootstrap_multiplicity(F.col("id"), F.col("id") % 7, 3).alias("k")).groupBy("k").agg(n.alias("n")).collect()
    share = {r.k: r.n / 20_000 for r in drawn}
    assert all(abs(share.get(k, 0) - np.exp(-1) / f) < 0.012 for k, f in enumerate((1, 1, 2, 6, 24)))


def test_inspections_are_bound_by_digest(spark):
    rows = [
        (1, "a", "verified", "full-text", "x.txt", "d1", "t1"), (2, "b", "verified", "abstract", "x.txt", "d2", "t1"),
        (3, "c", "verified", "metadata", "x.txt", "d1", "t2"), (4, "d", "verified", "full-text", None, None, "t3"),
        (5, "e", "verified", "full-text", "../x.txt", "d1", "t1"), (6, "f", "unverified", None, None, None, None),
        (7, "f", "verified", "abstract", "gone.txt", "d1", None), (8, "g", "verified", "abstract", "/x.txt", "d1", None),
        (9, "h", "verified", None, "x.txt", "d1", None), (10, "i", "verified", "abstract", "x.txt", None, None),
    ]
    papers = spark.createDataFrame(rows, "n int, paper_id string, verification string, inspected_content string, artifact string, artifact_sha256 string, title string")
    artifacts = spark.createDataFrame([("x.txt", "d1"), ("../x.txt", "d1"), ("/x.txt", "d1")], "artifact string, sha256 string")
    got = evidence.inspection_findings(papers, artifacts, {"title": F.col("title")}, "n").collect()
    assert sorted((r.subject, r.code, r.n) for r in got) == [
        ("b", "duplicate_title", 1), ("b", "inspection_mismatch", 1), ("c", "inspection_absent", 1), ("d", "inspection_absent", 1),
        ("e", "duplicate_title", 1), ("e", "inspection_missing", 1), ("f", "duplicate_paper_id", 1), ("f", "inspection_missing", 1),
        ("g", "inspection_missing", 1), ("h", "inspection_absent", 1), ("i", "inspection_mismatch", 1),
    ]
    assert evidence.inspection_findings(papers.limit(0), artifacts, {"title": F.col("title")}, "n").collect() == []


def test_clustered_resamples_hold_exactly_as_many_draws_as_units(spark):
    """With equal totals and weights in every unit, the weight of a resample is the number of its draws."""
    units = spark.range(40).select((F.col("id") * 3).alias("u"), F.col("id").cast("double").alias("total"), F.lit(1.0).alias("weight"))
    got = {r.sample: r.estimate for r in stats.drawn_means(units, "u", 25, 5).collect()}
    draw = lambda s, i: int(hashlib.md5(f"5:{s}:{i}".encode()).hexdigest()[:12], 16) % 40
    assert got == pytest.approx({s: sum(draw(s, i) for i in range(40)) / 40 for s in range(25)})


def test_draws_and_units_are_not_broadcast(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        units = spark.range(40).select(F.col("id").alias("u"), F.lit(2.0).alias("total"), F.lit(1.0).alias("weight"))
        means = stats.drawn_means(units, "u", 25, 5)
        plan = means._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert [r.estimate for r in means.collect()] == [2.0] * 25
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_every_silent_session_of_a_key_is_reported(spark, tmp_path):
    """A key with several pauses has several sessions; a final record ends its own session only."""
    rows = [("a", 0, False), ("a", 3, False), ("a", 20, True), ("a", 40, False), ("b", 1, True), ("b", 30, False), ("z", 100, False)]
    schema = "k string, at long, fin boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events")).withColumn("ts", F.timestamp_seconds("at"))
    got = J.stream_silent_sessions(stream.select("k", "ts", "fin"), "k", "ts", F.col("fin"), "5 seconds").collect()
    second = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds())
    assert sorted((r.k, second(r.started_at), second(r.timed_out_at), r.n_events) for r in got) == [("a", 0, 8, 2), ("a", 40, 45, 1), ("b", 30, 35, 1)]


def test_key_differences_follow_not_in(spark, tmp_path):
    """A null key is not known to be absent, and nothing is known to be absent from a side with a null key."""
    import duckdb
    from test_files_images import assert_as_sql, odd_documents

    db = duckdb.connect()
    sides = [[], [None], ["a", "b", "a"], ["b", None], ["c"]]
    for left in sides:
        for right in sides:
            want = []
            for name, a, b in (("left", left, right), ("right", right, left)):
                want += [(k, name) for (k,) in db.execute("SELECT DISTINCT k FROM (SELECT unnest($1::VARCHAR[]) AS k) WHERE k NOT IN (SELECT unnest($2::VARCHAR[]))", [a, b]).fetchall()]
            frames = [spark.createDataFrame([(k,) for k in side], "k string") for side in (left, right)]
            assert sorted(map(str, map(tuple, reconcile.key_set_difference(*frames, ["k"]).collect()))) == sorted(map(str, want)), (left, right)
    assert_as_sql(spark, odd_documents(tmp_path), tmp_path, "so2_key_difference")
