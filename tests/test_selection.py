"""Orders, proposals and whole-group splits against the rules they must keep."""

import hashlib
import random
import uuid
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuskeel import constants as K
from corpuskeel.functions import keys as X
from corpuskeel.operators import allocate as A
from corpuskeel.operators import checks, rank
from corpuskeel.operators.checks import ContractViolation

SPLITS = K.SPLITS


def tagged(tag, text):
    return hashlib.sha256(tag.encode() + b"\0" + text.encode()).hexdigest()


def frame(spark, groups, domains, reserved=(), holdout=()):
    rows = [(m, g, domains[m], m in reserved, m in holdout) for g, ms in groups.items() for m in ms]
    return spark.createDataFrame(rows, "id string, group_id string, domain string, is_reserved boolean, is_holdout boolean").repartition(3)


def places_before(order, placed, budgets):
    """Table of the open places (domain, split) that each group met, by running sums over the serial order."""
    cells = [(d, s) for d in budgets for s in SPLITS]
    used = np.array([[placed[g][1].get(d, 0) * (placed[g][0] == s) for d, s in cells] for g in order])
    start = np.array([budgets[d][s] for d, s in cells])
    return pd.DataFrame(start - np.cumsum(used, axis=0) + used, index=order, columns=pd.MultiIndex.from_tuples(cells))


def check_allocation(rows, budgets, forced):
    """Quotas are met, groups stay whole, forced groups are where they must be, and every other group
    sits where its scarcest domain had the largest open share when its turn came."""
    table = pd.DataFrame([r.asDict() for r in rows])
    assert (table.groupby("group_id")["split"].nunique() == 1).all()
    assert table.groupby(["domain", "split"]).size().to_dict() == {(d, s): n for d, b in budgets.items() for s, n in b.items() if n}
    placed = {g: (part["split"].iloc[0], part["domain"].value_counts().to_dict()) for g, part in table.groupby("group_id")}
    assert {g: placed[g][0] for g in forced} == forced
    rank = {g: (g not in forced, -len(c), -sum(c.values()), tagged(K.TAG_SPLIT_RANK, g)) for g, (_, c) in placed.items()}
    order = sorted(placed, key=rank.get)
    met = places_before(order, placed, budgets)
    for g in order[len(forced) :]:
        split, need = placed[g]
        offers = {}
        for s in SPLITS:
            free = {d: int(met.at[g, (d, s)]) for d in need}
            if all(free[d] >= need[d] for d in need):
                offers[s] = (min(Fraction(free[d], budgets[d][s]) for d in need), tagged(K.TAG_SPLIT_TIE, f"{g}:{s}"))
        assert max(offers.values()) == offers[split]
    for (g, d), part in table.groupby(["group_id", "domain"]):
        first = min(part["id"], key=lambda m: (tagged(K.TAG_REPRESENTATIVE, f"{g}:{m}"), m))
        assert list(part.loc[part["is_representative"], "id"]) == [first]


@pytest.mark.parametrize("n_domains, span, forcing", [(1, 0.0, False), (2, 0.5, True), (3, 0.3, True), (10, 0.2, False)])
def test_allocation_is_exact_and_every_choice_is_the_best_open(spark, n_domains, span, forcing):
    rng = random.Random(n_domains)
    names = [f"d{i}" for i in range(n_domains)]
    groups, domains = {}, {}
    for g in range(25 * n_domains):
        home = names[g % n_domains]
        members = [f"m{g}-{i}" for i in range(rng.choice([1, 1, 1, 1, 2, 2, 3]))]
        # Domains reach their neighbour in blocks of five, so ten domains form two linked sets.
        near = [d for d in names if int(d[1:]) // 5 == int(home[1:]) // 5]
        domains |= {m: rng.choice(near) if rng.random() < span else home for m in members}
        groups[f"g{g}"] = members
    budgets = {}
    for d in names:
        n = sum(v == d for v in domains.values())
        budgets[d] = {SPLITS[0]: n - 2 * (n // 5), SPLITS[1]: n // 5, SPLITS[2]: n // 5}
    forced = {"g3": SPLITS[0], "g7": SPLITS[2]} if forcing else {}
    reserved, holdout = ({groups["g3"][0]}, {groups["g7"][0]}) if forcing else (set(), set())
    check_allocation(A.allocate(frame(spark, groups, domains, reserved, holdout), budgets).collect(), budgets, forced)


def three_by_three():
    """Three domains of three rows, one place per domain and split."""
    domains = {f"{d}{i}": d for d in "xyz" for i in range(3)}
    return domains, {d: {s: 1 for s in SPLITS} for d in "xyz"}


def test_allocation_of_three_domains_with_one_place_each(spark):
    domains, budgets = three_by_three()
    groups = {m: [m] for m in domains if m not in ("x0", "y0")} | {"xy": ["x0", "y0"]}
    rows = A.allocate(frame(spark, groups, domains, {"x0"}, {"z2"}), budgets).collect()
    check_allocation(rows, budgets, {"xy": SPLITS[0], "z2": SPLITS[2]})


def test_allocation_refuses_a_group_that_spans_domains_without_room(spark):
    domains, budgets = three_by_three()
    groups = {m: [m] for m in domains if m not in ("x0", "x1", "y0")} | {"merged": ["x0", "x1", "y0"]}
    with pytest.raises(ContractViolation, match="infeasible"):
        A.allocate(frame(spark, groups, domains), budgets)
    with pytest.raises(ContractViolation, match="holdout"):
        A.allocate(frame(spark, groups, domains, {"x0"}, {"y0"}), budgets)


def test_allocation_refuses_conflicts_and_oversize(spark):
    domains = {f"m{i}": "d" for i in range(3)}
    budgets = {"d": {s: 1 for s in SPLITS}}
    with pytest.raises(ContractViolation, match="holdout"):
        A.allocate(frame(spark, {"g": ["m0"], "h": ["m1"], "i": ["m2"]}, domains, {"m0"}, {"m0"}), budgets)
    with pytest.raises(ContractViolation, match="infeasible"):
        A.allocate(frame(spark, {"g": ["m0", "m1", "m2"]}, domains), budgets)


@pytest.mark.parametrize("seed", range(3))
def test_proposals_equal_serial_picks(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        for m in range(rng.randrange(1, 5)):
            rows.append((f"g{g}", tagged("g", f"g{g}"), f"g{g}-{m}", tagged("m", f"g{g}-{m}"), f"d{rng.randrange(22)}"))
    taken, chosen, skipped = set(), [], []
    for g in sorted({r[0] for r in rows}, key=lambda g: (tagged("g", g), g)):
        if len(chosen) == 12:
            break
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[2])):
            if r[4] in taken:
                skipped.append(r[2])
                continue
            taken.add(r[4])
            chosen.append(r[2])
            break
    df = spark.createDataFrame(rows, "group string, group_sha256 string, id string, member_sha256 string, digest string").repartition(4)
    picks, passed = rank.propose_sources(df, 12)
    assert [r.id for r in picks.orderBy("pick").collect()] == chosen
    assert sorted(r.id for r in passed.collect()) == sorted(skipped)
    with pytest.raises(ContractViolation):
        rank.propose_sources(df, 1000)


def test_shortest_prefix_of_ranked_parts(spark):
    parts = rank.ranked_partitions(spark.range(1, 2001).select(F.col("id").cast("int").alias("part_id")), "part_id", X.part_rank("part_id"), 14)
    prefix = b"b3-diffusiondb-part-v1\0" + bytes.fromhex(K.SOURCE_REVISION)
    want = sorted(range(1, 2001), key=lambda p: (hashlib.sha256(prefix + p.to_bytes(2, "big")).digest(), p))[:14]
    assert [r.part_id for r in parts.orderBy("part_rank").collect()] == want
    rows = parts.select("part_id", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("n")).withColumn("g", F.concat_ws("-", "part_id", "n"))
    table = {r.part_rank: r for r in rank.shortest_prefix(parts, rows, "part_id", "g", 6000, 1000).collect()}
    assert [k for k, r in sorted(table.items()) if r.selected] == [1, 2, 3, 4, 5, 6] and table[6].total_groups == 6000
    statuses = lambda df, target: {r.status for r in rank.shortest_prefix(parts, df, "part_id", "g", target, 1000).collect()}
    assert statuses(rows.filter(F.col("part_id") != want[13]), 6000) == {"blocked_missing"}
    assert statuses(rows.filter((F.col("part_id") != want[13]) | (F.col("n") > 0)), 6000) == {"blocked_incomplete"}
    assert statuses(rows, 15000) == {"blocked_insufficient"}


def test_admission_keeps_order_and_names_replacements(spark):
    rows = [(str(i), f"{i:064x}", i != 2) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "id string, d string, ok boolean")
    got = {r.id: (r.verdict, r.reserve_index) for r in rank.admit_first_passing(df, "d", "id", F.col("ok"), 3).collect()}
    assert got == {"1": ("accepted", None), "2": ("excluded", None), "3": ("accepted", None), "4": ("replacement", 0)}
    with pytest.raises(ContractViolation):
        rank.admit_first_passing(df, "d", "id", F.col("ok"), 4)


def test_cohort_vectors_and_shortfall(spark):
    rows = [("A", "g-2", "coco:b"), ("A", "g-2", "coco:a"), ("A", "g-1", "coco:c")]
    df = spark.createDataFrame(rows, "domain string, g string, uid string")
    got = rank.stratified_cohort(df, "g", "domain", "uid", 2).orderBy("position").collect()
    assert [(r.g, r.representative_uid, r.priority_sha256[:8]) for r in got] == [("g-1", "coco:c", "7d11fd62"), ("g-2", "coco:a", "be19317f")]
    domains = spark.createDataFrame([("A",), ("B",)], "domain string")
    short = {r.domain: r.shortfall for r in rank.cohort_shortfall(rank.stratified_cohort(df, "g", "domain", "uid", 2), domains, "domain", 2).collect()}
    assert short == {"A": 0, "B": 2}


def test_candidate_order_does_not_depend_on_input_order(spark):
    names = [f"00000000-0000-4000-8000-{i:012x}.png" for i in range(1, 9)]
    rows = [(n, ("a" if i % 3 else "b") * 64) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "name string, g string")

    def order(frame_):
        found = rank.candidate_order(frame_, "g", X.group_rank("g"), "name", X.member_rank("name"))
        return [(r.group_rank, r.member_position, r.name) for r in found.orderBy("group_rank", "member_position").collect()]

    assert order(df) == order(df.orderBy(F.desc("name")).repartition(5)) and len(order(df)) == 8
    assert str(uuid.UUID(names[0][:-4])) == names[0][:-4]


def test_metadata_rules_report_every_broken_row(spark):
    schema = "part_id int, image_name string, prompt string, width int, height int, image_nsfw double, prompt_nsfw double"
    rows = [(1, "a", "t", 512, 512, 0.0, 0.0), (0, "b", "t", 0, 512, 2.0, 0.0), (1, "c", None, 9, 9, float("nan"), 1.5)]
    df = spark.createDataFrame(rows, schema)
    broken = {(r.rule, r.key) for r in checks.row_violations(df, "image_name", checks.metadata_rules(2000)).collect()}
    assert broken == {("part_range", "b"), ("width_positive", "b"), ("image_score", "c"), ("prompt_score", "c"), ("prompt_text", "c")}
    with pytest.raises(ContractViolation):
        checks.require_none(checks.row_violations(df, "image_name", checks.metadata_rules(2000)), "metadata")


def test_reservation_and_quota_errors(spark):
    rows = [("a", "g1", "a:1"), ("b", "g1", "b:1"), ("b", "g2", "b:2")]
    df = spark.createDataFrame(rows, "domain string, g string, uid string")
    got = {r.uid for r in rank.reserve_per_domain(df, "uid", "domain", "g", {"a": 1, "b": 1}).collect()}
    assert got == {"a:1", "b:2"}
    with pytest.raises(ContractViolation):
        rank.reserve_per_domain(df, "uid", "domain", "g", {"a": 1, "b": 2})


@pytest.mark.parametrize("name", ["wn2_candidate_order", "wn6_representatives"])
def test_documents_without_words_are_ranked_as_in_sql(spark, tmp_path, name):
    from test_files_images import assert_as_sql, odd_documents

    assert_as_sql(spark, odd_documents(tmp_path), tmp_path, name)
