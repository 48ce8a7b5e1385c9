"""Known answers and predicates of the column functions."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskeel import constants as K
from corpuskeel.functions import bounds, codes
from corpuskeel.functions import keys as X


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_rank_vectors(spark):
    row = one(spark, g=X.group_rank(F.lit("a" * 64)), m=X.member_rank(F.lit("00000000-0000-4000-8000-000000000001.png")))
    assert row.g == "6455fd523e474607d8da2ccf28411df5c83c5a6792ab2906af9a4dd20978cc5f"
    assert row.m == "370ec891730816c3aa16f75f0ea4936866b72fe951bf38089761a0a491e106d5"


def test_bucket_and_seed_vector(spark):
    uid = F.lit("coco:000000000001")
    row = one(spark, b=X.owner_bucket(uid), w=X.wrong_owner_bucket(uid), s=X.uid_seed(uid))
    assert (row.b, row.w, int(row.s)) == (9, 10, 4369173439443558334)


@pytest.mark.parametrize(
    "owner,q,h,ws,wi",
    [
        ("Alice", "340a", "00010203", "d4631078c3e5bd1b7e279b093bed43253c6e266ac6a59827cfcdcc80c412d655", "cb537abf17414693d82362cb20e88bd33bb214103afc31a69a10f75e060c7cd4"),
        ("Bob", "340a", "00010203", "3497d0612983273ccc16f844eec6d618266028c39ad8f646589c4c253c1aebba", "db40d9fccc6aea248bd5a81c59d5e33e6fef3cb08182f623bb737c8b113530ed"),
        ("Café", "ff0f", "deadbeef", "27e93350dbc7cb44c97631263efe357be47c1f81ab80ca1210e2f3dea51af90f", "ee46ff533979f0c1784ceb995c63f50787086398e7654c6a18c502b6889e36eb"),
    ],
)
def test_signature_vectors(spark, owner, q, h, ws, wi):
    q_, h_ = F.unhex(F.lit(q)), F.unhex(F.lit(h))
    row = one(spark, ws=X.semantic_signature(q_, F.lit(owner)), wi=X.instance_signature(q_, h_, F.lit(owner)))
    assert (row.ws, row.wi) == (ws, wi)


def test_text_groups_fold_unicode_and_space(spark):
    texts = [("Café  sky",), ("café SKY",), (" café sky\n",), ("Straße",), ("STRASSE",), ("  \t",), ("a\x1cb",), ("A b",)]
    got = [r.g for r in spark.createDataFrame(texts, "t string").select(X.text_group("t").alias("g")).collect()]
    assert got[0] == got[1] == got[2] and got[3] == got[4] and got[5] is None and got[6] == got[7]


def test_path_url_and_format_predicates(spark):
    paths = {"a/b.txt": True, "/a": False, "a//b": False, "a/../b": False, "a:b": False, "a\\b": False, "": False, ".": False, "a/": False}
    got = {r.p: r.ok for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.is_safe_relative_path("p").alias("ok")).collect()}
    assert got == paths
    urls = {"https://a.b/c": True, "http://a.b/c": False, "https://u@a.b/": False, "https://a.b/?q": False, "https://a.b/#f": False, "https://": False, "https://a.b/ c": False}
    got = {r.p: r.ok for r in spark.createDataFrame([(p,) for p in urls], "p string").select("p", X.is_public_https("p").alias("ok")).collect()}
    assert got == urls
    row = one(spark, a=X.is_hex64(F.lit("a" * 64 + "\n")), b=X.is_positive_decimal(F.lit("012")), c=X.is_positive_decimal(F.lit("12")), d=X.is_identifier(F.lit("x" * 129)))
    assert (row.a, row.b, row.c, row.d) == (False, False, True, False)


def test_redaction_and_canonical_url(spark):
    row = one(
        spark,
        a=X.redacted(F.lit("Bearer abc.def api_key=XYZ, Password: p;q")),
        b=X.canonical_url(F.lit("HTTPS://Ex.Org/a/b//?q=1#f")),
        c=X.canonical_url(F.lit("ftp://ex.org/")),
        d=X.package_name(F.lit("A__b.-c")),
    )
    assert row.a == "Bearer [REDACTED] api_key=[REDACTED], Password: [REDACTED];q"
    assert (row.b, row.c, row.d) == ("https://ex.org/a/b?q=1", None, "a-b-c")


def test_projection_follows_the_sign_table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, v array<float>")
    got = {r.i: r.c.code for r in df.select("i", codes.sign_projection("v", 16).alias("c")).collect()}
    signs = codes.sign_table(12, 16, bytes(32))
    for i, row in enumerate(x.astype(float)):
        assert got[i] == sum(1 << r for r in range(12) if sum(a * b for a, b in zip(row, signs[r])) >= 0)


def test_vector_violations(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, [float("nan"), 1.0]), (3, [0.5, 0.5]), (4, None)]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, v array<float>").select("i", codes.vector_violation("v", 2).alias("v")).collect()}
    assert got == {0: None, 1: "dimension", 2: "not_finite", 3: "not_unit_norm", 4: "dimension"}


def test_neighbourhood_distances_and_payloads(spark):
    row = one(spark, r=codes.radius_one(F.lit(5), 12), b=codes.code_bytes(F.lit(0x0A34), 2), d=codes.hex_distance(F.lit("f" * 64), F.lit("0" * 64)))
    assert row.r[0] == 5 and len(set(row.r)) == 13 and all(bin(v ^ 5).count("1") <= 1 for v in row.r)
    assert (bytes(row.b), row.d) == (bytes.fromhex("340a"), 256)
    p = F.lit("10" * 30 + "1")
    row = one(spark, p=p, w=codes.wrong_payload(p))
    assert row.w[1:] == row.p[1:] and row.w[0] != row.p[0]
    case = lambda d, ok, v: codes.decode_class(F.lit(d), F.lit(ok), F.lit(v), F.lit("1" * 61))
    row = one(spark, a=case("1" * 61, True, 1), b=case("0" * 61, True, 1), c=case("", False, -1), d=case("1", True, 1), e=case("", False, 3))
    assert tuple(row) == ("MATCH", "VALID_OTHER_PAYLOAD", "NO_VALID_BCH_5", "MALFORMED", "MALFORMED")


def test_simhash_matches_a_direct_sum(spark):
    import hashlib

    text = "a b b c d e f g"
    sums = [0] * 64
    for w in text.split(" "):
        h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
        for b in range(64):
            sums[b] += 1 if h >> b & 1 else -1
    want = sum(1 << b for b in range(64) if sums[b] > 0)
    got = one(spark, s=codes.simhash64(F.lit(text))).s
    assert got & (2**64 - 1) == want


def test_exact_bounds_closed_forms(spark):
    cells = [(0, 300), (1, 2), (0, 299), (0, 298), (300, 300), (5, 5), (7, 50), (-1, 5), (2, 0)]
    df = spark.createDataFrame(cells, "x long, n long")
    got = {(r.x, r.n): (r.lo, r.up) for r in df.select("x", "n", bounds.exact_one_sided("x", "n", True).alias("lo"), bounds.exact_one_sided("x", "n", False).alias("up")).collect()}
    assert got[0, 300][1] == pytest.approx(1 - 0.05 ** (1 / 300), abs=1e-12) and got[0, 300][0] == 0.0
    assert got[1, 2][0] == pytest.approx(1 - 0.95**0.5, abs=1e-12)
    assert got[0, 299][1] <= 0.01 < got[0, 298][1]
    assert got[300, 300] == (pytest.approx(0.05 ** (1 / 300)), 1.0)
    lo, up = got[7, 50]
    tail = lambda p, ks: sum(math.comb(50, k) * p**k * (1 - p) ** (50 - k) for k in ks)
    assert tail(lo, range(7, 51)) == pytest.approx(0.05, abs=1e-9) and tail(up, range(0, 8)) == pytest.approx(0.05, abs=1e-9)
    assert got[-1, 5] == (None, None) and got[2, 0] == (None, None)


def test_split_names_and_their_order_are_fixed():
    assert K.SPLITS == ("development", "validation", "test")


def test_title_keys_are_casefolded(spark):
    titles = ["Stra\u00dfe: A_1!", "STRASSE a_1", "\u0130x \u00c9\u0301", "", None]
    got = [r.k for r in spark.createDataFrame([(t,) for t in titles], "t string").select(X.title_key("t").alias("k")).collect()]
    assert got == ["strassea_1", "strassea_1", re.sub(r"\W+", "", titles[2]).casefold(), "", None]


def test_texts_reach_python_in_small_batches(spark):
    """No Arrow batch of ten thousand texts, whatever the session prefers for Python functions."""
    texts = spark.createDataFrame([("Größe  " * 3,), ("ascii",), (None,)], "t string")
    columns = [X.text_group("t").alias("g"), X.nfc("t").alias("n"), X.title_key("t").alias("k"), codes.simhash64(X.folded_text("t")).alias("s"), codes.text_prints(X.folded_text("t")).alias("p")]
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    try:
        found = texts.select(*columns)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.pythonUDF.arrow.enabled")
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert rows[0].k == "grössegrössegrösse" and rows[0].s == rows[0].p.fp and rows[2].p.colour is None


def test_cohort_shortfall_sends_texts_in_small_batches(spark):
    """wn7_shortfall folds its texts in one Python step without Arrow batches; domains without documents are all short."""
    from corpuskeel.plans import RUNNERS

    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    try:
        found = RUNNERS["wn7_shortfall"](spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.pythonUDF.arrow.enabled")
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert len(rows) == 9 and all(r.n_selected + r.shortfall == 30 for r in rows)
    assert all(r.n_selected == 0 for r in rows if r.domain.startswith("none-"))
