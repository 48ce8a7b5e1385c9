"""Operator 7: secret scans over an incremental blob ledger.

Native: every stage is a DataFrame expression. A text version is addressed by the SHA-256 of its
content. The ledger holds the pairs of a blob and a version of a single rule that were scanned, with
their findings; a scan looks only at pairs that the ledger has not seen, and findings are joined back
to every document (path) of a blob. A text travels only if one of the anchors of a rule occurs in it; a blob without
anchors has no findings and is written to the ledger as such, without its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import narrow, query, table


@dataclass(frozen=True)
class Rule:
    """`pattern` is matched leftmost, non-overlapping; matches whose `group` is shorter than `least` go.

    `anchor` occurs in every text that has a match.
    """

    kind: str
    pattern: str
    anchor: str
    group: int = 0
    least: int = 0
    version: int = 1


# The base rules, in their fixed order (fixed values).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
# Further kinds: private key blocks and bearer headers.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20}"),
)
RULES = (*BASE, *MORE)
SPAN = "array<struct<start:long,kind:int,end:long>>"
# What a ledger keeps: the spans name the rule version, as kinds have no number outside one rule set.
LEDGER = "blob string, rule_versions array<string>, spans array<struct<start:long,rule_version:string,end:long>>"
# Values that one step of a running total looks back on, and code points of one piece of a text.
LOOK_BACK = 64
PIECE = 4096


def rule_version(rule: Rule) -> str:
    """Name of one rule as it stands: any change of it makes earlier scans with it count as unseen."""
    return hashlib.sha256(repr((rule.kind, rule.version, rule.pattern, rule.group, rule.least)).encode()).hexdigest()[:16]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, total: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """The total of the values before each one; in blocks, so that long arrays take no square time."""

    def blocks_of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / LOOK_BACK).cast("int"))
        block = lambda b: F.slice(v, b * LOOK_BACK + 1, F.lit(LOOK_BACK))
        inside = lambda carried, part: F.transform(part, lambda _, i: join(carried, total(F.slice(part, F.lit(1), i))))
        whole = bound(
            F.transform(blocks, lambda b: total(block(b))),
            lambda t: F.flatten(F.transform(blocks, lambda b: bound(total(F.slice(t, F.lit(1), b)), lambda c: bound(block(b), lambda part: inside(c, part))))),
        )
        return F.when(F.size(v) > 0, whole).otherwise(F.array().cast("array<long>"))

    return bound(values, blocks_of)


def sums_before(values: Column) -> Column:
    return running(values, lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x), lambda a, b: a + b)


def greatest_before(values: Column) -> Column:
    """Running maximum of the values before each one, 0 before the first."""
    return running(values, lambda v: F.coalesce(F.array_max(v), F.lit(0).cast("long")), F.greatest)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches in code points.

    The pieces between matches and the matches alternate, so running lengths give the positions.
    """
    pattern, version = F.lit(rule.pattern), F.lit(rule_version(rule))
    lengths = lambda texts: F.transform(texts, lambda t: F.char_length(t).cast("long"))
    core = lambda length: length if rule.group == 0 else lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group)))

    def spans(gap: Column, length: Column) -> Column:
        before = sums_before(F.zip_with(F.slice(gap, F.lit(1), F.size(length)), length, lambda g, n: g + n))
        steps = F.arrays_zip(before.alias("before"), F.slice(gap, F.lit(1), F.size(length)).alias("gap"), length.alias("length"), core(length).alias("core"))
        kept = F.filter(steps, lambda x: x["core"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(
            (x["before"] + x["gap"]).alias("start"), version.alias("rule_version"), (x["before"] + x["gap"] + x["length"]).alias("end")
        ))

    found = bound(lengths(F.regexp_extract_all(text, pattern, F.lit(0))), lambda n: bound(lengths(F.split(text, rule.pattern, -1)), lambda g: spans(g, n)))
    return F.when(F.regexp_like(text, F.lit(rule.anchor)), found)


def addressed(documents: DataFrame, rules: Sequence[Rule], key: str, text: str) -> DataFrame:
    """(id, blob, scan): the content address of every version; `scan` is its text if an anchor occurs."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    anchored = F.lit(False)
    for rule in rules:
        anchored = anchored | F.regexp_like(whole, F.lit(rule.anchor))
    return narrow(documents, [key, text]).select(
        F.col(f"`{key}`").alias("id"), F.sha2(whole, 256).alias("blob"), F.when(anchored, whole).alias("scan")
    )


def empty_ledger(documents: DataFrame) -> DataFrame:
    return documents.sparkSession.createDataFrame([], LEDGER)


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows (blob, rule_versions, spans): the pairs of a blob and a rule version not seen yet.

    A blob's new pairs share one row. Blobs of any number of copies are one aggregate over narrow rows; of
    the texts with anchors one copy each is scanned, with the unseen rules only. A blob has at most one
    ledger row per rule version, as every row adds versions.
    """
    names = F.array(*[F.lit(rule_version(r)) for r in rules])
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rule_versions")).alias("seen"))
    blobs = versions.groupBy("blob").agg(F.first("scan", ignorenulls=True).alias("scan"))
    unseen = blobs.join(seen, "blob", "left").select(
        "blob", "scan", F.when(F.col("seen").isNull(), names).otherwise(F.array_except(names, "seen")).alias("rule_versions")
    )
    by_rule = [F.when(F.array_contains("rule_versions", F.lit(rule_version(r))), rule_spans(F.col("scan"), r)) for r in rules]
    none = F.array().cast(LEDGER.rsplit(" spans ", 1)[1])
    spans = F.flatten(F.array(*[F.coalesce(s, none) for s in by_rule])) if by_rule else none
    found = F.when(F.col("scan").isNull(), none).otherwise(spans)
    return unseen.filter(F.size("rule_versions") > 0).select("blob", "rule_versions", found.alias("spans"))


def blob_spans(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans) of the blobs with findings of these rules: by start, then in the order of the rules."""
    number = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (rule_version(r), i)]) if rules else F.lit(None).cast("map<string,int>")
    numbered = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(number, s["rule_version"]).alias("kind"), s["end"].alias("end")))
    own = ledger.filter(F.size("spans") > 0).select("blob", F.filter(numbered, lambda s: s["kind"].isNotNull()).alias("spans"))
    return own.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).cast(SPAN).alias("spans")).filter(F.size("spans") > 0)


def scan(documents: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, additions): one row (`key`, blob, spans) per document, and the new ledger rows.

    `spans` is sorted by start, then by the order of the rules. A null text counts as empty. Rows with
    null keys and repeated rows are returned as they come; further columns are ignored; an empty table
    gives empty results, no rules give no spans. Append the additions to the ledger to have the next scan
    skip their pairs: a new or changed rule scans its own pairs only, a new text those of all rules.
    """
    versions = addressed(documents, rules, key, text)
    known = ledger if ledger is not None else empty_ledger(documents)
    additions = cut(scan_unseen(versions, known, rules), "secret-ledger")
    hits = blob_spans(known.select("blob", "rule_versions", "spans").unionByName(additions), rules)
    paths = narrow(documents, [key, text]).select(F.col(f"`{key}`").alias(key), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("blob"))
    findings = paths.join(hits, "blob", "left").select(key, "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return findings, additions


def span_text(spans: Column, kinds: Sequence[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, kinds: Sequence[str]) -> Column:
    """The text with every span replaced by [kind]; overlapping spans are replaced as one.

    The text is cut into pieces once and parts are taken from those, so many spans take no square time.
    """
    names = F.array(*[F.lit(k) for k in kinds])

    def part(pieces: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / PIECE).cast("int")
        few = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
        return F.substring(few, (begin % PIECE + 1).cast("int"), (end - begin).cast("int"))

    def build(pieces: Column, all_spans: Column, before: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            label = F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
            return F.when(s["start"] >= before[i], F.concat(part(pieces, before[i], s["start"]), label)).otherwise("")

        last = F.coalesce(F.array_max(F.transform(all_spans, lambda s: s["end"])), F.lit(0).cast("long"))
        return F.concat(F.array_join(F.transform(all_spans, one), ""), part(pieces, last, F.char_length(text).cast("long")))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ends = greatest_before(F.transform(spans, lambda s: s["end"]))
    return bound(pieces, lambda p: bound(spans, lambda all_spans: bound(ends, lambda before: build(p, all_spans, before))))


def _sql_kind(kind: str, pattern: str, group: int, least: int, number: int) -> str:
    """Matches of one kind with positions: pieces between matches come from a split by the same pattern."""
    pattern, core = pattern.replace("'", "''"), f"regexp_extract_all(t, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s':
      list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'c': length(g[i])}})) AS x
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, {core} AS g, regexp_split_to_array(t, '{pattern}') AS p FROM d) WHERE len(m) > 0"""


SQL_SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(_sql_kind(r.kind, r.pattern, r.group, r.least, i) for i, r in enumerate(RULES))}),
f AS (SELECT doc_id, k, kind, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e FROM a WHERE x.c >= CASE k WHEN 0 THEN 6 ELSE 0 END),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


@query("op7_secrets", SQL_SECRETS)
def op7(spark, folder):
    """The ledger is filled with the base rules first; the whole rule set then scans the pairs that are left."""
    documents = table(spark, folder, "documents")
    _, ledger = scan(documents, rules=BASE)
    findings, _ = scan(documents, ledger)
    kinds = [r.kind for r in RULES]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return findings.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(span_text(base, kinds), 256).alias("base_sha256"),
        span_text(F.col("spans"), kinds).alias("spans"),
    )
