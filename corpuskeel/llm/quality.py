"""Operator 9: quality rules as a short-circuit cascade.

Every rule is tried on a bounded sample first, which gives its cost (seconds per text, its own
statistics included) and its selectivity (share of rejected texts). The rules then run in the order of
rejection per cost: a text that one rule rejects never pays for the next. The order decides the cost
only; a text is kept if no rule rejects it, whatever the order.

Statistics are computed lazily over a batch of whole texts, in arrays: repeated windows are found by
doubling (numbers of word pairs, of pairs of pairs, of windows of eight), which is exact.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, narrow, query, table

WINDOW = 8
SYMBOL_BYTES = np.zeros(256, bool)
SYMBOL_BYTES[list(b"#*$%&|<>")] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Bound of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 400
SAMPLE_SHARE_SEED = 7


class Texts:
    """A batch of texts and its statistics, each computed once, when a rule asks for it."""

    def __init__(self, texts: Sequence[str | None]):
        self.n = len(texts)
        blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.blobs = blobs
        self.size = np.array([len(b) for b in blobs], np.int64)
        self.flat = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(self.size + 1)]).astype(np.int64)
        self._kept: dict[str, np.ndarray] = {}

    def get(self, name: str) -> np.ndarray:
        if name not in self._kept:
            self._kept[name] = STATISTICS[name](self)
        return self._kept[name]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one per byte) in each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.begin[1:]] - total[self.begin[:-1]]


def _word_starts(t: Texts) -> np.ndarray:
    inside = ~SPACE[t.flat]
    return inside & ~np.concatenate([[False], inside[:-1]])


def _n_words(t: Texts) -> np.ndarray:
    return t.per_text(_word_starts(t))


def _word_chars(t: Texts) -> np.ndarray:
    return t.per_text(~SPACE[t.flat] & ((t.flat & 0xC0) != 0x80))


def _n_symbols(t: Texts) -> np.ndarray:
    return t.per_text(SYMBOL_BYTES[t.flat])


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    full, repeated = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
    for i, blob in enumerate(t.blobs):
        lines = [x for x in blob.split(b"\n") if x.split()]
        full[i] = len(lines)
        repeated[i] = len(lines) - len(set(lines))
    return full, repeated


def _n_lines(t: Texts) -> np.ndarray:
    full, t._kept["n_dup_lines"] = _lines(t)
    return full


def _n_dup_lines(t: Texts) -> np.ndarray:
    t._kept["n_lines"], repeated = _lines(t)
    return repeated


def _n_repeat_words(t: Texts) -> np.ndarray:
    words: list[bytes] = []
    count = np.zeros(t.n, np.int64)
    for i, blob in enumerate(t.blobs):
        own = blob.split()
        count[i] = len(own)
        words += own
    n = len(words)
    if n < WINDOW:
        return np.zeros(t.n, np.int64)
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    width = 1
    while width < WINDOW:
        code, _ = pd.factorize(code[:-width] * n + code[width:])  # numbers are below n: exact pairs
        width *= 2
    owner = np.repeat(np.arange(t.n), count)
    whole = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(t.n, np.int64)
    window = owner[at] * n + code[at]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
    twice = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return np.bincount(owner, weights=np.cumsum(cover[:-1]) > 0, minlength=t.n).astype(np.int64)


STATISTICS: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": _n_words,
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_dup_lines": _n_dup_lines,
    "n_lines": _n_lines,
    "n_repeat_words": _n_repeat_words,
}
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`rejects` maps the statistics named in `needs` to a mask of rejected texts."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


# Fewer than 20 words, or over 30 % of the words in repeated windows (the base); then symbols at more
# than one in ten words, half of the lines repeated, words of less than 3 or more than 12 letters.
RULES = (
    Rule("few_words", ("n_words",), lambda w: w < 20),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, w: 100 * r > 30 * w),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, w: 10 * s > w),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, w: (c < 3 * w) | (c > 12 * w)),
)
BASE_RULES = ("few_words", "repeated_windows")


def rejected_by(rule: Rule, texts: Texts) -> np.ndarray:
    return rule.rejects(*[texts.get(n) for n in rule.needs])


def estimate(sample: Sequence[str | None], rules: Sequence[Rule] = RULES) -> pd.DataFrame:
    """(name, cost, selectivity, yield) of every rule on a sample, best order first.

    Without a sample, or among equals, the given order stands.
    """
    rows = []
    for place, rule in enumerate(rules):
        start = time.thread_time()
        mask = rejected_by(rule, Texts(sample))
        cost = (time.thread_time() - start) / max(len(sample), 1)
        share = float(mask.mean()) if len(mask) else 0.0
        rows.append((rule.name, cost, share, share / max(cost, 1e-9), place))
    out = pd.DataFrame(rows, columns=["name", "cost", "selectivity", "yield", "place"])
    return out.sort_values(["yield", "place"], ascending=[False, True], kind="stable").reset_index(drop=True)


def sample_texts(documents: DataFrame, text: str) -> list[str | None]:
    """At most SAMPLE_ROWS texts spread over the table, short enough for the driver (see SAMPLE_CHARS)."""
    rows = narrow(documents, [text]).toDF("text")
    share = min(1.0, 4.0 * SAMPLE_ROWS / max(documents.select(F.lit(1)).count(), 1))
    picked = rows.sample(share, SAMPLE_SHARE_SEED).filter(F.coalesce(F.char_length("text"), F.lit(0)) <= SAMPLE_CHARS)
    return [r[0] for r in picked.limit(SAMPLE_ROWS).collect()]


# Texts above this size do not enter the sample of the estimate; all texts are judged in full.
SAMPLE_CHARS = 100_000


def cascade(texts: Sequence[str | None], rules: Sequence[Rule]) -> np.ndarray:
    """Index of the rule that rejects each text, -1 where none does. Rules see survivors only."""
    verdict = np.full(len(texts), -1, np.int64)
    open_ = np.arange(len(texts))
    for i, rule in enumerate(rules):
        if not len(open_):
            break
        mask = rejected_by(rule, Texts([texts[k] for k in open_]))
        verdict[open_[mask]] = i
        open_ = open_[~mask]
    return verdict


def judge(
    documents: DataFrame, statistics: bool = True, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(`key`, the base statistics, base_failed, kept) of every row, or (`key`, kept) without `statistics`.

    With `statistics` every number is wanted, so nothing can be cut short but the rules themselves: they
    run in the estimated order on the shared statistics. Without, a rule's statistics are computed for
    the survivors of the rules before it. A null text has no words and is rejected. Repeated rows are
    judged alike, further columns are ignored, an empty table gives an empty one.
    """
    bounded_batches(documents.sparkSession)
    by_name = {r.name: r for r in rules}
    order = [by_name[n] for n in estimate(sample_texts(documents, text), rules)["name"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            if not statistics:
                kept = cascade(values, order) < 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept)], ["key", "kept"])
                continue
            texts = Texts(values)
            verdict = np.full(len(values), -1, np.int64)
            for i, rule in enumerate(order):
                if (verdict >= 0).all():
                    break
                verdict[(verdict < 0) & rejected_by(rule, texts)] = i
            failed = np.zeros(len(values), bool)
            for rule in rules:
                if rule.name in BASE_RULES:
                    failed |= rejected_by(rule, texts)
            numbers = [pa.array(texts.get(n), pa.int64()) for n in BASE_COLUMNS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, pa.array(failed), pa.array(verdict < 0)], ["key", *BASE_COLUMNS, "base_failed", "kept"]
            )

    rows = narrow(documents, [key, text])
    kind = rows.schema[0].dataType.simpleString()
    numbers = "".join(f", {n} long" for n in BASE_COLUMNS) + ", base_failed boolean" if statistics else ""
    return rows.mapInArrow(run, f"key {kind}{numbers}, kept boolean").withColumnRenamed("key", key)


def passing(documents: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, that no rule rejects; texts never leave their partition.

    A null text counts as empty; repeated rows are judged alike and all kept or all rejected; columns may have
    any names; an empty table stays empty.
    """
    bounded_batches(documents.sparkSession)
    by_name = {r.name: r for r in rules}
    order = [by_name[n] for n in estimate(sample_texts(documents, text), rules)["name"]]
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(cascade(batch.column(place).to_pylist(), order) < 0))

    numbered = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*documents.columns)


SQL_QUALITY = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words) AS kept FROM f"""


@query("op9_quality", SQL_QUALITY)
def op9(spark, folder):
    return judge(table(spark, folder, "documents"))
