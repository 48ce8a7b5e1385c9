"""Operator 12: periodic runs of words, by suffix trees of the document and of its reversal.

A run is a stretch of words with smallest period q and a length of at least max(MIN_LENGTH, MIN_EXPONENT * q)
that neither neighbour extends. Every run holds a root that is the longest Lyndon word at its place under one
of the two opposite orders of the words, so there are at most two candidates per place. Each candidate is
extended to the right by the longest common extension (LCE) in the tree of the document and to the left by the
one in the tree of the reversal. The trees are Ukkonen's; an LCE is the depth of a lowest common ancestor,
read in constant time from an Euler tour by blocks of sixteen under a sparse table.

Before the trees are built, stretches that cannot belong to a run are folded to one separator each. In a run
of MIN_EXPONENT or more periods every five consecutive words stand twice, so a place whose five words stand only
once in the document (later: in the rest of it) breaks every run. This is exact: all runs lie whole in what is left.

Time and memory are linear in the longest document, up to sorting; batches are bounded by bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, narrow, query, table
from .shingles import mixed

MIN_LENGTH, MIN_EXPONENT = 6, 4
GRAM = 5  # a run of these bounds repeats each of its grams of this many words
FOLDS = 12  # rounds of folding; more would only make the trees smaller
BLOCK = 16


class SuffixTree:
    """Ukkonen's tree of a list of letters (positive integers), ended by the letter 0, with an Euler tour."""

    def __init__(self, letters: Sequence[int]):
        text = [*letters, 0]
        self.size = n = len(text)
        base = max(text) + 1
        start, end, link, kids = [0], [0], [0], {}
        node = edge = length = remain = 0
        for i, letter in enumerate(text):
            remain += 1
            last = 0
            while remain:
                if not length:
                    edge = i
                key = node * base + text[edge]
                child = kids.get(key)
                if child is None:
                    kids[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                    last = 0
                else:
                    at, size = start[child], end[child] - start[child]
                    if length >= size:
                        edge, length, node = edge + size, length - size, child
                        continue
                    if text[at + length] == letter:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    kids[key] = middle
                    kids[middle * base + letter] = middle + 1
                    start[child] = at + length
                    kids[middle * base + text[at + length]] = child
                    if last:
                        link[last] = middle
                    last = middle
                remain -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - remain + 1
        keys = np.fromiter(kids.keys(), np.int64, len(kids))
        order = np.argsort(keys)
        self.children = np.fromiter(kids.values(), np.int64, len(kids))[order].tolist()
        parents = keys[order] // base
        self.ended = (keys[order] % base == 0).tolist()
        bounds = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        self.low, self.high = bounds[:-1], bounds[1:]
        self._tour(np.array(end) - np.array(start))

    def _tour(self, sizes: np.ndarray) -> None:
        """String depths along the Euler tour, the place of each suffix in it, and the order of the suffixes."""
        sizes, children, high = sizes.tolist(), self.children, self.high
        following, depth = list(self.low), [0] * len(sizes)
        tour: list[int] = []
        path: list[int] = []
        place, order = [0] * self.size, []
        node = 0
        while True:
            own = depth[node]
            at = following[node]
            if at < high[node]:
                tour.append(own)
                following[node] = at + 1
                path.append(node)
                node = children[at]
                depth[node] = own + sizes[node]
                continue
            if self.low[node] == high[node]:
                suffix = self.size - own
                place[suffix] = len(tour)
                order.append(suffix)
            tour.append(own)
            if not path:
                break
            node = path.pop()
        self.place = np.array(place)
        self.order = order
        self.depths = depth
        flat = np.full(-(-len(tour) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        flat[: len(tour)] = tour
        rows = flat.reshape(-1, BLOCK)
        self.flat = flat
        self.from_start = np.minimum.accumulate(rows, axis=1).ravel()
        self.to_end = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        step = 1
        while 2 * step <= len(rows):
            below = self.table[-1]
            self.table.append(np.minimum(below[:-step], below[step:]))
            step *= 2

    def opposite_order(self) -> list[int]:
        """Suffixes in the order of reversed letters, the end of the text still before every letter."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            low, high = self.low[node], self.high[node]
            if low == high:
                out.append(self.size - self.depths[node])
            elif self.ended[low]:
                stack += self.children[low + 1 : high]
                stack.append(self.children[low])
            else:
                stack += self.children[low:high]
        return out

    def extension(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at `one` and `two` (never equal)."""
        a, b = self.place[one], self.place[two]
        a, b = np.minimum(a, b), np.maximum(a, b)
        left, right = a // BLOCK, b // BLOCK
        best = np.minimum(self.to_end[a], self.from_start[b])
        inner = right - left - 1
        far = np.flatnonzero(inner > 0)
        if len(far):
            level = np.frexp(inner[far].astype(np.float64))[1] - 1
            for k in np.unique(level):
                rows = far[level == k]
                best[rows] = np.minimum(best[rows], np.minimum(self.table[k][left[rows] + 1], self.table[k][right[rows] - (1 << k)]))
        near = np.flatnonzero(inner < 0)
        if len(near):
            span = a[near][:, None] + np.arange(BLOCK)
            values = self.flat[np.minimum(span, len(self.flat) - 1)]
            best[near] = np.where(span <= b[near][:, None], values, np.iinfo(np.int32).max).min(axis=1)
        return best.astype(np.int64)


def following_smaller(order: Sequence[int]) -> np.ndarray:
    """For every suffix the next one to the right that comes earlier in `order`: the end of its Lyndon word."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ranks, out, stack = rank.tolist(), [len(order)] * len(order), []
    for i, own in enumerate(ranks):
        while stack and ranks[stack[-1]] > own:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def runs_of(letters: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of a list of positive letters, by start, then period."""
    n = len(letters)
    none = np.zeros((0, 3), np.int64)
    if n < MIN_LENGTH:
        return none
    plain = letters.tolist()
    ahead, back = SuffixTree(plain), SuffixTree(plain[::-1])
    found = []
    for order in (ahead.order, ahead.opposite_order()):
        end = following_smaller(order)[:n]
        start = np.arange(n)
        period = end - start
        able = np.flatnonzero(MIN_EXPONENT * period <= n)
        start, end, period = start[able], end[able], period[able]
        if not len(start):
            continue
        # Suffix n is the end of the text; suffix n - i of the reversal runs left from before i.
        right = ahead.extension(start, end)
        left = back.extension(n - start, n - end)
        length = left + period + right
        runs = (length >= MIN_EXPONENT * period) & (length >= MIN_LENGTH)
        found.append(np.stack([start - left, length, period], axis=1)[runs])
    return np.unique(np.concatenate(found), axis=0) if found else none


def stretches(letters: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts of a document that may hold runs; every run lies whole in one of them.

    A place stays as long as its five words stand at another open place of the same part too.
    """
    n = len(letters)
    at = np.arange(max(0, n - GRAM + 1))
    gram = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        gram = mixed(gram + letters[k : k + len(at)].astype(np.uint64) + np.uint64(1))
    part = np.zeros(len(at), np.int64)
    for _ in range(FOLDS):
        # Equal numbers of different grams would only keep a place too many.
        _, group, count = np.unique(mixed(gram + part.astype(np.uint64)), return_inverse=True, return_counts=True)
        open_ = count[group] > 1
        if open_.all():
            break
        at, gram = at[open_], gram[open_]
        part = np.cumsum(np.diff(at, prepend=-2) > 1)
    if not len(at):
        return []
    first = np.flatnonzero(np.diff(part, prepend=-1) != 0)
    last = np.append(first[1:], len(at)) - 1
    return [(a, b + GRAM) for a, b in zip(at[first].tolist(), at[last].tolist()) if b + GRAM - a >= MIN_LENGTH]


def document_runs(words: Sequence[bytes]) -> np.ndarray:
    """Rows (start, length, period) of the runs of a document, by start, then period."""
    numbers: dict[bytes, int] = {}
    letters = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64)
    parts = stretches(letters)
    if not parts:
        return np.zeros((0, 3), np.int64)
    # The parts one after another, each behind a separator of its own.
    text, place = [], []
    for k, (a, b) in enumerate(parts):
        text += [np.array([len(numbers) + 1 + k]), letters[a:b]]
        place += [np.array([-1]), np.arange(a, b)]
    _, dense = np.unique(np.concatenate(text), return_inverse=True)
    runs = runs_of(dense + 1)
    runs[:, 0] = np.concatenate(place)[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_words, runs array<struct<start, length, period>>, collapsed) of every whole text.

    Words are parted by ASCII white space; `start` is a word number from 0, `collapsed` joins by one space the
    words that no run holds after its first period. A null or empty text has no words, no runs and an empty
    text. Repeated rows and rows without a key stay, further columns are ignored, an empty table stays empty.
    """
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists, texts = [], [], []
            for value in batch.column(1).to_pylist():
                words = (value or "").encode("utf-8", "surrogatepass").split()
                found = document_runs(words)
                counts.append(len(words))
                lists.append(found)
                if len(found):
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                texts.append(b" ".join(words))
            whole = np.concatenate([np.zeros((0, 3), np.int64), *lists])
            ends = np.cumsum([0, *map(len, lists)])
            struct = pa.StructArray.from_arrays([pa.array(whole[:, k]) for k in range(3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct), pa.array(texts, pa.binary()).cast(pa.string())],
                ["key", "n_words", "runs", "collapsed"],
            )

    rows = narrow(documents, [key, text])
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("key", key)


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: its number of runs, its greatest run, digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # The greatest length; ties to the smallest start, then period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return found.withColumn("_best", best).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.l").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("1000 * _best.l div -_best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_periods(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, `text`): every tenth document by the checksum of its key goes on periodically from some word on.

    Documents without a key or without words stay as they are.
    """
    bounded_batches(documents.sparkSession)

    def one(name: int | None, value: str | None) -> str | None:
        if name is None or zlib.crc32(str(name).encode()) % 10:
            return value
        words = (value or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return value
        n, g = len(words), zlib.crc32(str(name).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        block = words[a : a + p]
        tail = (block * (-(-(n - a) // len(block))))[: n - a]
        return b" ".join(words[:a] + tail).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [one(k, v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    rows = narrow(documents, [key, text])
    out = rows.mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, text string")
    return out.toDF(key, text)


@query("op12_runs")
def op12(spark, folder):
    return run_digests(periodic_runs(with_planted_periods(table(spark, folder, "documents"))))
