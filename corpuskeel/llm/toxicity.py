"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of two halves: a vector of the word itself and the mean of the vectors of its
character 3-, 4- and 5-grams, so unseen forms of a known stem are recognised. Two gated recurrent
layers read a window of words in both directions, attention pools their states, and a logistic unit
scores the window. A document's score is that of its worst window; all windows of a text are scored,
windows overlap by a quarter. Training runs in numpy on a bounded sample of labelled rows of any length: first on all
sampled windows, then, of a toxic document, on its worst window only.

The input side of the gates is computed once per distinct word and kept by the worker, so a window costs
only its recurrent steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, narrow, query, table
from .shingles import mixed

WINDOW, STRIDE = 32, 24
WORDS, GRAMS = 4096, 16384  # rows of the two hashed tables
WIDTH, HIDDEN = 12, 8
CACHE_WORDS = 500_000

# Bounds of the sample that is learnt from: documents per label to train on, further ones to set the threshold
# on, and windows per training document, spread evenly over its whole text.
TRAIN_DOCS = 1000
CALIBRATION_DOCS = 300
TRAIN_WINDOWS = 128
EPOCHS, BATCH, RATE = 5, 256, 0.01
DECAY = 0.03
LEAST_STEPS = 200  # small samples are gone through more often
FOLDS = 5

_STRIP = ".,;:!?\"'()[]{}|*#$%&<>"


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def word_rows(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the word, rows of its character n-grams in one array, starts) in the hashed tables."""
    padded = [f"<{w.strip(_STRIP) or w}>" for w in words]
    size = np.array([len(w) for w in padded], np.int64)
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size) - size
    place = np.arange(len(chars)) - np.repeat(begin, size)
    code = mixed(chars + np.uint64(1))
    own = np.add.reduceat(mixed(code + place.astype(np.uint64)), begin) % np.uint64(WORDS)
    left = np.repeat(size, size) - place  # characters from here to the end of the word
    grams = np.zeros((len(chars), 3), np.uint64)
    rolled = code.copy()
    for n in range(2, 6):
        rolled[: len(code) - n + 1] = mixed(rolled[: len(code) - n + 1]) + code[n - 1 :]
        if n > 2:
            grams[:, n - 3] = rolled
    real = left[:, None] >= np.arange(3, 6)
    count = np.add.reduceat(real.sum(axis=1), begin)
    return own.astype(np.int64), (mixed(grams)[real] % np.uint64(GRAMS)).astype(np.int64), np.cumsum(count) - count


def summed(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of `values` by `index`, as a table of `rows` rows."""
    order = np.argsort(index, kind="stable")
    ranked = index[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    out = np.zeros((rows, values.shape[1]), np.float32)
    out[ranked[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    r = lambda *shape, s=0.3: (rng.normal(0, s, shape)).astype(np.float32)
    p = {"E": r(WORDS, WIDTH, s=0.02), "C": r(GRAMS, WIDTH, s=0.02), "v": r(2 * HIDDEN), "w": r(2 * HIDDEN), "b": np.zeros(1, np.float32)}
    for d in "fb":
        p[f"W{d}"], p[f"U{d}"], p[f"c{d}"] = r(2 * WIDTH, 3 * HIDDEN), r(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
    return p


def inputs(p: dict, own: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Word inputs (n, 2 * WIDTH): the word's vector beside the mean of its n-grams' vectors."""
    count = np.diff(np.append(starts, len(grams)))
    return np.hstack([p["E"][own], np.add.reduceat(p["C"][grams], starts, axis=0) / count[:, None]]).astype(np.float32)


def gates(p: dict, x: np.ndarray) -> np.ndarray:
    """Input side of both directions' gates, (n, 6 * HIDDEN)."""
    return np.hstack([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]])


def recur(g: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """States (T, n, HIDDEN) of one direction for gates g (T, n, 3 * HIDDEN); masked steps carry the state."""
    steps, n, _ = g.shape
    h, out, trace = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        hu = h @ u
        zr = sigmoid(g[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(g[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        m = mask[t][:, None]
        new = h + m * (1 - z) * (c - h)
        if keep:
            trace.append((h, z, r, c, hu[:, 2 * HIDDEN :], m))
        h = new
        out[t] = h
    return out, trace


def forward(p: dict, g: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows: g (T, n, 6 * HIDDEN), mask (T, n). Attention ignores masked steps."""
    ahead, tf = recur(g[:, :, : 3 * HIDDEN], mask, p["Uf"], keep)
    back, tb = recur(g[::-1, :, 3 * HIDDEN :], mask[::-1], p["Ub"], keep)
    h = np.concatenate([ahead, back[::-1]], axis=2)
    e = np.where(mask > 0, h @ p["v"], -1e9)
    a = np.exp(e - e.max(axis=0))
    a = a * (mask > 0)
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = (a[:, :, None] * h).sum(axis=0)
    return pooled @ p["w"] + p["b"][0], (h, a, pooled, tf, tb)


def _recur_back(dh: np.ndarray, trace: list, u: np.ndarray):
    """Gradients of one direction: of the gates and of the recurrent matrix."""
    steps, n, _ = dh.shape
    dg, du, carry = np.empty((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, hn, m = trace[t]
        d = dh[t] + carry
        dc = d * m * (1 - z) * (1 - c * c)
        dz = -d * m * (c - h) * z * (1 - z)
        dr = dc * hn * r * (1 - r)
        dg[t] = np.hstack([dz, dr, dc])
        dhu = np.hstack([dz, dr, dc * r])
        du += h.T @ dhu
        carry = d * (1 - m * (1 - z)) + dhu @ u.T
    return dg, du


def gradients(p: dict, x: np.ndarray, place: np.ndarray, mask: np.ndarray, y: np.ndarray):
    """Gradients of the mean logistic loss; x are the inputs of the distinct words, place (T, n) their rows."""
    g = gates(p, x)[place]
    logit, (h, a, pooled, tf, tb) = forward(p, g, mask, keep=True)
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    dp = d[:, None] * p["w"]
    dh = a[:, :, None] * dp
    da = h @ p["w"] * d
    de = a * (da - (a * da).sum(axis=0))
    dh = dh + de[:, :, None] * p["v"]
    out = {"w": pooled.T @ d, "b": d.sum(keepdims=True), "v": np.einsum("tnh,tn->h", h, de)}
    dgf, out["Uf"] = _recur_back(dh[:, :, :HIDDEN], tf, p["Uf"])
    dgb, out["Ub"] = _recur_back(dh[::-1, :, HIDDEN:], tb, p["Ub"])
    total = summed(place.ravel(), np.concatenate([dgf, dgb[::-1]], axis=2).reshape(-1, 6 * HIDDEN), len(x))
    f, b = total[:, : 3 * HIDDEN], total[:, 3 * HIDDEN :]
    out |= {"Wf": x.T @ f, "cf": f.sum(axis=0), "Wb": x.T @ b, "cb": b.sum(axis=0)}
    return out, f @ p["Wf"].T + b @ p["Wb"].T


class Vocabulary(dict):
    """Rows of the words seen by a worker; row 0 stands for no word."""

    def __init__(self, p: dict):
        super().__init__()
        self.p = p
        self.fresh: list[str] = []
        self.rows, self.table = 1, np.zeros((1, 6 * HIDDEN), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = row = self.rows + len(self.fresh)
        self.fresh.append(word)
        return row

    def settle(self) -> None:
        if self.fresh:
            new = self.rows + len(self.fresh)
            if new > len(self.table):  # room for twice as many, so that copying stays in proportion
                self.table = np.vstack([self.table[: self.rows], np.zeros((2 * new - self.rows, 6 * HIDDEN), np.float32)])
            self.table[self.rows : new] = gates(self.p, inputs(self.p, *word_rows(self.fresh)))
            self.rows, self.fresh = new, []


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def window_starts(n: int) -> np.ndarray:
    """Starts of all windows of n words; the last one reaches the end."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE)[: max(1, -(-(n - WINDOW) // STRIDE) + 1)]


def document_logits(model: dict, vocabulary: Vocabulary, texts: Sequence[str | None]) -> np.ndarray:
    """Logit of the worst window of every text; an empty text is one window without words."""
    rows: list[int] = []
    count = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = split_words(text)
        count[i] = len(words)
        rows += map(vocabulary.__getitem__, words)
    vocabulary.settle()
    flat = np.array([*rows, 0], np.int64)
    begin = np.cumsum(count) - count
    per_text = [window_starts(n) for n in count]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in per_text])
    start = np.concatenate(per_text) if per_text else np.zeros(0, np.int64)
    out = np.full(len(texts), -np.inf, np.float32)
    for k in range(0, len(start), 2048):
        own, at = owner[k : k + 2048], start[k : k + 2048]
        step = at[None, :] + np.arange(WINDOW)[:, None]
        inside = step < count[own]
        place = np.where(inside, flat[np.minimum(begin[own] + step, len(flat) - 1)], 0)
        logit, _ = forward(model, vocabulary.table[place], inside.astype(np.float32))
        np.maximum.at(out, own, logit)
    return out


def spread_windows(text: str | None, most: int = TRAIN_WINDOWS) -> list[str]:
    """The windows of a whole text, words joined by one space; of more than `most`, evenly spread ones."""
    words = split_words(text)
    starts = window_starts(len(words))
    if len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).round().astype(int)]
    return [" ".join(words[s : s + WINDOW]) for s in starts.tolist()]


def train(texts: Sequence[str], toxic: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights from documents and their labels."""
    return train_on_windows([spread_windows(t) for t in texts], toxic, seed)


def train_on_windows(docs: Sequence[Sequence[str]], toxic: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights from the windows of documents and the documents' labels. With one label only, every text gets it."""
    p, rng = init(seed), np.random.default_rng(seed)
    p["shift"], p["slope"] = np.zeros(1, np.float32), np.ones(1, np.float32)
    if not len(docs) or toxic.min() == toxic.max():
        p["w"][:] = 0
        p["b"][:] = 4.0 if len(docs) and toxic.max() else -4.0
        return p
    numbers: dict[str, int] = {}
    place, owner = [], []
    for i, windows in enumerate(docs):
        first = len(place)
        for window in windows:
            w = np.array([numbers.setdefault(x, len(numbers) + 1) for x in window.split()], np.int64)
            place.append(np.concatenate([w, np.zeros(WINDOW - len(w), np.int64)]))
            owner.append(i)
        known = np.concatenate(place[first:]) if len(place) > first else np.zeros(0, np.int64)
        known = known[known > 0]
        if not toxic[i] and len(known):
            # A harmless word stays harmless however often it is repeated.
            place.append(np.full(WINDOW, known[rng.integers(len(known))]))
            owner.append(i)
    own, grams, starts = word_rows(list(numbers))
    place, owner = np.array(place), np.array(owner)
    y = toxic[owner].astype(np.float32)
    moment, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    gram_count = np.diff(np.append(starts, len(grams)))
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(y) // BATCH)))
    for epoch in range(epochs):
        chosen = np.arange(len(y))
        if 3 * epoch > epochs:
            # Of a toxic document only the worst window is surely toxic.
            x = np.vstack([np.zeros((1, 2 * WIDTH), np.float32), inputs(p, own, grams, starts)])
            whole = gates(p, x)
            logit = np.concatenate([forward(p, whole[place[k : k + 2048].T], (place[k : k + 2048].T > 0).astype(np.float32))[0] for k in range(0, len(y), 2048)])
            order = np.lexsort((-logit, owner))
            worst = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
            chosen = np.concatenate([np.flatnonzero(y == 0), worst[y[worst] == 1]])
        chosen = rng.permutation(chosen)
        for k in range(0, len(chosen), BATCH):
            rows = chosen[k : k + BATCH]
            words, local = np.unique(place[rows].T, return_inverse=True)
            local = local.reshape(WINDOW, len(rows))
            real = words[words > 0] - 1
            pieces = [grams[starts[w] : starts[w] + gram_count[w]] for w in real]
            sizes = np.array([len(g) for g in pieces])
            flat = np.concatenate(pieces)
            offsets = np.cumsum(sizes) - sizes
            x = inputs(p, own[real], flat, offsets)
            # The word half is dropped now and then, so that the characters learn to stand alone.
            heard = (rng.random(len(real)) > 0.5).astype(np.float32)
            x[:, :WIDTH] *= heard[:, None]
            shift = int(words[0] == 0)
            x = np.vstack([np.zeros((shift, 2 * WIDTH), np.float32), x])
            grad, dx = gradients(p, x, local, (place[rows].T > 0).astype(np.float32), y[rows])
            dx = dx[shift:]
            grad["E"] = summed(own[real], dx[:, :WIDTH] * heard[:, None], WORDS)
            grad["C"] = summed(flat, np.repeat(dx[:, WIDTH:] / sizes[:, None], sizes, axis=0), GRAMS)
            step += 1
            for name, g in grad.items():
                moment[name] = 0.9 * moment[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] = p[name] * (1 - RATE * DECAY) - RATE * (moment[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return p


def calibrate(p: dict, logit: np.ndarray, toxic: np.ndarray) -> dict:
    """Shift of the documents' worst logits: the middle of the widest gap among the best thresholds.

    Without documents of both labels, or with a model that knows one label only, the shift stays 0.
    """
    if len(logit) and toxic.min() != toxic.max() and p["w"].any():
        order = np.argsort(logit, kind="stable")
        s, t = logit[order], toxic[order].astype(np.float64)
        n_pos, n_neg = t.sum(), len(t) - t.sum()
        # Errors by rates, at a threshold between neighbours.
        wrong = np.cumsum(t)[:-1] / n_pos + (n_neg - np.cumsum(1 - t)[:-1]) / n_neg
        best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        at = best[np.argmax(s[best + 1] - s[best])]
        p["shift"] = np.array([(s[at] + s[at + 1]) / 2], np.float32)
    return p


def labelled_ids(documents: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, label, place): at most TRAIN_DOCS + CALIBRATION_DOCS documents per label, in a fixed random order.

    Only ids and labels are read, none of the held-out fold. A document whose labels disagree counts as toxic.
    """
    marks = narrow(labels, [key, label]).toDF("id", "label").filter("id IS NOT NULL AND label IS NOT NULL").filter(fold(F.col("id")) != 0)
    marks = marks.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    present = marks.join(narrow(documents, [key]).toDF("id").distinct(), "id", "left_semi")
    rows = []
    for value in (0, 1):
        mine = present.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS + CALIBRATION_DOCS)
        rows += [(r.id, value, place) for place, r in enumerate(mine.select("id").collect())]
    kind = present.schema["id"].dataType.simpleString()
    return documents.sparkSession.createDataFrame(rows, f"id {kind}, label int, place int")


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """A model from at most TRAIN_DOCS + CALIBRATION_DOCS labelled documents per label, of any length.

    Texts are met where they are, by broadcast of the sampled ids (a bounded number); a task returns at most
    TRAIN_WINDOWS windows of a training document. The threshold is set on whole texts, scored in the tasks.
    Of repeated rows of one id the least list of windows is learnt from and the highest score counts.
    """
    bounded_batches(documents.sparkSession)
    chosen = labelled_ids(documents, labels, key, label)
    texts = narrow(documents, [key, text]).toDF("id", "text").filter("text IS NOT NULL")
    texts = texts.join(F.broadcast(chosen), "id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [spread_windows(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("label", "place")] + [pa.array(lists, pa.list_(pa.string()))], ["label", "place", "windows"]
            )

    learnt = texts.filter(F.col("place") < TRAIN_DOCS).select("label", "place", "text")
    learnt = learnt.mapInArrow(windows, "label int, place int, windows array<string>").groupBy("label", "place").agg(F.min("windows").alias("windows"))
    rows = sorted(learnt.collect(), key=lambda r: (r.label, r.place))
    model = train_on_windows([r.windows for r in rows], np.array([r.label for r in rows], np.int64))
    whole = logits(texts.select(F.struct("label", "place").alias("key"), "text"), model)
    worst = sorted((tuple(r.key), r.logit) for r in whole.groupBy("key").agg(F.max("logit").alias("logit")).collect())
    return calibrate(model, np.array([w for _, w in worst], np.float32), np.array([k[0] for k, _ in worst], np.int64))


def logits(rows: DataFrame, model: dict) -> DataFrame:
    """(key, logit of the worst window) of every row (key, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            if len(vocabulary) > CACHE_WORDS:
                vocabulary = Vocabulary(shared.value)
            worst = document_logits(shared.value, vocabulary, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(worst.astype(np.float64))], ["key", "logit"])

    return rows.toDF("key", "text").mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, logit double")


def score(documents: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, held_out, score, predicted) of every row, from its whole text alone.

    A null or empty text is scored as a window without words. Rows with null keys count as not held
    out; repeated rows get the same score; further columns are ignored; an empty table gives an empty one.
    """
    bounded_batches(documents.sparkSession)
    centred = (F.col("logit") - float(model["shift"][0])) * float(model["slope"][0])
    value = 1 / (1 + F.exp(-F.least(F.greatest(centred, F.lit(-60.0)), F.lit(60.0))))
    scored = logits(narrow(documents, [key, text]), model).withColumn("score", value)
    held_out = F.coalesce(fold(F.col("key")) == 0, F.lit(False)).alias("held_out")
    return scored.select(F.col("key").alias(key), held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_toxicity")
def op8(spark, folder):
    documents = table(spark, folder, "documents")
    return score(documents, fit(documents, table(spark, folder, "labels")))
