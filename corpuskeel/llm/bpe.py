"""Operator 1: BPE encoding and decoding by a pair occurrence index.

The distinct words of a batch are laid out as one array of symbols. An index maps the rank of every
adjacent pair that can merge to all its positions; ranks are applied in ascending order, all positions
of a rank at once, and only the lists of the pairs around a merge are updated. A word of any length
costs time in proportion to its merges. Words met before come from a bounded cache, and texts are put
together from their words, so the output equals the public library's token for token.

The tokenizer file is a parameter; it is read on the driver and travels to the workers as a broadcast
variable (49,408 tokens, fixed size).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, narrow, query, table

# Words kept by a worker before the cache starts anew.
CACHE_WORDS = 400_000
NO_RANK = np.iinfo(np.int32).max

# The splitting pattern of the public word tokenizer, and an equal one for texts of Latin letters,
# where no character outside the ranges below decides; the standard library matches it faster.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af"
LATIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[0-9]|[^\t-\r \x85\xa0{LATIN_LETTERS}0-9]+")
NOT_LATIN = re.compile("[^\t-\r\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af]")


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 256
    for b in own:
        letters[b] = chr(b)
    for b in range(256):
        if not letters[b]:
            letters[b], spare = chr(spare), spare + 1
    return letters


def read_spec(path: str) -> dict:
    """What encoding needs from a tokenizer file: plain arrays, cheap to broadcast."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, vocab = whole["model"], whole["model"]["vocab"]
    suffix = model["end_of_word_suffix"] or ""
    letters = byte_letters()
    size = max([*vocab.values(), *(t["id"] for t in whole["added_tokens"])]) + 1
    tokens = [""] * size
    for token, i in vocab.items():
        tokens[i] = token
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    for token, i in special.items():
        tokens[i] = token
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    split = next(p for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "tokens": tokens,
        "special": special,
        "pattern": split["pattern"]["Regex"],
        "inner": np.array([vocab[x] for x in letters], np.int32),
        "final": np.array([vocab[x + suffix] for x in letters], np.int32),
        "left": left,
        "right": right,
        "made": made,
    }


class Encoder:
    """Encodes texts with one tokenizer; keeps the words it has met, up to CACHE_WORDS.

    The ids of a word are kept as little-endian bytes, `width` bytes each. With `texts`, the ids in decimal
    and the tokens are kept as well, both joined by one space.
    """

    def __init__(self, spec: dict, special_tokens: bool = True, texts: bool = False):
        self.spec, self.texts = spec, texts
        self.kind = "<u2" if len(spec["tokens"]) <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.decimal = [str(i) for i in range(len(spec["tokens"]))] if texts else []
        self.find_any = regex.compile(spec["pattern"]).findall
        self.latin = spec["pattern"] == WORD_PATTERN
        self.special = spec["special"] if special_tokens else {}
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        keys = spec["left"] << 32 | spec["right"]
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.clear()

    def clear(self) -> None:
        self.raw: dict[str, bytes] = {}
        self.id_text: dict[str, str] = {}
        self.token_text: dict[str, str] = {}
        self._keep(list(self.special), np.array([*self.special.values()], np.int32), list(range(1, len(self.special) + 1)))

    def _keep(self, words: list[str], ids: np.ndarray, stops: list[int]) -> None:
        """Remember words whose ids stand one after another in `ids`, each up to its stop."""
        raw, width, start = ids.astype(self.kind).tobytes(), self.width, 0
        for word, stop in zip(words, stops):
            self.raw[word] = raw[start * width : stop * width]
            start = stop
        if self.texts:
            plain, start = ids.tolist(), 0
            decimal, tokens = [self.decimal[i] for i in plain], [self.spec["tokens"][i] for i in plain]
            for word, stop in zip(words, stops):
                self.id_text[word] = " ".join(decimal[start:stop])
                self.token_text[word] = " ".join(tokens[start:stop])
                start = stop

    def words(self, text: str) -> list[str]:
        """The pieces of a text in order; a special token found in the text is a piece of its own."""
        if self.parts is not None and any(s in text for s in self.special):
            out: list[str] = []
            for k, part in enumerate(self.parts.split(text)):
                out += [part] if k % 2 else self.find(self.normal(part))
            return out
        return self.find(self.normal(text))

    def find(self, text: str) -> list[str]:
        return LATIN_PATTERN.findall(text) if self.latin and not NOT_LATIN.search(text) else self.find_any(text)

    @staticmethod
    def normal(text: str) -> str:
        # White space never enters a piece, so it needs no normal form. Letters are lowered one by
        # one: a final sigma has no form of its own here.
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], NO_RANK).astype(np.int32)

    def learn(self, words: Iterable[str]) -> None:
        """Encode unseen words together through the pair occurrence index."""
        new = [w for w in set(words) if w not in self.raw]
        if not new:
            return
        blobs = [w.encode("utf-8", "surrogatepass") for w in new]
        flat = np.frombuffer(b"".join(blobs), np.uint8)
        ends = np.cumsum([len(b) for b in blobs])
        n = len(flat)
        symbol = self.spec["inner"][flat]
        symbol[ends - 1] = self.spec["final"][flat[ends - 1]]
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = -1
        before[np.r_[0, ends[:-1]]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            """Put the pairs that start at `positions` into the index, by rank."""
            rank = self.ranks(symbol[positions], symbol[following[positions]])
            known = rank != NO_RANK
            positions, rank = positions[known], rank[known]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, group in zip(rank[np.r_[0, cuts]].tolist(), np.split(positions, cuts)):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(following >= 0))
        left, right, made = self.spec["left"], self.spec["right"], self.spec["made"]
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = left[r], right[r]
            after = following[at]
            at = at[alive[at] & (symbol[at] == a) & (after >= 0) & (symbol[after] == b)]
            if a == b and len(at) > 1:
                # Overlapping occurrences: in a run, the first, third, fifth ... from the left.
                joined = np.r_[False, following[at[:-1]] == at[1:]]
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(joined, 0, place))
                at = at[(place - start) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            beyond = following[gone]
            symbol[at] = made[r]
            following[at] = beyond
            alive[gone] = False
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            earlier = before[at]
            enter(np.unique(np.concatenate([earlier[earlier >= 0], at[inside]])))
        self._keep(new, symbol[alive], np.cumsum(alive)[ends - 1].tolist())

    def pieces(self, texts: Iterable[str]) -> list[list[str]]:
        """Words of every text, all of them known to the cache afterwards."""
        if len(self.raw) > CACHE_WORDS:
            self.clear()
        out = [self.words(t) for t in texts]
        self.learn(set().union(*out))
        return out

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        return [np.frombuffer(self.joined(words), self.kind).tolist() for words in self.pieces(texts)]

    def joined(self, words: Iterable[str]) -> bytes:
        """The ids of known words as bytes."""
        return b"".join(map(self.raw.__getitem__, words))

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode without a decoder and with special tokens: tokens joined by one space."""
        return " ".join([self.spec["tokens"][i] for i in ids])


# The encoder of this worker: tasks that follow one another in a worker share the words met so far.
_OWN: list = []


def worker_encoder(spec: dict, special_tokens: bool, texts: bool) -> Encoder:
    if not (_OWN and _OWN[0] is spec and _OWN[1:3] == [special_tokens, texts]):
        _OWN[:] = [spec, special_tokens, texts, Encoder(spec, special_tokens, texts)]
    return _OWN[3]


def encode_texts(
    documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", special_tokens: bool = True
) -> DataFrame:
    """(`key`, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    A null text counts as empty; an empty text has no tokens and the digests of the empty string.
    Repeated rows stay repeated, further columns are ignored, an empty table gives an empty table.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(spec.value, special_tokens, texts=True)
        sha = hashlib.sha256
        for batch in batches:
            pieces = encoder.pieces(t or "" for t in batch.column(1).to_pylist())
            counts, ids, decoded = [], [], []
            for words in pieces:
                counts.append(sum(map(len, map(encoder.raw.__getitem__, words))) // encoder.width)
                ids.append(sha(" ".join(map(encoder.id_text.__getitem__, words)).encode()).hexdigest())
                decoded.append(sha(" ".join(map(encoder.token_text.__getitem__, words)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = narrow(documents, [key, text])
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_bpe")
def op1(spark, folder):
    return encode_texts(table(spark, folder, "documents"), word_bpe())
