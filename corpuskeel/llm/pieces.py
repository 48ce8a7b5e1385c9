"""Operator 11: SentencePiece encoding and decoding of merge-type models, by backtracking.

A text is normalised and cut into chunks where no piece of the vocabulary can reach across; chunks met
before come from a bounded cache. For a new chunk one Aho-Corasick pass gives the longest piece that starts
at every position. The encoder walks from the left and takes the longest piece that is compatible with the
one before it, falls back to the next shorter prefix, and steps back where none is left. Two pieces are
compatible if merging their joined letters again, by the scores of the model, gives the same two pieces.
A position that cannot be completed is marked in a bitfield and never entered again: the merged form of
everything before a position is unique, so its failure does not depend on the way that led there. The work
is linear in the chunk, and the pieces are exactly those of the merges.

The model file is a parameter; it is read on the driver and travels to the workers as a broadcast variable.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, narrow, query, table

# Chunks kept by a worker before the cache starts anew.
CACHE_CHUNKS = 600_000
SPACE = "▁"

# Fixed values of the model format: field numbers and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, SPACE_AS_SUFFIX = 3, 35, 24
CHARSMAP, DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
BPE_TYPE = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, blob[at : at + size]
        at += size


def read_model(path: str) -> dict:
    """Pieces, scores and switches of a merge-type model; other kinds of models are refused."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    trainer = dict(_fields(next((v for n, v in parts if n == TRAINER), b"")))
    normal = {DUMMY_PREFIX: 1, TRIM_SPACES: 1, ESCAPE_SPACES: 1} | dict(_fields(next((v for n, v in parts if n == NORMALIZER), b"")))
    if trainer.get(MODEL_TYPE) != BPE_TYPE or not trainer.get(BYTE_FALLBACK):
        raise ValueError("only merge-type models with byte fallback")
    if normal.get(CHARSMAP) or trainer.get(SPACE_AS_SUFFIX) or not normal[ESCAPE_SPACES]:
        raise ValueError("only identity normalisation with a leading space symbol")
    pieces, scores, kinds = [], [], []
    for number, value in parts:
        if number == PIECES:
            piece = {PIECE_KIND: NORMAL} | dict(_fields(value))
            pieces.append(piece[PIECE_TEXT].decode())
            scores.append(struct.unpack("<f", piece[PIECE_SCORE])[0])
            kinds.append(piece[PIECE_KIND])
    if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    ranks = {s: i for i, s in enumerate(sorted({*scores}, reverse=True))}
    rank = {p: ranks[s] for p, s, k in zip(pieces, scores, kinds) if k == NORMAL}
    usable = [p for p in rank if remerged(p, rank) == [p]]
    long = [p for p in usable if len(p) > 1]
    return {
        "pieces": pieces,
        "kinds": kinds,
        "rank": rank,
        "usable": usable,
        "dummy": bool(normal[DUMMY_PREFIX]),
        "trim": bool(normal[TRIM_SPACES]),
        # Cuts are safe before a space symbol and around control characters if no piece goes on there.
        "cut_spaces": not any(SPACE in p.lstrip(SPACE) for p in long),
        "cut_controls": "".join(c for c in map(chr, range(32)) if not any(c in p for p in long)),
    }


def remerged(letters: str, rank: dict[str, int]) -> list[str]:
    """The merges of the model on `letters`: best rank first, ties from the left."""
    parts = list(letters)
    while True:
        best, at = None, 0
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class PieceEncoder:
    """Encodes and decodes texts with one model; keeps the chunks and piece pairs it has met."""

    def __init__(self, model: dict):
        self.model, self.rank = model, model["rank"]
        self.ids = {p: i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"])) if k == NORMAL}
        self.byte_ids = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"])) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.automaton = ahocorasick.Automaton()
        usable = set(model["usable"])
        for piece in usable:
            if len(piece) > 1:
                self.automaton.add_word(piece, (piece, len(piece) - 1))
        self.automaton.make_automaton()
        # The next shorter piece at the same place; a single letter always remains.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in usable), p[0]) for p in usable if len(p) > 1}
        controls = re.escape(model["cut_controls"])
        pattern = rf"{SPACE}*[^{SPACE}{controls}]+|{SPACE}+" + (f"|[{controls}]" if controls else "")
        self.find = re.compile(pattern).findall if model["cut_spaces"] else lambda text: [text] if text else []
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, tuple[int, str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def normal(self, text: str) -> str:
        if self.model["trim"]:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.model["dummy"]:
            text = " " + text
        return text.replace(" ", SPACE)

    def fits(self, one: str, two: str) -> bool:
        """True when merging the letters of both again keeps them apart as they are."""
        known = self.pairs.get((one, two))
        if known is None:
            known = self.pairs[one, two] = remerged(one + two, self.rank) == [one, two]
        return known

    def pieces_of(self, chunk: str) -> list[str]:
        """The pieces of a chunk by backtracking over longest matches."""
        n = len(chunk)
        longest = list(chunk)  # a letter that starts no piece stands for itself
        for end, (piece, back) in self.automaton.iter(chunk):
            longest[end - back] = piece  # matches come by their ends, so the last one is the longest
        failed = bytearray((n >> 3) + 1)
        taken: list[str] = []
        at, piece = 0, longest[0] if n else ""
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not taken or self.fits(taken[-1], piece)):
                taken.append(piece)
                at, piece = end, longest[end] if end < n else ""
            elif len(piece) > 1:
                piece = self.shorter[piece]
            elif taken:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)
            else:
                raise AssertionError("no merged form; the model is inconsistent")
        return taken

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces_of(chunk):
            own = self.ids.get(piece)
            if own is None:
                ids += [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                ids.append(own)
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.find(self.normal(text)) for i in self.chunk_ids(chunk)]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of token ids: bytes are put together, control pieces say nothing, one leading space is dropped."""
        text = self._spelled(ids)
        return text[1:] if (self.model["dummy"] or self.model["trim"]) and text.startswith(" ") else text

    def _spelled(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            kind = self.model["kinds"][i]
            out.append(self.model["pieces"][i].replace(SPACE, " ") if kind == NORMAL else " ⁇ " if kind == UNKNOWN else "")
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def digest_parts(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal joined by commas, decoded text) of a whole text."""
        known, parts = self.known, []
        for chunk in self.find(self.normal(text)):
            part = known.get(chunk)
            if part is None:
                ids = self.chunk_ids(chunk)
                part = known[chunk] = (len(ids), ",".join(map(str, ids)), self._spelled(ids))
            parts.append(part)
        if len(known) > CACHE_CHUNKS or len(self.pairs) > CACHE_CHUNKS:
            self.clear()
        decoded = "".join([p[2] for p in parts])
        if (self.model["dummy"] or self.model["trim"]) and decoded.startswith(" "):
            decoded = decoded[1:]
        return sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), decoded


# The encoder of this worker: tasks that follow one another in a worker share what was met so far.
_OWN: list = []


def worker_encoder(model: dict) -> PieceEncoder:
    if not (_OWN and _OWN[0] is model):
        _OWN[:] = [model, PieceEncoder(model)]
    return _OWN[1]


def encode_texts(documents: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_tokens, ids) of every whole text; a null text counts as empty and has no ids.

    Repeated rows and rows without a key stay, further columns are ignored, an empty table gives an empty one.
    """
    return _coded(documents, model_file, key, text, "n_tokens long, ids array<int>", lambda e, t: ((ids := e.encode(t)) and len(ids) or 0, ids))


def encoded_digests(documents: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_tokens, ids_sha256, decoded_sha256) of every whole text, with the same rules as `encode_texts`."""

    def one(encoder: PieceEncoder, value: str) -> tuple[int, str, str]:
        n, ids, decoded = encoder.digest_parts(value)
        sha = hashlib.sha256
        return n, sha(ids.encode()).hexdigest(), sha(decoded.encode("utf-8", "surrogatepass")).hexdigest()

    return _coded(documents, model_file, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", one)


def decode_ids(tokens: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(`key`, text) of token id lists; a null list counts as empty."""
    return _coded(tokens, model_file, key, ids, "text string", lambda e, value: (e.decode(value),), [])


def _coded(rows: DataFrame, model_file: str, key: str, column: str, schema: str, one, absent="") -> DataFrame:
    spark = rows.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(read_model(model_file))
    names = [field.split(" ")[0] for field in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[field.split(" ")[1]] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            done = [one(encoder, absent if value is None else value) for value in batch.column(1).to_pylist()]
            columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", *names])

    slim = narrow(rows, [key, column])
    out = slim.mapInArrow(run, f"key {slim.schema[0].dataType.simpleString()}, {schema}")
    return out.withColumnRenamed("key", key)


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_pieces")
def op11(spark, folder):
    return encoded_digests(table(spark, folder, "documents"), piece_bpe())
