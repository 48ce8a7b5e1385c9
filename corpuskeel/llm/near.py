"""Operator 6: MinHash near-duplicates by a multi-index Hamming join.

A document's signature is 64 symbols of 16 bits, the low bits of 64 min-hashes of its set of 5-word
shingles. The signature is cut into 16 chunks of four symbols. Two signatures that differ in at most
31 symbols have a chunk with at most one error (pigeonhole: 16 chunks with two errors each would make
32). The allowed errors of a chunk are enumerated: each of its symbols in turn is left out, and the
other three form an equi-join key. So all pairs within the distance share one of 64 keys, with no
pair lost. Sets that share 75 % differ in 16 symbols on average; the chance that such a pair differs in
more than 31 is about 10^-5, and it falls fast above 75 %. Every link is confirmed on the full sets.

Only connectivity is wanted, so no bucket is ever expanded into its pairs:

1. Equal sets are folded into one class first; a class of any size is one aggregate.
2. Every member of a bucket is compared with the bucket's smallest member. Confirmed links contract
   most groups of copies at once, at a cost in proportion to the members.
3. Buckets whose other members still lie in different components are opened. Signatures decide first,
   in tiles of bounded size, which members have a partner left; only these bring their text, and each
   pair is compared in the first bucket that it shares. A task joins what it confirms and skips pairs
   that are tied already; only its links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.skew import join_per_key
from ..session import cut
from . import shingles as S
from .common import bounded_batches, narrow, query, table

PERCENT = 75
SYMBOLS, CHUNKS = 64, 16
WIDTH = SYMBOLS // CHUNKS
DISTANCE = 2 * CHUNKS - 1
SEED = 20240601

# Members of a bucket that one task compares with one another (a tile is two such blocks).
TILE = 384
# Members of a star that one task compares with their centre.
STAR = 256


def sketches(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, set_id, signature, content): one narrow row per document, whole texts read once.

    `content` is a hash of the text, which together with the id finds the text again."""
    bounded_batches(documents.sparkSession)
    family = S.minhash_family(SYMBOLS, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, signatures = [], [], []
            for value in batch.column(1):
                shingles = S.shingle_set(value.as_py())
                sizes.append(len(shingles))
                sets.append(S.set_digest(shingles) if len(shingles) else None)
                signatures.append(S.minhash(shingles, family).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(signatures, pa.binary()), batch.column(2)],
                ["id", "n_shingles", "set_id", "signature", "content"],
            )

    rows = narrow(documents, [key, text]).toDF("id", "text").withColumn("content", F.xxhash64("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_shingles long, set_id binary, signature binary, content long")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(key, id): 64 keys per signature. A key holds its number and the three symbols that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                symbols = as_symbols(part.column(1).to_pylist()).astype(np.int64).reshape(-1, CHUNKS, WIDTH)
                keys = np.empty((len(symbols), CHUNKS, WIDTH), np.int64)
                for left_out in range(WIDTH):
                    kept = [j for j in range(WIDTH) if j != left_out]
                    number = (np.arange(CHUNKS) * WIDTH + left_out) << 48
                    keys[:, :, left_out] = number + (symbols[:, :, kept[0]] << 32) + (symbols[:, :, kept[1]] << 16) + symbols[:, :, kept[2]]
                place = pa.array(np.repeat(np.arange(len(symbols)), SYMBOLS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(place)], ["key", "id"])

    rows = classes.select("id", "signature")
    return rows.mapInArrow(run, f"key long, id {rows.schema[0].dataType.simpleString()}")


def as_symbols(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, SYMBOLS)


def open_pairs(number: int, symbols: np.ndarray, component: np.ndarray, centre: np.ndarray, block: np.ndarray, i: int, j: int):
    """Pairs (left, right, distance) of a tile that only this bucket compares.

    They lie in different components, within the distance, without the bucket's smallest member (its
    pairs are known), and share no bucket of a smaller number.
    """
    rows = np.flatnonzero(block == i)
    others = rows if i == j else np.flatnonzero(block == j)
    out = []
    for n, row in enumerate(rows):
        right = others[n + 1 :] if i == j else others
        if centre[row] or not len(right):
            continue
        right = right[(component[right] != component[row]) & ~centre[right]]
        if not len(right):
            continue
        equal = symbols[right] == symbols[row]
        distance = SYMBOLS - np.count_nonzero(equal, axis=1)
        near = distance <= DISTANCE
        if not near.any():
            continue
        right, equal, distance = right[near], equal[near].reshape(-1, CHUNKS, WIDTH), distance[near]
        hits = equal.sum(axis=2)
        chunk = (hits >= WIDTH - 1).argmax(axis=1)
        at = np.arange(len(right))
        left_out = np.where(hits[at, chunk] == WIDTH, 0, equal[at, chunk].argmin(axis=1))
        own = chunk * WIDTH + left_out == number
        out.append(np.stack([np.full(own.sum(), row), right[own], distance[own]]))
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


def _tile_arrays(part: pd.DataFrame):
    return (
        int(part["key"].iloc[0]) >> 48,
        as_symbols(part["signature"].tolist()),
        pd.factorize(part["component"])[0],
        (part["id"] == part["leader"]).to_numpy(),
        part["block"].to_numpy(),
        int(part["i"].iloc[0]),
        int(part["j"].iloc[0]),
    )


def _participants(part: pd.DataFrame) -> pd.DataFrame:
    pairs = open_pairs(*_tile_arrays(part))
    return part.iloc[np.unique(pairs[:2])][["key", "i", "j", "id"]]


def _tile_links(part: pd.DataFrame) -> pd.DataFrame:
    left, right, distance = open_pairs(*_tile_arrays(part))
    sets = [S.shingle_set(t) for t in part["text"]]
    root = pd.factorize(part["component"])[0]
    ids, links = part["id"].to_numpy(), []
    for at in np.argsort(distance, kind="stable"):
        a, b = left[at], right[at]
        if root[a] != root[b] and S.similar(sets[a], sets[b], PERCENT):
            root[root == root[b]] = root[a]
            links.append((ids[a], ids[b]))
    return pd.DataFrame(links, columns=["src", "dst"])


def _star_links(part: pd.DataFrame) -> pd.DataFrame:
    here = part["id"] == part["leader"]
    centre = S.shingle_set(part.loc[here, "text"].iloc[0])
    rest = part.loc[~here]
    good = [S.similar(centre, S.shingle_set(t), PERCENT) for t in rest["text"]]
    return pd.DataFrame({"src": rest["id"], "dst": rest["leader"]})[np.array(good, bool)]


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_shingles, component_id, kept) for every row of `documents`.

    Texts without words are linked with nothing. A row without a key is linked with nothing either: its
    component is null and it is kept. A key names one document: repeated rows are returned as often as
    they come and fall in one component, also if their texts differ; each text is compared with all others.
    Further columns are ignored; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    rows = cut(sketches(documents, key, text), "sketches")
    counted = rows.filter("n_shingles > 0 AND id IS NOT NULL")
    folded = counted.groupBy("set_id").agg(F.min(F.struct("id", "content")).alias("_r"), F.first("signature").alias("signature"))
    # Keys that come with several sets. A class is named by its smallest key, or by a name of its own if that is one of them.
    several = cut(counted.groupBy("id").agg((F.min("set_id") != F.max("set_id")).alias("_m")).filter("_m").select(F.col("id").alias("_several")), "several-sets")
    folded = folded.select("set_id", "signature", F.col("_r.id").alias("first_id"), "_r.content").join(several, F.col("first_id") == F.col("_several"), "left")
    whole = rows.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind = "bigint" if whole else "string"
    own = F.xxhash64("first_id", "set_id") if whole else F.concat_ws("\x00", "first_id", F.hex("set_id"))
    classes = cut(folded.select("set_id", "signature", "first_id", "content", F.when(F.col("_several").isNull(), F.col("first_id")).otherwise(own).cast(kind).alias("id")), "classes")
    # The sets of one key belong together: links from each of its classes to the least of them.
    named = counted.join(several, F.col("id") == F.col("_several"), "left_semi").select(F.col("id").alias("_k"), "set_id").distinct().join(classes.select("set_id", "id"), "set_id")
    bridges = named.join(named.groupBy("_k").agg(F.min("id").alias("dst")), "_k").filter("id <> dst").select(F.col("id").alias("src"), "dst")
    bridges = cut(bridges.distinct(), "bridges")

    keys = chunk_keys(classes)
    shared = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("n")).filter("leader < _last")
    members = cut(keys.join(shared.drop("_last"), "key"), "bucket-members")

    star = cut(members.filter("id <> leader").select("id", "leader").distinct(), "stars")
    compared = star.select("id").unionByName(star.select(F.col("leader").alias("id"))).distinct()
    ends = bridges.select(F.col("src").alias("id")).unionByName(bridges.select(F.col("dst").alias("id")))
    needed = compared.unionByName(ends).distinct()
    plain = narrow(documents, [key, text]).toDF("first_id", "text").withColumn("content", F.xxhash64("text"))
    wanted = classes.join(compared, "id", "left_semi").select("id", "first_id", "content")
    # The ids grow with the corpus, so they are never broadcast, at no size.
    texts = cut(plain.join(wanted.hint("merge"), ["first_id", "content"]).groupBy("id").agg(F.max("text").alias("text")), "texts")

    sizes = star.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("_slices"))
    placed = star.join(sizes, "leader").select("leader", "id", F.pmod(F.xxhash64("id"), F.col("_slices")).alias("slice"))
    centres = placed.select("leader", "slice").distinct().select("leader", F.col("leader").alias("id"), "slice")
    first = (
        placed.unionByName(centres)
        .join(texts, "id")
        .groupBy("leader", "slice")
        .applyInPandas(_star_links, f"src {kind}, dst {kind}")
    )
    first = cut(first.unionByName(bridges), "star-links")

    # Only classes that share a bucket can be in a component with another one.
    tied = cut(connected_components(needed, first), "first-components")
    labelled = members.join(tied, "id")
    mixed = (
        labelled.filter("id <> leader")
        .groupBy("key")
        .agg(F.min("component").alias("_a"), F.max("component").alias("_b"))
        .filter("_a <> _b")
        .select("key")
    )
    grid = F.ceil(F.col("n") / TILE).cast("int")
    tiles = (
        labelled.join(mixed, "key", "left_semi")
        .join(classes.select("id", "signature"), "id")
        .withColumn("_g", grid)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("_g")).cast("int"))
        .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        .select(
            "key", "id", "leader", "component", "signature", "block",
            F.least("block", "_x").alias("i"), F.greatest("block", "_x").alias("j"),
        )
    )
    tiles = cut(tiles, "tiles")
    active = tiles.groupBy("key", "i", "j").applyInPandas(_participants, f"key long, i int, j int, id {kind}")
    second = (
        tiles.join(cut(active, "participants"), ["key", "i", "j", "id"], "left_semi")
        .join(texts, "id")
        .groupBy("key", "i", "j")
        .applyInPandas(_tile_links, f"src {kind}, dst {kind}")
    )
    links = first.unionByName(cut(second, "tile-links"))
    final = cut(connected_components(needed, links), "components")

    if not several.isEmpty():
        # Names of classes that are no keys must not name a component: the least key of its classes does.
        firsts = final.join(classes.select("id", "first_id"), "id")
        low = firsts.groupBy("component").agg(F.min("first_id").alias("_low"), F.count(F.lit(1)).alias("_n"))
        final = join_per_key(final, low, ["component"], "_n").select("id", F.col("_low").alias("component"))
    tied_sets = classes.join(final, "id", "left").select("set_id", F.coalesce("component", "first_id").alias("_c"))
    return rows.join(tied_sets, "set_id", "left").select(
        F.col("id").alias(key),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("_c", "id")).alias("component_id"),
        F.coalesce(F.coalesce("_c", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


SQL_NEAR = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
long AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM long a JOIN long b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN low ON a = doc_id"""


@query("op6_near", SQL_NEAR)
def op6(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
