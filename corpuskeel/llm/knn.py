"""Operator 2: exact top-k search as a Voronoi kNN join over integer inner products.

Every vector goes to the cell of its nearest pivot. A cell is summed up by its size and its radii. For
a query q and a cell with pivot p, a vector v at distance r from p scores between q.p - |q| r and
q.p + |q| r. The cells' lower bounds and the pivots' own scores give each query a score that its k-th
best is sure to reach; that gives each group of queries, per cell, the least radius a vector must have to
matter to any of them. Only vectors beyond it are copied to the group, and a group goes only to slices
that hold cells it reaches. Groups are solved locally, against slices of neighbouring cells of bounded
size, with whole cells skipped per query; the slices' best are merged by score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .common import bounded_batches, narrow, query, table

# Pivots grow with the square root of the vectors, from the first number to the second: a bounded sample.
PIVOTS, MOST_PIVOTS = 64, 1024
# Queries of one group and vectors of one slice: they bound what a task holds.
GROUP_QUERIES = 2048
SLICE_ROWS = 16_384
# Products above this bound are not exact as doubles and are summed as integers.
EXACT = 2.0**53
# Components beyond the first bound fit no long; scores beyond the second are stated as the nearest long.
LONGEST, SATURATED = 2.0**63, 9.2e18


def quantised(values: list | None, scale: int) -> np.ndarray | None:
    """floor(scale * x) as integers; None if the vector is null, or if a component is null, not finite, or fits no long."""
    if values is None or any(x is None for x in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(scale * x)
    return x.astype(np.int64) if (np.abs(x) < LONGEST).all() else None


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of `one` with all rows of `two`."""
    if not one.size or not two.size:
        return np.zeros((len(one), len(two)), np.int64)
    size = float(np.abs(one.astype(np.float64)).max()) * float(np.abs(two.astype(np.float64)).max()) * one.shape[1]
    if size < EXACT:
        return (one.astype(np.float64) @ two.astype(np.float64).T).astype(np.int64)
    if size < LONGEST:
        return one @ two.T
    return np.clip(one.astype(object) @ two.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def vectors_of(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), dim)


class Cells:
    """Pivots by dimension. A dimension without pivots has one cell around the origin."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots

    def of(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.zeros((1, dim), np.int64))

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and the distance from it."""
        p = self.of(vectors.shape[1]).astype(np.float64)
        v = vectors.astype(np.float64)
        square = (v**2).sum(1)[:, None] - 2 * (v @ p.T) + (p**2).sum(1)[None, :]
        cell = square.argmin(1)
        return cell, np.sqrt(((v - p[cell]) ** 2).sum(1))


def bounds(queries: np.ndarray, pivots: np.ndarray, size: np.ndarray, radius: np.ndarray, need: int):
    """(floor, inner, norm): a score that the k-th best of each query reaches, q.p and |q|.

    `need` vectors are counted: k and as many as the query's own key may hold. Pivots are vectors
    themselves, so the need-th best of their scores is a floor as well.
    """
    inner = queries.astype(np.float64) @ pivots.astype(np.float64).T
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    low = inner - norm[:, None] * radius[None, :]
    order = np.argsort(-low, axis=1)
    reached = np.cumsum(size[order], axis=1) >= need
    place = reached.argmax(axis=1)
    floor = np.take_along_axis(low, order, 1)[np.arange(len(queries)), place]
    floor[~reached.any(axis=1)] = -np.inf
    if inner.shape[1] >= need:
        floor = np.maximum(floor, -np.partition(-inner, need - 1, axis=1)[:, need - 1])
    longest = np.sqrt((pivots.astype(np.float64) ** 2).sum(1)) + radius
    slack = 1e-6 + 1e-12 * norm * longest.max(initial=0.0)
    floor = floor - 1e-6 * np.abs(np.where(np.isfinite(floor), floor, 0.0)) - slack
    # Scores beyond a long tie, so no floor lies among them.
    return np.where(floor < -SATURATED, -np.inf, np.minimum(floor, SATURATED)), inner, norm


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 64, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(query_id, rank, `key`, score): each query's k highest scores, ties to the smaller key.

    `queries` and `vectors` have `key` and `value`; a vector with the query's own key is no candidate.
    Vectors that are null or hold components that are null, not finite or too large for a long, and rows
    without a key, take no part; only vectors of the query's dimension are compared. Sums are exact; a score
    that fits no long is stated as the nearest long. Rows repeated with the same key and vector count
    once. Of a key with several vectors each is a candidate, and its list ranks the scores of all of them.
    Keys may be integers, strings, dates or decimals. Empty tables give an empty result. Further columns are
    ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind, arrow_kind = dict(vectors.dtypes)[key], to_arrow_type(vectors.schema[key].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [quantised(x, scale) for x in batch.column(1).to_pylist()]
            keep = [i for i, x in enumerate(got) if x is not None and len(x) and batch.column(0)[i].is_valid]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array([len(got[i]) for i in keep], pa.int32()),
                    pa.array([got[i].tobytes() for i in keep], pa.binary()),
                ],
                ["id", "dim", "vector"],
            )

    schema = f"id {kind}, dim int, vector binary"
    data = narrow(vectors, [key, value]).mapInArrow(read, schema).withColumn("is_query", F.lit(False))
    asked = narrow(queries, [key, value]).mapInArrow(read, schema).withColumn("is_query", F.lit(True))
    plain = cut(data.unionByName(asked).distinct(), "knn-vectors")

    held = plain.filter("not is_query").groupBy("id").count().agg(F.sum("count"), F.max("count")).first()
    n_pivots = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(held[0] or 0)))
    need = k + (held[1] or 0)
    picked = plain.filter("not is_query").orderBy(F.xxhash64("id"), "vector").limit(n_pivots).collect()  # a bounded sample
    by_dim: dict[int, list[bytes]] = {}
    for r in picked:
        by_dim.setdefault(r.dim, []).append(bytes(r.vector))
    cells = spark.sparkContext.broadcast({d: vectors_of(list(dict.fromkeys(b)), d) for d, b in by_dim.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Cells(cells.value)
        for batch in batches:
            frame = batch.to_pandas()
            frame["cell"], frame["radius"] = np.int32(0), 0.0
            for dim, rows in frame.groupby("dim").groups.items():
                cell, radius = space.assign(vectors_of(frame.loc[rows, "vector"].tolist(), dim))
                frame.loc[rows, "cell"], frame.loc[rows, "radius"] = cell.astype(np.int32), radius
            yield pa.RecordBatch.from_pandas(frame[["id", "dim", "vector", "is_query", "cell", "radius"]], preserve_index=False, schema=placed_schema)

    placed_schema = pa.schema([*data_fields(arrow_kind), ("cell", pa.int32()), ("radius", pa.float64())])
    placed = cut(plain.mapInArrow(place, f"{schema}, is_query boolean, cell int, radius double"), "knn-cells")

    # At most one row per pivot (and per dimension without pivots).
    summary = placed.groupBy("dim", "cell").agg(
        F.count(F.when(~F.col("is_query"), 1)).alias("size"),
        F.coalesce(F.max(F.when(~F.col("is_query"), F.col("radius"))), F.lit(0.0)).alias("radius"),
        F.count(F.when(F.col("is_query"), 1)).alias("n_queries"),
    ).toPandas().sort_values(["dim", "cell"])
    summary["first_group"], summary["groups"] = packed(summary, "n_queries", GROUP_QUERIES)
    summary["first_slice"], summary["slices"] = packed(summary, "size", SLICE_ROWS)
    shared = spark.sparkContext.broadcast(summary)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query group and cell: the least radius from which a vector can matter."""
        space, cell_table = Cells(cells.value), shared.value
        for batch in batches:
            frame = batch.to_pandas()
            for dim, rows in frame.groupby("dim"):
                own = cell_table[(cell_table["dim"] == dim) & (cell_table["size"] > 0)]
                if not len(own):
                    continue
                q = vectors_of(rows["vector"].tolist(), dim)
                pivots = space.of(dim)[own["cell"].to_numpy()]
                floor, inner, norm = bounds(q, pivots, own["size"].to_numpy(), own["radius"].to_numpy(), need)
                least = np.where(norm[:, None] > 0, (floor[:, None] - inner) / np.maximum(norm[:, None], 1e-300), -np.inf)
                group = groups_of(rows, cell_table)
                for g in np.unique(group):
                    m = least[group == g].min(axis=0)
                    reach = own["radius"].to_numpy() >= m - 1e-6 * (1 + np.abs(own["radius"].to_numpy()))
                    one, m = own[reach], m[reach]
                    whole = [np.full(len(one), g), np.full(len(one), dim), *[one[c].to_numpy() for c in ("cell", "first_slice", "slices")]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in whole], pa.array(m)], wanted_names)

    asked = placed.filter("is_query")
    wanted_names = ["group", "dim", "cell", "first_slice", "slices", "least"]
    wanted = asked.mapInArrow(needs, "group int, dim int, cell int, first_slice int, slices int, least double")
    wanted = wanted.groupBy(*wanted_names[:-1]).agg(F.min("least").alias("least"))
    copies = placed.filter("not is_query").join(wanted, ["dim", "cell"]).filter("radius >= least - 1e-6 * (1 + radius)").drop("least", "radius")
    copies = copies.withColumn("slice", (F.col("first_slice") + F.pmod(F.xxhash64("id"), "slices")).cast("int"))
    reached = wanted.select("group", F.explode(F.sequence("first_slice", F.col("first_slice") + F.col("slices") - 1)).alias("slice")).distinct()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            group = groups_of(frame, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *batch.columns], ["group", *batch.schema.names])

    numbered = asked.drop("radius").mapInArrow(number, f"group int, {schema}, is_query boolean, cell int")
    sent = numbered.join(reached, "group")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        ask, have = part[part["is_query"]], part[~part["is_query"]]
        out = []
        if len(ask) and len(have):
            cell_table, dim = shared.value, int(ask["dim"].iloc[0])
            own = cell_table[(cell_table["dim"] == dim) & (cell_table["size"] > 0)]
            q = vectors_of(ask["vector"].tolist(), dim)
            floor, inner, norm = bounds(q, Cells(cells.value).of(dim)[own["cell"].to_numpy()], own["size"].to_numpy(), own["radius"].to_numpy(), need)
            high = inner + norm[:, None] * own["radius"].to_numpy()[None, :]
            cell_place = {c: i for i, c in enumerate(own["cell"])}
            have = have.sort_values("id", kind="stable")
            v, ids, at = vectors_of(have["vector"].tolist(), dim), have["id"].to_numpy(), have["cell"].map(cell_place).to_numpy()
            names = ask["id"].to_numpy()
            for start in range(0, len(q), 128):
                rows = slice(start, start + 128)
                open_ = (high[rows] + 1e-6 * np.abs(high[rows]) >= floor[rows, None]).any(axis=0)[at]  # whole cells out of reach are skipped
                some, own_ids = v[open_], ids[open_]
                score = products(q[rows], some)
                for i, name in enumerate(names[rows]):
                    other = np.flatnonzero(own_ids != name)
                    s = score[i, other]
                    if len(s) > k:
                        cut_at = np.partition(s, len(s) - k)[len(s) - k]
                        sure = np.flatnonzero(s >= cut_at)
                    else:
                        sure = np.arange(len(s))
                    best = sure[np.lexsort((own_ids[other[sure]], -s[sure]))][:k]
                    out.append(pd.DataFrame({"query_id": name, "id": own_ids[other[best]], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    columns = ["group", "slice", "id", "dim", "cell", "vector", "is_query"]
    local = (
        copies.select(columns)
        .unionByName(sent.select(columns))
        .groupBy("group", "slice")
        .applyInPandas(solve, f"query_id {kind}, id {kind}, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def data_fields(kind: pa.DataType) -> list[tuple[str, pa.DataType]]:
    return [("id", kind), ("dim", pa.int32()), ("vector", pa.binary()), ("is_query", pa.bool_())]


def packed(summary: pd.DataFrame, count: str, most: int) -> tuple[list[int], list[int]]:
    """(first place, number of places) of every cell, if places take about `most` of what `count` counts.

    Cells are packed in order, a dimension never shares a place with another one, and a cell with more than
    a place takes is spread over several.
    """
    firsts, parts, place, filled, last = [], [], -1, most, None
    for dim, n in zip(summary["dim"], summary[count]):
        if n and (filled + n > most or dim != last):
            place, filled, last = place + 1, 0, dim
        wide = max(1, math.ceil(n / most))
        firsts.append(max(place, 0))
        parts.append(wide)
        place, filled = place + wide - 1, filled + n if wide == 1 else most
    return firsts, parts


def groups_of(frame: pd.DataFrame, cell_table: pd.DataFrame) -> np.ndarray:
    own = cell_table.set_index(["dim", "cell"])[["first_group", "groups"]].reindex(pd.MultiIndex.from_frame(frame[["dim", "cell"]]))
    share = pd.util.hash_array(frame["id"].to_numpy()) % own["groups"].to_numpy().astype(np.uint64)
    return (own["first_group"].to_numpy() + share.astype(np.int64)).astype(np.int32)


SQL_KNN = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


@query("op2_topk", SQL_KNN)
def op2(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
