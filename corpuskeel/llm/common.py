"""What the operators of this folder share: the query table, table access, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}

# Words are separated by the ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"

# Upper bound of the bytes that one Arrow batch brings to a Python worker.
BATCH_BYTES = 4 << 20


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def narrow(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the columns an operator needs, so that further columns never clash with its own names."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: a batch of very long texts must not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
