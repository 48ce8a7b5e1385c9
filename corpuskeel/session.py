"""Session helpers: a local session for tests and bench, and the shared scratch folder.

Lineage is cut by writing a table below `spark.checkpoint.dir`, so that losing an executor never
costs more than the stage at hand. On a cluster that setting has to name a shared folder; only a
local master gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
# Scratch paths of the open scopes, innermost last.
_OWNERS: list[list[str]] = []


def local_session(cores: int | str = 8, app: str = "corpuskeel", **conf) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a fresh local folder only under a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOT[app]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without stands on the file system that Spark itself would use."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def file_system(uri: str):
    """(file system, path in it) for reading or writing a qualified path inside a task."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/corpuskeel/{label}-{uuid.uuid4().hex}"
    for paths in _OWNERS:
        paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Owns all scratch tables made inside and deletes them at the end, also after an error.

    Results of queries are lazy and read these tables, so they have to be written or collected before the
    scope ends. Scopes nest; the tables of an inner one are gone when it ends.
    """
    paths: list[str] = []
    _OWNERS.append(paths)
    try:
        yield paths
    finally:
        _OWNERS[:] = [held for held in _OWNERS if held is not paths]
        for path in paths:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: short lineage, columnar, durable."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by `cut` (used between rounds of a loop)."""
    roots = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for root in roots:
        if "/corpuskeel/" in root:
            delete_path(spark, root)
