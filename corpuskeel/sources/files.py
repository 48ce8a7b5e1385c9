"""File sources and sinks on the storage Spark reads: inventories, JSON lines, assets, images."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keys import is_hex64, is_positive_decimal
from ..operators.checks import ContractViolation, require_none, row_violations
from ..operators.skew import digest_tree
from ..session import file_system, qualified

# Files up to the first size are digested by Spark as one value, larger ones in blocks of the second.
LOADED_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
# Spark lists the files of a scan on the driver; scans of more files than this go folder by folder.
LISTED_FILES = 100_000
ASSETS = "path string, bytes long, sha256 string, md5 string"
RAW_INVENTORY = (
    "source string, source_id string, relative_path string, bytes string, sha256 string, width string, "
    "height string, mode string, format string, license_id string"
)
ARCHIVE_INVENTORY = "part_id string, image_name string, bytes string, sha256 string, width string, height string, mode string"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


@contextmanager
def small_files(spark: SparkSession, open_cost: int = 64 << 10) -> Iterator[None]:
    """Scans that run inside deal files to tasks at this cost of opening one.

    Spark counts 4 MB for every file, so that a task gets some thirty files however small they are, and tasks
    grow with the files, not with their bytes. A scan has to run inside, not only to be named there.
    """
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(open_cost))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def projected_scan(spark: SparkSession, path: str, columns: Sequence[str], expected_rows: int | None = None) -> DataFrame:
    """Column-pruned Parquet scan; missing columns and a wrong total fail before anything is used.

    The total comes from the footers (a count without columns), so checking it reads no data pages.
    """
    table = spark.read.parquet(path)
    absent = [c for c in columns if c not in table.columns]
    if absent:
        raise ContractViolation(f"missing columns: {absent}")
    if expected_rows is not None and table.count() != expected_rows:
        raise ContractViolation("row count differs from the declared total")
    return table.select(*columns)


def _block_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            system, inner = file_system(path)
            sha256, md5 = hashlib.sha256(), hashlib.md5(usedforsecurity=False)
            with system.open_input_stream(inner) as stream:
                while block := stream.read(BLOCK_BYTES):
                    sha256.update(block)
                    md5.update(block)
            rows.append((sha256.hexdigest(), md5.hexdigest()))
        yield pdf.assign(sha256=[r[0] for r in rows], md5=[r[1] for r in rows])


def asset_scan(
    spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, max_bytes: int | None = None, loaded: int = LOADED_BYTES
) -> DataFrame:
    """(path, bytes, sha256, md5) per file, one pass without a shuffle.

    Files of at most `loaded` bytes are read by Spark, larger ones in blocks on the executors, so no file
    is ever one value. Files above `max_bytes` get no digests; length filters reach the source, so content
    that is not digested there is never loaded. Spark deals the listing to tasks by bytes. Its file
    sources pass over files of no bytes: these are not listed.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        listing = listing.option("pathGlobFilter", glob)
    files, size = listing.load(path), F.col("length")
    wanted = files if max_bytes is None else files.filter(size <= max_bytes)
    small = wanted.filter(size <= loaded).select("path", size.alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    large = wanted.filter(size > loaded).select("path", size.alias("bytes")).mapInPandas(_block_digests, ASSETS)
    scan = small.unionByName(large)
    if max_bytes is None:
        return scan
    nothing = F.lit(None).cast("string")
    return scan.unionByName(files.filter(size > max_bytes).select("path", size.alias("bytes"), nothing.alias("sha256"), nothing.alias("md5")))


def file_digests(
    spark: SparkSession,
    path: str,
    max_bytes: int | None = None,
    glob: str | None = None,
    recursive: bool = False,
    loaded: int = LOADED_BYTES,
    root: str | None = None,
) -> DataFrame:
    """(name, bytes, sha256) of `asset_scan`; names are relative to `root`, which is `path` if not given."""
    scan = asset_scan(spark, path, glob, recursive, max_bytes, loaded)
    return scan.select(F.substring_index("path", (root or path).rstrip("/") + "/", -1).alias("name"), "bytes", "sha256")


def pinned_files(
    spark: SparkSession,
    path: str,
    pins: DataFrame,
    max_bytes: int | None = None,
    glob: str | None = None,
    recursive: bool = False,
    loaded: int = LOADED_BYTES,
    root: str | None = None,
) -> DataFrame:
    """Status per pinned file: ok, missing, too_large, size_mismatch, digest_mismatch, unpinned.

    Files above `max_bytes` are refused by length, without reading them; without it every file is digested.
    """
    files = file_digests(spark, path, max_bytes, glob, recursive, loaded, root)
    seen = files.select("name", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    return pins.join(seen, "name", "full_outer").select(
        "name",
        F.when(F.col("_b").isNull(), "missing")
        .when(F.col("sha256").isNull(), "unpinned")
        .when(F.lit(False) if max_bytes is None else F.col("_b") > max_bytes, "too_large")
        .when(F.col("_b") != F.col("bytes"), "size_mismatch")
        .when(F.col("_s") != F.col("sha256"), "digest_mismatch")
        .otherwise("ok")
        .alias("status"),
    )


def bound_table(spark: SparkSession, root: str, name: str, pins: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Read the Parquet table `name` below `root` only after all its files equal their pins.

    The table is a file or a folder of parts; `pins` (name, bytes, sha256) are relative to `root` and may
    name other tables too. A file without a pin, a pin without a file and any difference refuse the read.
    """
    path = f"{root.rstrip('/')}/{name}"
    own = pins.filter((F.col("name") == name) | F.col("name").startswith(f"{name}/"))
    report = pinned_files(spark, path, own, max_bytes, glob="*.parquet", recursive=True, root=root)
    require_none(report.filter(F.col("status") != "ok"), "input pin mismatch")
    return spark.read.parquet(path)


def read_inventory(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """CSV inventory with an exact header; malformed lines fail the read."""
    header = spark.read.option("header", True).csv(path).columns
    if header != _names(layout):
        raise ContractViolation(f"unknown inventory columns: {header}")
    return spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(layout).csv(path)


def inventory_records(inventory: DataFrame, domain: Column, identity: Column) -> DataFrame:
    """Common record view (id, domain, sha256, bytes, width, height) after the format checks."""
    view = inventory.select(
        F.concat_ws(":", domain, identity).alias("id"), domain.alias("domain"), "sha256", "bytes", "width", "height"
    )
    bad = row_violations(
        view,
        "id",
        {"sha256": is_hex64("sha256"), **{c: is_positive_decimal(c) for c in ("bytes", "width", "height")}},
    )
    require_none(bad, "inventory format")
    return view.select("id", "domain", "sha256", *[F.col(c).cast("long").alias(c) for c in ("bytes", "width", "height")])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str, schema: str, array: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested JSON documents to rows: one row per element of `array`, outer fields kept."""
    table = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return table.select(*keep, F.inline(array))


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metrics from CSV or JSON, chosen by the extension without regard to case."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    if suffix in ("json", "jsonl"):
        return read_json_lines(spark, path, schema)
    raise ContractViolation(f"unknown metrics format: {suffix}")


def run_inventory(spark: SparkSession, directory: str, glob: str | None = None) -> DataFrame:
    """Manifest of everything below a run directory, paths relative to it."""
    root = directory.rstrip("/") + "/"
    files = asset_scan(spark, directory, glob)
    return files.select(F.substring_index("path", root, -1).alias("path"), "bytes", "sha256")


def image_scan(spark: SparkSession, path: str, max_pixels: int, channels: Sequence[int] = (3,)) -> DataFrame:
    """Decoded images with status and reason; files that cannot be used stay as rejected rows."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    reason = (
        F.when(F.col("image.height") < 0, "source_decode_failure")
        .when(~F.col("image.nChannels").isin(*channels), "unsupported_source_mode_or_alpha")
        .when(F.col("image.width") * F.col("image.height") > max_pixels, "unsupported_pixel_count")
    )
    return images.select(
        F.element_at(F.split("image.origin", "/"), -1).alias("name"),
        F.when(reason.isNull(), K.STATUS_PASS).otherwise(K.STATUS_REJECT).alias("status"),
        reason.alias("reason"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        "image",
    )


def write_once(df: DataFrame, path: str, fmt: str = "parquet", **options) -> bool:
    """Write a new artifact; an existing one is kept and False is returned."""
    try:
        df.write.mode("errorifexists").options(**options).format(fmt).save(path)
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" in str(error.getCondition()):
            return False
        raise
    return True


def numbered_folder(name: str, folders: int) -> Column:
    """Folder of a file among `folders` even ones, by its name."""
    return F.pmod(F.xxhash64(name), F.lit(folders)).cast("string")


def make_folders(spark: SparkSession, root: str, folders: int) -> None:
    """The folders of `numbered_folder`, so that those without a file can be scanned too."""
    system, base = file_system(qualified(spark, root))
    for number in range(folders):
        system.create_dir(f"{base}/{number}", recursive=True)


def write_files(df: DataFrame, root: str) -> DataFrame:
    """Write (name, content) rows as single files below `root` from the executors, in an existing `folder` if there is one.

    A retried task writes the same bytes to the same names. Returns (name, bytes).
    """
    folder = qualified(df.sparkSession, root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = file_system(folder)
        target.create_dir(base, recursive=True)
        for pdf in batches:
            places = pdf["folder"] + "/" + pdf["name"] if "folder" in pdf else pdf["name"]
            for place, content in zip(places, pdf["content"]):
                with target.open_output_stream(f"{base}/{place}") as out:
                    out.write(content)
            yield pd.DataFrame({"name": pdf["name"], "bytes": pdf["content"].map(len)})

    wanted = [c for c in ("folder", "name", "content") if c in df.columns]
    return df.select(*wanted).mapInPandas(run, "name string, bytes long")


def written_bytes(df: DataFrame, root: str) -> int:
    """`write_files`, run at once; the driver gets one sum."""
    return write_files(df, root).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (tree_sha256, n_members) for a table: independent of row order and partitioning.

    A row is hashed as JSON with its columns sorted by name and nulls kept.
    """
    names = sorted(columns or df.columns)
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return digest_tree(df.select(F.sha2(body, 256).alias("_h")), [], "_h")


def counters(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[c.alias(name) for name, c in checks.items()])
