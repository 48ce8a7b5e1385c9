"""ZIP archives as a Spark data source: one row per member, nothing extracted to disk.

`spark.read.format("zip_members").option("ranges", 4).load("/folder/*.zip")`. Every archive is read
as `ranges` partitions, small archives bundled; a task opens each archive, reads its directory and streams its
own members in blocks, so neither archives nor members have to fit in memory. With `content=true` the bytes of each
member are returned as well.
"""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import file_system, qualified, scratch_path

BLOCK = 1 << 20
# Archives are bundled up to this size, so that partitions follow the bytes and not the number of archives.
BUNDLE_BYTES = 8 << 20
SCHEMA = (
    "archive string, member string, bytes long, compressed_bytes long, crc_ok boolean, sha256 string, "
    "problem string, content binary"
)


@dataclass
class MemberRange(InputPartition):
    paths: tuple[str, ...]
    index: int
    ranges: int

    def __post_init__(self):
        super().__init__(self.index)


def _directory_problem(info: zipfile.ZipInfo, repeated: bool, max_bytes: int, min_bytes: int = 1) -> str | None:
    name = info.filename
    kind = (info.external_attr >> 28) & 0xF
    if repeated:
        return "duplicate_member"
    if name.startswith("/") or "\\" in name or ":" in name or any(p in ("", ".", "..") for p in name.rstrip("/").split("/")):
        return "unsafe_path"
    if info.is_dir() or info.flag_bits & 0x41:
        return "directory_or_encrypted"
    if kind not in (0, 8) or info.external_attr & 0x10:
        return "not_regular"
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return "unsupported_compression"
    if not min_bytes <= info.file_size <= max_bytes:
        return "size_out_of_bounds"
    return None


class MemberReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.ranges = int(options.get("ranges", 1))
        self.max_bytes = int(options.get("max_member_bytes", 1 << 31))
        self.min_bytes = int(options.get("min_member_bytes", 1))
        self.content = str(options.get("content", "false")).lower() == "true"

    def partitions(self):
        from pyarrow import fs

        folder, _, pattern = self.path.rpartition("/")
        system, base = file_system(folder)
        scheme = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
        import fnmatch

        files = sorted(
            (info.path, info.size)
            for info in system.get_file_info(fs.FileSelector(base))
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, pattern)
        )
        bundles, room = [], 0
        for name, size in files:
            if not bundles or size > room:
                bundles.append([])
                room = BUNDLE_BYTES
            bundles[-1].append(scheme + name)
            room -= size
        return [MemberRange(tuple(names), r, self.ranges) for names in bundles for r in range(self.ranges)]

    def read(self, partition: MemberRange) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self._members(path, partition)

    def _members(self, uri: str, partition: MemberRange) -> Iterator[tuple]:
        system, path = file_system(uri)
        archive_name = path.rsplit("/", 1)[-1]
        with system.open_input_file(path) as handle, zipfile.ZipFile(handle) as archive:
            seen: set[str] = set()
            for number, info in enumerate(archive.infolist()):
                repeated = info.filename in seen
                seen.add(info.filename)
                if number % partition.ranges != partition.index:
                    continue
                problem = _directory_problem(info, repeated, self.max_bytes, self.min_bytes)
                row = (archive_name, info.filename, info.file_size, info.compress_size)
                if problem:
                    yield (*row, None, None, problem, None)
                    continue
                digest, size, kept = hashlib.sha256(), 0, bytearray()
                try:
                    with archive.open(info) as stream:
                        while block := stream.read(BLOCK):
                            digest.update(block)
                            size += len(block)
                            if self.content:
                                kept += block
                except zipfile.BadZipFile:
                    yield (*row, False, None, "crc_mismatch", None)
                    continue
                problem = None if size == info.file_size else "size_mismatch"
                yield (*row, True, digest.hexdigest(), problem, bytes(kept) if self.content else None)


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def archive_members(spark: SparkSession, path: str, ranges: int = 1, content: bool = False, max_member_bytes: int = 1 << 31, min_member_bytes: int = 1, **options) -> DataFrame:
    """(SCHEMA) of the members of all archives `path` matches; larger and smaller members are reported, not read."""
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zip_members").option("ranges", ranges).option("content", str(content).lower())
    folder, _, pattern = path.rpartition("/")
    reader = reader.option("max_member_bytes", max_member_bytes).option("min_member_bytes", min_member_bytes)
    return reader.options(**options).load(f"{qualified(spark, folder)}/{pattern}")


def archive_contract(members: DataFrame, expected: DataFrame) -> DataFrame:
    """Members against the expected (archive, member): ok, problem of the member, missing, unexpected."""
    found = members.select("archive", "member", "problem", "sha256", F.lit(True).alias("_found"))
    wanted = expected.select("archive", "member", F.lit(True).alias("_wanted"))
    return wanted.join(found, ["archive", "member"], "full_outer").select(
        "archive",
        "member",
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("_wanted").isNull(), "unexpected")
        .otherwise(F.coalesce("problem", F.lit("ok")))
        .alias("status"),
        "sha256",
    )


def _staging_checks(members: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected members joined to the scan; an absent member or another digest fails the job."""
    found = members.select("archive", "member", "bytes", F.col("sha256").alias("_seen"), *([c for c in members.columns if c == "content"]))
    joined = selected.select("archive", "member", "sha256").join(found, ["archive", "member"], "left")
    sound = F.coalesce(F.col("_seen") == F.col("sha256"), F.lit(False))
    guard: Column = F.when(sound, True).otherwise(
        F.raise_error(F.lit("selected member absent or its digest differs")).cast("boolean")
    )
    return joined.withColumn("_ok", guard).filter("_ok").drop("_ok", "_seen")


def stage_preview(members: DataFrame, selected: DataFrame) -> DataFrame:
    return _staging_checks(members, selected).groupBy("archive").agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("bytes").alias("n_bytes")
    )


def stage_members(members: DataFrame, selected: DataFrame, label: str = "staged") -> DataFrame:
    """Copy only the selected bytes to a table by archive and hash them again after the write.

    The rows of an archive come to one task first, so there is one file per archive, not one per archive and task.
    """
    spark = members.sparkSession
    path = scratch_path(spark, label)
    _staging_checks(members, selected).repartition("archive").write.mode("errorifexists").partitionBy("archive").parquet(path)
    staged = spark.read.parquet(path)
    again = F.sha2("content", 256) == F.col("sha256")
    checked = F.when(again, True).otherwise(F.raise_error(F.lit("staged bytes changed")).cast("boolean"))
    return staged.withColumn("verified", checked).select("archive", "member", "bytes", "sha256", "verified")
