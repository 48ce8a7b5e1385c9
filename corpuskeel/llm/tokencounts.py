"""Operator 10: token counts by scanning flat token files for separators.

A token file is a plain run of 16-bit identifiers, little-endian, with the end-of-document identifier
after every document and no index. Files are read in blocks of fixed size; within a block one
vectorised search finds the separators. A document that crosses blocks is stitched by a prefix scan over
the block summaries (separators seen, place of the last one), which are a few numbers per block.

Files are written and read through the file system of the shared folder. A writer names its file
anew in every attempt, and only names that reach the manifest table count, so lost executors and
repeated tasks leave orphans but no wrong counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, scratch_path
from .bpe import read_spec, word_bpe, worker_encoder
from .common import bounded_batches, narrow, query, table

# Tokens that one block holds (2 bytes each).
BLOCK_TOKENS = 1 << 20
# Rough size at which a writer starts its next file.
FILE_TOKENS = 1 << 27


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; a path without scheme is on the local file system (tests)."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def file_uri(spark, label: str) -> str:
    path = scratch_path(spark, label)
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def write_token_files(documents: DataFrame, tokenizer: str, end_of_document: int, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """(folder, manifest): flat token files and (file, ordinal, `key`) of every document in them.

    Special tokens that stand in a text are encoded as ordinary text, so a separator is always an end.
    A null text is empty: its separator follows the one before at once.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    folder = file_uri(spark, "token-files")
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(spec.value, special_tokens=False, texts=False)
        if encoder.width != 2:
            raise ValueError("token files hold 16-bit identifiers; the vocabulary is larger")
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        stream, name, ordinal, written = None, "", 0, 0
        end = np.array([end_of_document], "<u2").tobytes()
        try:
            for batch in batches:
                if stream is None or written >= FILE_TOKENS:
                    if stream is not None:
                        stream.close()
                    name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                    stream, ordinal, written = fs.open_output_stream(f"{root}/{name}"), 0, 0
                for words in encoder.pieces(t or "" for t in batch.column(1).to_pylist()):
                    ids = encoder.joined(words)
                    stream.write(ids + end)
                    written += len(ids) // encoder.width + 1
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], ["file", "ordinal", "key"]
                )
                ordinal += n
        finally:
            if stream is not None:
                stream.close()

    rows = narrow(documents, [key, text])
    kind = rows.schema[0].dataType.simpleString()
    manifest = rows.mapInArrow(run, f"file string, ordinal long, key {kind}")
    return folder, cut(manifest, "token-manifest").withColumnRenamed("key", key)


def count_tokens(folder: str, files: DataFrame, end_of_document: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the named files of a folder.

    `files` holds one row `file` per token file. Tokens after the last separator of a file belong to a
    document without end, which is counted too; an empty file has no documents.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            size = [fs.get_file_info(f"{root}/{n}").size // 2 for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(size, pa.int64())], ["file", "size"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for batch in batches:
            for name, block, size in zip(*[c.to_pylist() for c in batch.columns]):
                with fs.open_input_file(f"{root}/{name}") as f:
                    start = block * block_tokens
                    data = np.frombuffer(f.read_at(2 * min(block_tokens, size - start), 2 * start), "<u2")
                at = np.flatnonzero(data == end_of_document).astype(np.int64) + start
                ends = at.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]), pa.array([block], pa.int64()), pa.array([size], pa.int64()),
                        pa.array([ends], pa.list_(pa.int64())), pa.array([len(ends)], pa.int64()),
                        pa.array([ends[-1] if ends else None], pa.int64()),
                    ],
                    ["file", "block", "size", "ends", "n_ends", "last_end"],
                )

    measured = files.select("file").distinct().mapInArrow(sizes, "file string, size long").filter("size > 0")
    last_block = F.floor((F.col("size") - 1) / block_tokens)
    blocks = measured.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block"), "size")
    parts = max(1, files.sparkSession.sparkContext.defaultParallelism)
    spread = blocks.repartition(parts * 4, "file", "block")
    found = cut(spread.mapInArrow(search, "file string, block long, size long, ends array<long>, n_ends long, last_end long"), "separators")

    # The prefix scan: a few numbers per block, so a file of any size is a short series.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file", "block",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("_first"),
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("_previous"),
    )
    stitched = found.join(carried, ["file", "block"])
    lengths = F.transform(
        "ends", lambda end, i: F.struct((F.col("_first") + i).alias("ordinal"), (end - F.when(i == 0, F.col("_previous")).otherwise(F.element_at("ends", F.greatest(i, F.lit(1)))) - 1).alias("n_tokens"))
    )
    closed = stitched.select("file", F.explode(lengths).alias("d")).select("file", "d.ordinal", "d.n_tokens")
    tail = (
        found.groupBy("file")
        .agg(F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("_last"), F.max("size").alias("_size"))
        .filter("_last < _size - 1")
        .select("file", "ordinal", (F.col("_size") - 1 - F.col("_last")).alias("n_tokens"))
    )
    return closed.unionByName(tail)


def document_tokens(documents: DataFrame, tokenizer: str, end_of_document: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_tokens) of every row: token files are written, scanned, and met with their manifest.

    A null or empty text has 0 tokens; rows with null keys and repeated rows are returned as they come;
    further columns are ignored; an empty table gives an empty one.
    """
    folder, manifest = write_token_files(documents, tokenizer, end_of_document, key, text)
    counts = count_tokens(folder, manifest.select("file"), end_of_document)
    return manifest.join(counts, ["file", "ordinal"]).select(key, "n_tokens")


@query("op10_tokens")
def op10(spark, folder):
    tokenizer = word_bpe()
    return document_tokens(table(spark, folder, "documents"), tokenizer, read_spec(tokenizer)["special"]["<|endoftext|>"])
