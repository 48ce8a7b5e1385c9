"""PNG bytes for pixel rows: one plain encoder for the files the image queries and tests read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def png_bytes(rgb: bytes, width: int, height: int) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(rgb, np.uint8).reshape(height, width * 3)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def png_table(pixels: DataFrame) -> DataFrame:
    """(name, content) with `<id>.png` for every pixel row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content = [png_bytes(r, w, h) for r, w, h in zip(pdf["rgb"], pdf["width"], pdf["height"])]
            yield pd.DataFrame({"name": pdf["id"] + ".png", "content": content})

    return pixels.select("id", "width", "height", "rgb").mapInPandas(run, "name string, content binary")
