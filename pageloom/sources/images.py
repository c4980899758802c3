"""Page images: binary files as a source, PNG (8-bit gray, RGB, RGBA) and PPM decoding, PNG encoding."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PNG = b"\x89PNG\r\n\x1a\n"


def pages(spark: SparkSession, path: str, direction: str = "RTL") -> DataFrame:
    """(page_id, path, direction, image): image bytes as they are; ids from the path."""
    read = spark.read.format("binaryFile").load(path)
    return read.select(F.xxhash64("path").alias("page_id"), "path", F.lit(direction).alias("direction"), F.col("content").alias("image"))


def decode(data: bytes) -> np.ndarray:
    """RGB pixels; ValueError for empty or unreadable bytes."""
    if not data:
        raise ValueError("an image has no bytes")
    if data[:2] == b"P6":
        head = re.match(rb"P6\s+(\d+)\s+(\d+)\s+255\s", data)
        if not head:
            raise ValueError("unreadable PPM")
        w, h = int(head[1]), int(head[2])
        if len(data) - head.end() < 3 * w * h:
            raise ValueError("truncated PPM")
        return np.frombuffer(data, np.uint8, 3 * w * h, head.end()).reshape(h, w, 3).copy()
    if data[:8] != _PNG:
        raise ValueError("unknown image format")
    at, packed, head = 8, b"", None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += 12 + size
    if not head or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("only 8-bit gray, RGB and RGBA without interlacing")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    try:
        raw = zlib.decompress(packed)
    except zlib.error as e:
        raise ValueError("unreadable PNG") from e
    stride, out, before = w * channels, np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.int64)
    for y in range(h):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, channels), axis=0).reshape(-1)
        elif kind == 2:
            line = line + before
        elif kind in (3, 4):
            line = np.array(_unfiltered(line.tolist(), before.tolist(), channels, kind))
        before = line & 255
        out[y] = before
    pixels = out.reshape(h, w, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, :3].copy()


def _unfiltered(line: list[int], before: list[int], channels: int, kind: int) -> list[int]:
    """A row whose bytes depend on those to their left: mean (3) or the closest neighbour (4)."""
    left, corner = [0] * channels + line, [0] * channels + before
    for x, b in enumerate(before):
        a = left[x]
        if kind == 3:
            more = (a + b) >> 1
        else:
            c = corner[x]
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            more = a if p <= q and p <= r else b if q <= r else c
        left[x + channels] = (left[x + channels] + more) & 255
    return left[channels:]


def sizes(pages: DataFrame, image_col: str = "image") -> DataFrame:
    """pages with width, height and error: why the image can't be read, null for one that can."""

    def run(batches):
        for rows in batches:
            found = []
            for data in rows[image_col]:
                try:
                    pixels = decode(bytes(data) if data is not None else b"")
                    found.append((pixels.shape[1], pixels.shape[0], None))
                except ValueError as e:
                    found.append((None, None, str(e)))
            width, height, error = zip(*found, strict=True) if found else ([], [], [])
            yield rows.assign(width=pd.array(width, dtype="Int32"), height=pd.array(height, dtype="Int32"), error=pd.Series(error, index=rows.index, dtype=object))

    schema = T.StructType([*pages.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("error", T.StringType())])
    return pages.mapInPandas(run, schema)


def encode(pixels: np.ndarray) -> bytes:
    """PNG bytes of RGB pixels."""
    h, w = pixels.shape[:2]
    rows = np.concatenate((np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)), axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
