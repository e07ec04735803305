"""PNG without any image library: zlib and NumPy."""

from __future__ import annotations

import base64
import binascii
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.document import ScriptError
from ..plans.relation import Rel

#: The first bytes of a PNG file (a fixed value).
MAGIC = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(rgba: np.ndarray) -> bytes:
    """An RGBA8 image (height, width, 4) as PNG: IHDR, IDAT and IEND only, so equal pixels give equal bytes."""
    h, w, _ = rgba.shape
    raw = np.concatenate([np.zeros((h, 1), dtype=np.uint8), rgba.reshape(h, 4 * w)], axis=1).tobytes()
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if data[:8] != MAGIC:
        raise ScriptError("not a PNG")
    out, at = [], 8
    while at < len(data):
        if at + 12 > len(data):
            raise ScriptError("the PNG ends within a chunk")
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ScriptError(f"PNG chunk {kind!r} is damaged")
        out.append((kind, body))
        at += 12 + n
        if kind == b"IEND":
            break
    if not out or out[0][0] != b"IHDR" or out[-1][0] != b"IEND" or at != len(data):
        raise ScriptError("the PNG's chunks are not in order")
    return out


def _unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 1:
            for i in range(step):
                line[i::step] = np.cumsum(line[i::step])
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for i in range(stride):
                left, up, corner = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[i] = (line[i] + guess) & 255
        elif kind > 4:
            raise ScriptError("unknown PNG filter")
        above = line & 255
        out[y] = above
    return out


def decode(data: bytes, strict: bool = False) -> np.ndarray:
    """RGBA8 (height, width, 4). Grey and palettes are expanded, 16-bit samples scaled; strict: RGBA8 only."""
    parts = chunks(data)
    w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", parts[0][1])
    if lace or kind not in _SAMPLES or not (1 <= w <= 30000 and 1 <= h <= 30000) or strict and (depth, kind) != (8, 6):
        raise ScriptError("this kind of PNG is not supported")
    n = _SAMPLES[kind]
    stride = (w * n * depth + 7) // 8
    try:
        engine = zlib.decompressobj()
        raw = engine.decompress(b"".join(b for k, b in parts if k == b"IDAT"))
    except zlib.error as e:
        raise ScriptError(f"PNG data: {e}") from None
    if len(raw) != h * (stride + 1) or not engine.eof:
        raise ScriptError("the PNG's data has a wrong size")
    lines = _unfilter(raw, h, stride, max(1, n * depth // 8))
    if depth == 16:
        v = lines.reshape(h, w * n, 2).astype(np.int64)
        lines = ((v[..., 0] * 256 + v[..., 1]) * 255 + 32767) // 65535
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)[:, : w * n]
        lines = bits @ (1 << np.arange(depth)[::-1])
        lines = lines if kind == 3 else lines * 255 // ((1 << depth) - 1)
    v = lines.reshape(h, w, n).astype(np.uint8)
    if kind == 3:
        table = dict(parts)
        palette = np.frombuffer(table[b"PLTE"], dtype=np.uint8).reshape(-1, 3)
        alpha = np.full(len(palette), 255, dtype=np.uint8)
        given = np.frombuffer(table.get(b"tRNS", b""), dtype=np.uint8)
        alpha[: len(given)] = given
        return np.concatenate([palette[v[..., 0]], alpha[v[..., 0]][..., None]], axis=2)
    full = np.full((h, w, 1), 255, dtype=np.uint8)
    return np.concatenate([v if n == 3 else np.repeat(v[..., :1], 3, axis=2), v[..., -1:] if n in (2, 4) and n != 3 else full], axis=2) if n < 4 else v


def rows(rgba: np.ndarray) -> pd.DataFrame:
    """x, y, v of the pixels that are not transparent."""
    p = rgba.astype(np.int64)
    v = np.where(p[..., 3] == 0, 0, p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2])
    y, x = np.nonzero(v)
    return pd.DataFrame({"x": x.astype("int32"), "y": y.astype("int32"), "v": v[y, x]})


def decode_base64(spark: SparkSession, text: str) -> tuple[int, int, Rel]:
    """Width, height and pixels of a strictly encoded RGBA8 PNG in a script."""
    try:
        data = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        raise ScriptError("the image is not base64") from None
    image = decode(data, strict=True)
    return image.shape[1], image.shape[0], Rel(spark.createDataFrame(rows(image), "x int, y int, v long"))


def read_pngs(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y, v of every PNG file under a path."""

    def one(frames):
        for pdf in frames:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                yield rows(decode(bytes(content))).assign(path=p)[["path", "x", "y", "v"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(one, "path string, x int, y int, v long")


def write_bands(df: DataFrame, w: int, h: int, band: int = 64) -> DataFrame:
    """band, first row and filtered bytes of an image (x, y, r, g, b, a): the parallel part of an export."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.band.iloc[0])
        part = np.zeros((min(band, h - k * band), w, 4), dtype=np.uint8)
        part[pdf.y - k * band, pdf.x] = pdf[["r", "g", "b", "a"]].to_numpy()
        raw = np.concatenate([np.zeros((len(part), 1), dtype=np.uint8), part.reshape(len(part), 4 * w)], axis=1)
        return pd.DataFrame({"band": [k], "raw": [raw.tobytes()]})

    return df.withColumn("band", F.floor(F.col("y") / F.lit(float(band))).cast("int")).groupBy("band").applyInPandas(one, "band int, raw binary")


def to_png(df: DataFrame, w: int, h: int) -> bytes:
    """One PNG of a rendered canvas (at most 16384 x 16384: what a single file holds), band after band."""
    squeeze, parts = zlib.compressobj(6), []
    for r in write_bands(df, w, h).orderBy("band").toLocalIterator():
        parts.append(squeeze.compress(bytes(r["raw"])))
    data = b"".join(parts) + squeeze.flush()
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")
