"""Image files: recognised by content, read in parallel by Spark's image source, exported through the JVM's encoders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import dec, q
from ..plans.document import Document, Node, ScriptError
from ..plans.relation import Rel
from . import png

#: First bytes of the kinds (fixed values).
MAGIC = {"png": png.MAGIC, "jpeg": b"\xff\xd8\xff", "tiff": (b"II*\x00", b"MM\x00*"), "zip": b"PK\x03\x04", "psd": b"8BPS", "gif": b"GIF8", "bmp": b"BM"}


def sniff(data: bytes) -> str | None:
    return next((k for k, m in MAGIC.items() if data.startswith(m)), None)


def kinds(spark: SparkSession, path: str) -> DataFrame:
    """path and kind (by content) of files; only their first bytes leave the scan."""
    head = F.substring("content", 1, 8)
    kind = F.coalesce(*[F.when(F.substring(head, 1, len(b)) == F.lit(b), F.lit(k)) for k, m in MAGIC.items() for b in (m if isinstance(m, tuple) else (m,))])
    return spark.read.format("binaryFile").load(path).select("path", kind.alias("kind"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, w, h, x, y, v of all images under a path (PNG, JPEG, GIF, BMP, TIFF)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                flat = np.frombuffer(bytes(r.data), dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                if r.nChannels == 1:
                    rgba = np.concatenate([np.repeat(flat, 3, axis=2), np.full_like(flat, 255)], axis=2)
                else:
                    alpha = flat[..., 3:] if r.nChannels == 4 else np.full_like(flat[..., :1], 255)
                    rgba = np.concatenate([flat[..., 2::-1], alpha], axis=2)  # the source gives blue first
                yield png.rows(rgba).assign(path=r.origin, w=np.int32(r.width), h=np.int32(r.height))[["path", "w", "h", "x", "y", "v"]]

    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return images.mapInPandas(rows, "path string, w int, h int, x int, y int, v long")


def open_image(spark: SparkSession, path: str) -> Document:
    """A document with the image as its one layer."""
    size = spark.read.format("image").load(path).select("image.width", "image.height").first()
    if size is None or size[0] <= 0:
        raise ScriptError(f"{path} is not an image that can be read")
    doc = Document(size[0], size[1])
    rel = Rel(read_images(spark, path).select("x", "y", "v"))
    doc.state = doc.state.insert("root", None, Node("background", "raster", "Background", pixels=rel))
    return doc


def on_white(df: DataFrame) -> DataFrame:
    """A render without alpha, over white."""
    a = dec(F.col("a"))
    return df.select("x", "y", *(q(dec(F.col(c)) * a + (1.0 - a)).alias(c) for c in "rgb"), F.lit(255).alias("a"))


def export(spark: SparkSession, df: DataFrame, w: int, h: int, kind: str) -> bytes:
    """One PNG, JPEG (over white) or TIFF file of a render."""
    data = png.to_png(on_white(df) if kind == "jpeg" else df, w, h)
    if kind == "png":
        return data
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    if kind == "jpeg":
        plain = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
        plain.createGraphics().drawImage(image, 0, 0, None)
        image = plain
    out = jvm.java.io.ByteArrayOutputStream()
    if not jvm.javax.imageio.ImageIO.write(image, {"jpeg": "jpg"}.get(kind, kind), out):
        raise ScriptError(f"no encoder for {kind}")
    return bytes(out.toByteArray())
