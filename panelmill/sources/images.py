"""Image folders as tables."""

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import natural_key
from ..functions.urls import FOLDER_EXTS, has_ext
from ..operators.ordering import rank_rows


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def folder_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/[^/]*$", 1)


def folder_of(spark: SparkSession, path: str) -> str:
    """The folder that a path stands for: itself, or the one that holds a single file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    single = files.exists(place) and files.getFileStatus(place).isFile()
    return place.getParent().toString() if single else path


def scan_images(spark: SparkSession, path: str, exts=FOLDER_EXTS, content: bool = False, alone: bool = False) -> DataFrame:
    """Image files below ``path``: (path, chapter, fname, length[, content]).

    Suffixes match in any case. Without ``content`` the file bodies are never read. A
    single file stands for its folder, or for itself if ``alone`` (images to be split one by one).
    """
    path = path if alone else folder_of(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keep = ["path", folder_name(F.col("path")).alias("chapter"), base_name(F.col("path")).alias("fname"), "length"]
    return files.where(has_ext(F.col("path"), exts)).select(*keep, *(["content"] if content else []))


def in_reading_order(files: DataFrame, key: str = "chapter", name: str = "fname") -> DataFrame:
    """Add ``seq`` from 1 by natural name order inside each folder; the exact name breaks ties."""
    keyed = files.withColumn("_k", natural_key(F.col(name)))
    return rank_rows(keyed, [key], ["_k", name], "seq").drop("_k")


def decode_flagged(spark: SparkSession, path: str) -> DataFrame:
    """Each file once: (origin, ok, height, width, n_channels, data), three colour bytes per pixel where ``ok``."""
    img = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    ok = F.col("height") > 0
    only = {c: F.when(ok, F.col(c)) for c in ("height", "width", "data")} | {"n_channels": F.when(ok, F.col("nChannels"))}
    return three_channels(img.select("origin", ok.alias("ok"), *[v.alias(k) for k, v in only.items()]))


def decode_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decoded images and undecodable files, as two tables.

    The first holds (origin, height, width, n_channels, data); the second (origin), to be
    reported rather than lost. A caller that wants both writes ``decode_flagged`` once instead.
    """
    img = decode_flagged(spark, path)
    return img.where("ok").drop("ok").select("origin", "height", "width", "n_channels", "data"), img.where("not ok").select("origin")


def three_channels(images: DataFrame) -> DataFrame:
    """Bring grey and alpha images to three colour bytes per pixel; colour images never leave the JVM."""

    def spread(data: pd.Series, h: pd.Series, w: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for d, rows, cols, k in zip(data, h, w, n):
            px = None if d is None else np.frombuffer(d, np.uint8).reshape(rows, cols, k)
            out.append(None if d is None else (np.repeat(px, 3, axis=2) if k == 1 else px[:, :, :3]).tobytes())
        return pd.Series(out, dtype=object)

    odd = F.when(F.col("n_channels") != 3, F.col("data"))
    changed = F.pandas_udf(spread, "binary")(odd, "height", "width", "n_channels")
    return images.withColumn("data", F.coalesce(changed, F.col("data"))).withColumn("n_channels", F.lit(3))


def require_readable(images: DataFrame) -> DataFrame:
    """The images, or an error when there is none."""
    if images.isEmpty():
        raise ValueError("no readable images")
    return images


def _size(head: bytes) -> tuple[int, int]:
    """(width, height) from the first bytes of an image file, or (-1, -1)."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:4] == b"GIF8" and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head) and head[at] == 0xFF:
            marker, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return -1, -1


def image_size(content: Column) -> Column:
    """struct<w, h> from the file header, without decoding."""

    def sizes(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_size(c) for c in files], columns=["w", "h"])

    return F.pandas_udf(sizes, "w int, h int")(content)


def write_table(df: DataFrame, path: str, by: list[str]) -> None:
    """Write results below ``path``, one folder per key; a folder that is written again loses its old files.

    Only the folders in ``df`` are replaced, so a re-run of one chapter leaves the others alone.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
