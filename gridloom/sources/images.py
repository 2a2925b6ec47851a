"""Image and video files as pixel relations, and back.

Files come in through Spark's own readers, so any store will do: ``image`` for PNG and JPEG, ``binaryFile`` for
Netpbm images and uncompressed AVI videos, which are decoded here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, r, c, red, green, blue of PNG and JPEG files; gray files have equal bands, alpha is dropped."""
    files = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples():
                a = np.frombuffer(f.data, np.uint8).reshape(f.height, f.width, f.nChannels).astype(np.int64)
                blue, green, red = (a[..., min(k, f.nChannels - 1)] for k in (0, 1, 2))  # the reader's order is reversed
                r, c = np.indices(red.shape)
                yield pd.DataFrame({"origin": f.origin, "r": r.ravel(), "c": c.ravel(), "red": red.ravel(), "green": green.ravel(), "blue": blue.ravel()})

    return files.mapInPandas(rows, "origin string, r bigint, c bigint, red bigint, green bigint, blue bigint")


def encode_netpbm(a: np.ndarray) -> bytes:
    """Gray (h, w) or colour (h, w, 3) bytes as a binary PGM or PPM file."""
    kind = b"P5" if a.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    fields: list[bytes] = []
    at = 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    at += 1
    kind, width, height = fields[0], int(fields[1]), int(fields[2])
    if kind not in (b"P5", b"P6") or int(fields[3]) > 255:
        raise ValueError("only binary PGM and PPM of one byte a sample")
    bands = 1 if kind == b"P5" else 3
    a = np.frombuffer(data, np.uint8, height * width * bands, at)
    return a.reshape(height, width) if bands == 1 else a.reshape(height, width, 3)


def read_netpbm(spark: SparkSession, path: str) -> DataFrame:
    """origin, r, c, red, green, blue of PGM and PPM files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples():
                a = decode_netpbm(f.content).astype(np.int64)
                a = np.repeat(a[..., None], 3, axis=2) if a.ndim == 2 else a
                r, c = np.indices(a.shape[:2])
                yield pd.DataFrame({"origin": f.path, "r": r.ravel(), "c": c.ravel(), "red": a[..., 0].ravel(), "green": a[..., 1].ravel(), "blue": a[..., 2].ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "origin string, r bigint, c bigint, red bigint, green bigint, blue bigint")


def to_netpbm(px: DataFrame) -> DataFrame:
    """image_id, content: one gray file an image, as a binary column to be written by any sink."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1), np.uint8)
        a[pdf["r"], pdf["c"]] = pdf["v"].clip(0, 255)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "content": [encode_netpbm(a)]})

    return px.select("image_id", "r", "c", "v").groupBy("image_id").applyInPandas(run, "image_id bigint, content binary")


# --- uncompressed video ---------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(frames: np.ndarray, fps: float = 12.0) -> bytes:
    """Frames (n, h, w, 3) as an AVI file of raw 24-bit pictures, bottom row first, rows padded to four bytes."""
    n, h, w = frames.shape[:3]
    stride = (w * 3 + 3) // 4 * 4
    rate = round(fps * 1000)
    head = _chunk(b"avih", struct.pack("<14I", round(1e6 / fps), 0, 0, 0x10, n, 0, 1, stride * h, w, h, 0, 0, 0, 0))
    stream = _chunk(b"strh", b"vidsDIB " + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1000, rate, 0, n, stride * h, 0xFFFFFFFF, 0, 0, 0, w, h))
    picture = _chunk(b"strf", struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 0, 0, 0, 0))
    header = _chunk(b"LIST", b"hdrl" + head + _chunk(b"LIST", b"strl" + stream + picture))
    padded = np.zeros((n, h, stride), np.uint8)
    padded[:, :, : w * 3] = frames[:, ::-1, :, ::-1].reshape(n, h, w * 3)
    movie = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00db", f.tobytes()) for f in padded))
    return _chunk(b"RIFF", b"AVI " + header + movie)


def decode_avi(data: bytes) -> tuple[np.ndarray, float]:
    """Frames (n, h, w, 3) and frames a second of such a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    width = height = 0
    fps, pictures = 0.0, []

    def walk(at: int, end: int) -> None:
        nonlocal width, height, fps
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                walk(body + 4, body + size)
            elif name == b"strh":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                fps = rate / scale
            elif name == b"strf":
                _, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, body)
                if bits != 24 or packing:
                    raise ValueError("only raw 24-bit video")
            elif name in (b"00db", b"00dc") and size:
                pictures.append(data[body : body + size])
            at = body + size + size % 2

    walk(12, len(data))
    stride = (width * 3 + 3) // 4 * 4
    out = [np.frombuffer(p, np.uint8).reshape(height, stride)[::-1, : width * 3].reshape(height, width, 3)[..., ::-1] for p in pictures]
    return (np.stack(out) if out else np.zeros((0, height, width, 3), np.uint8)), fps


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """origin, frame_idx, r, c, red, green, blue of AVI files, a frame at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples():
                for i, a in enumerate(decode_avi(f.content)[0].astype(np.int64)):
                    r, c = np.indices(a.shape[:2])
                    yield pd.DataFrame({"origin": f.path, "frame_idx": i, "r": r.ravel(), "c": c.ravel(), "red": a[..., 0].ravel(), "green": a[..., 1].ravel(), "blue": a[..., 2].ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "origin string, frame_idx bigint, r bigint, c bigint, red bigint, green bigint, blue bigint")


def video_table(spark: SparkSession, path: str) -> DataFrame:
    """origin, n_frames, height, width, fps."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples():
                frames, fps = decode_avi(f.content)
                yield pd.DataFrame({"origin": [f.path], "n_frames": [frames.shape[0]], "height": [frames.shape[1]], "width": [frames.shape[2]], "fps": [fps]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "origin string, n_frames bigint, height bigint, width bigint, fps double")


def to_videos(frames: DataFrame, fps: float = 12.0) -> DataFrame:
    """video_id, content from frames (video_id, frame_idx, r, c, red, green, blue); one video fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["frame_idx"].max()) + 1, int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1, 3), np.uint8)
        for k, band in enumerate(("red", "green", "blue")):
            a[pdf["frame_idx"], pdf["r"], pdf["c"], k] = pdf[band]
        return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]], "content": [encode_avi(a, fps)]})

    return frames.groupBy("video_id").applyInPandas(run, "video_id bigint, content binary")


def not_blank(px: DataFrame) -> DataFrame:
    """image_id of images with more than one level: a constant one is a failed capture."""
    return px.groupBy("image_id").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").select("image_id")
