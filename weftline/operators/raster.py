"""Line maps as tile pyramids: segments are sampled, splatted on pixels, toned and written as PNG.

Segments go to the tiles that their boxes touch, level by level. A tile with very many segments, as those of the first levels, is cut into blocks by
hash: each block gives its light as a picture, and the tile is the sum of its blocks' light, toned once. For the sum over pixels there is a relational
form too, which needs no grouping by tile.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BLOCK = 50_000  # segments that one task draws


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image as PNG."""
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def splat(segments: np.ndarray, ink: np.ndarray, size: int) -> np.ndarray:
    """(size, size, 3) light of segments (n, 4) in pixels: samples a pixel apart, each spread on its four nearest pixels.

    Only samples that can touch the picture are made, so a long line costs each tile no more than the tile's own part of it.
    """
    out = np.zeros((size * size, 3))
    start, step = segments[:, :2], segments[:, 2:] - segments[:, :2]
    n = np.maximum(1, np.ceil(np.hypot(step[:, 0], step[:, 1]))).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = (-1.0 - start) / step, (size + 1.0 - start) / step
    flat = step == 0
    inside = (start >= -1) & (start <= size + 1)
    enter = np.where(flat, np.where(inside, 0.0, 2.0), np.minimum(p, q)).max(1)
    leave = np.where(flat, np.where(inside, 1.0, -1.0), np.maximum(p, q)).min(1)
    first = np.maximum(0, np.ceil(np.clip(enter, 0, 2) * n - 0.5)).astype(np.int64)
    last = np.minimum(n - 1, np.floor(np.clip(leave, -1, 1) * n - 0.5)).astype(np.int64)
    count = np.maximum(0, last - first + 1)
    for a, b in _stretches(count):
        c = count[a:b]
        s = a + np.repeat(np.arange(b - a), c)
        k = np.arange(len(s)) - np.repeat(np.cumsum(c) - c, c) + first[s]
        f = (k + 0.5) / n[s]
        x, y = start[s, 0] + step[s, 0] * f - 0.5, start[s, 1] + step[s, 1] * f - 0.5
        x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
        for dx in (0, 1):
            for dy in (0, 1):
                px, py = x0 + dx, y0 + dy
                ok = (px >= 0) & (px < size) & (py >= 0) & (py < size)
                at = py[ok] * size + px[ok]
                w = (np.abs(1 - dx - (x - x0)) * np.abs(1 - dy - (y - y0)))[ok]
                for channel in range(3):
                    out[:, channel] += np.bincount(at, w * ink[s[ok], channel], size * size)
    return out.reshape(size, size, 3)


def _stretches(count: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Stretches of segments whose samples are at most about ``most``."""
    part = (np.cumsum(count) - count) // most
    edge = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(count)]
    yield from zip(edge[:-1], edge[1:], strict=True)


def tone(light: np.ndarray, gain: float) -> np.ndarray:
    return (255 * (1 - np.exp(-gain * light)) + 0.5).astype(np.uint8)


def tile_segments(links: DataFrame, zooms: list[int], pad: float = 0.0) -> DataFrame:
    """Links (ax, ay, bx, by in the unit square, r, g, b) with each tile (z, x, y) that they pass, within ``pad`` tile widths.

    A link is followed column by column, and in each column only over the rows that it crosses there, so the tiles go with its length, not with its box.
    """
    z = F.explode(F.array(*[F.lit(k) for k in zooms])).alias("z")
    inside = (F.greatest("ax", "bx") >= 0) & (F.least("ax", "bx") < 1) & (F.greatest("ay", "by") >= 0) & (F.least("ay", "by") < 1)
    e = links.where(inside).select("*", z).withColumn("n", F.pow(F.lit(2.0), F.col("z")))
    low = lambda v: F.greatest(F.lit(0).cast("long"), F.floor(v * F.col("n") - pad))
    high = lambda v: F.least((F.col("n") - 1).cast("long"), F.floor(v * F.col("n") + pad))
    e = e.withColumn("x", F.explode(F.sequence(low(F.least("ax", "bx")), high(F.greatest("ax", "bx")))))
    wide = F.col("bx") - F.col("ax")
    share = lambda v: F.when(wide == 0, None).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v / F.col("n") - F.col("ax")) / wide)))
    at = lambda t: F.col("ay") + (F.col("by") - F.col("ay")) * t
    y0, y1 = at(F.coalesce(share(F.col("x") - pad), F.lit(0.0))), at(F.coalesce(share(F.col("x") + 1 + pad), F.lit(1.0)))
    e = e.withColumn("y0", low(F.least(y0, y1))).withColumn("y1", high(F.greatest(y0, y1))).where("y0 <= y1")
    return e.withColumn("y", F.explode(F.sequence("y0", "y1"))).drop("y0", "y1")


def render_tiles(links: DataFrame, zooms: list[int], size: int = 256, gain: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(z, x, y, lit, png) of every tile that isn't empty; brightness grows with the zoom."""
    tile = ["z", "x", "y"]

    def light(df: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (int(df[c].iloc[0]) for c in tile)
        seg = (df[["ax", "ay", "bx", "by"]].to_numpy() * (1 << z) - np.array([x, y, x, y])) * size
        out = splat(seg, df[["r", "g", "b"]].to_numpy(float), size).astype(np.float32)
        return pd.DataFrame([(z, x, y, zlib.compress(out.tobytes(), 1))] if out.any() else [], columns=[*tile, "light"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size, 3), np.float64)
        for batch in parts:
            for x in batch.column(batch.schema.get_field_index("light")):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.float32).reshape(size, size, 3)
        z, x, y = (k.as_py() for k in key)
        lit = int((total.sum(-1) > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([z], pa.int32()), pa.array([x], pa.int64()), pa.array([y], pa.int64()), pa.array([lit], pa.int32()), pa.array([png(tone(total, gain * 1.7**z))], pa.binary())], names=[*tile, "lit", "png"])

    segments = tile_segments(links, zooms, 1.0 / size)  # a sample lights the pixel beside it too
    # tiles with more than a block: at most segments / block of them
    busy = segments.groupBy(*tile).agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")).where("cuts > 1")
    cut = segments.join(busy, tile, "left").withColumn("block", F.pmod(F.xxhash64("ax", "ay", "bx", "by"), F.coalesce("cuts", F.lit(1)))).drop("cuts")
    parts = cut.groupBy(*tile, "block").applyInPandas(light, "z int, x long, y long, light binary")
    return parts.groupBy(*tile).applyInArrow(add, "z int, x long, y long, lit int, png binary")


def pixel_sums(links: DataFrame, z: int, size: int = 256) -> DataFrame:
    """(px, py, hits): samples of all links on the pixels of one level, as a plain aggregation."""
    wide = float(size << z)
    n = F.greatest(F.lit(1), F.ceil(F.hypot((F.col("bx") - F.col("ax")) * wide, (F.col("by") - F.col("ay")) * wide)).cast("int"))
    s = links.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda p, q: F.floor((F.col(p) + (F.col(q) - F.col(p)) * ((F.col("k") + 0.5) / F.col("n"))) * wide)
    return s.groupBy(at("ax", "bx").alias("px"), at("ay", "by").alias("py")).agg(F.count("*").alias("hits"))


def write_tiles(tiles: DataFrame, folder: str) -> None:
    """Writes z/x/y.png below a folder that all executors share as a path (``file://``), from the executors.

    Object stores and HDFS aren't paths to Python: there the tiles are written as a table (``tiles.write``), from which a server reads them.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("write the tiles as a table where the folder isn't a shared path")

    def put(rows) -> None:
        import pathlib

        base = pathlib.Path(folder.removeprefix("file://"))
        for r in rows:
            at = base / str(r.z) / str(r.x)
            at.mkdir(parents=True, exist_ok=True)
            (at / f"{r.y}.png").write_bytes(bytes(r.png))

    tiles.foreachPartition(put)


def tilejson(name: str, zooms: list[int]) -> dict:
    return {"tilejson": "3.0.0", "name": name, "tiles": ["{z}/{x}/{y}.png"], "minzoom": min(zooms), "maxzoom": max(zooms), "bounds": [-180, -85.05112878, 180, 85.05112878]}
