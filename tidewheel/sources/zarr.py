"""Zarr (version 2) stores of concatenated episodes: one task a chunk, no library needed.

Arrays lie under ``data/`` (or the root); ``meta/episode_ends`` (or ``episode_ends``) holds
the cumulative end of each episode; without it the store is one episode. Chunks may be
plain or compressed by zlib, gzip, zstd or lz4, with C or Fortran order and "." between
chunk numbers; other compressors, filters and separators raise.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans.catalog import Files

#: Arrays that are the state, and words in the names of image arrays.
STATES = ("state", "robot_state", "robot0_eef_pos")
IMAGES = ("image", "rgb", "camera", "img", "frame", "video")


def decode_chunk(raw: bytes, meta: dict) -> np.ndarray:
    """A chunk's values in its whole shape, edges included."""
    kind = (meta.get("compressor") or {}).get("id")
    size = int(np.prod(meta["chunks"])) * np.dtype(meta["dtype"]).itemsize
    if kind in ("zlib", "gzip"):
        raw = zlib.decompress(raw, 47)
    elif kind == "zstd":
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    elif kind == "lz4":
        raw = pa.decompress(raw[4:], struct.unpack_from("<I", raw)[0], codec="lz4_raw", asbytes=True)
    elif kind:
        raise ValueError(f"zarr chunks compressed by {kind} are not supported")
    return np.frombuffer(raw, meta["dtype"]).reshape(meta["chunks"], order=meta.get("order", "C"))


def is_image(name: str, meta: dict) -> bool:
    """By name, or four dimensions of bytes with a channel count last."""
    shape = meta["shape"]
    return any(w in name.lower() for w in IMAGES) or (len(shape) == 4 and shape[-1] in (1, 3, 4) and np.dtype(meta["dtype"]) == np.uint8)


def array_meta(files: Files, name: str) -> dict:
    meta = json.loads(files.read(f"{name}/.zarray"))
    if meta.get("filters") or meta.get("dimension_separator", ".") != ".":
        raise ValueError(f"{name}: filters and nested chunks are not supported")
    return meta


def read_array(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``idx, value`` (a list of doubles) of every row that a chunk holds, in no order.

    Rows of chunks that the store leaves out are absent; ``read_frames`` fills them.
    """
    meta = array_meta(Files(spark, root), name)
    shape, chunks = meta["shape"], meta["chunks"]
    width = int(np.prod(shape[1:])) if len(shape) > 1 else 1
    split = [k for k in range(1, len(shape)) if chunks[k] < shape[k]]
    if len(shape) > 2 and split:
        raise ValueError(f"{name}: arrays of over two dimensions must be split in the first only")

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = [int(x) for x in path.rsplit("/", 1)[1].split(".")]
                x = decode_chunk(raw, meta)
                x = x[tuple(slice(0, max(0, n - k * c)) for n, k, c in zip(shape, at, chunks, strict=True))]
                x = x.reshape(len(x), -1).astype("f8")
                n = x.shape[1]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(n, 1), dtype="i4")), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype="i8") + at[0] * chunks[0]), pa.array(np.full(len(x), at[1] if len(at) > 1 else 0, "i4")), values], names=["idx", "col", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(f"{root}/{name}").select("path", "content")
    rows = files.mapInArrow(run, "idx long, col int, value array<double>")
    if not split:
        return rows.select("idx", "value")
    # a row's columns lie in several chunks; an absent one is filled
    parts, fill = -(-width // chunks[1]), float(meta.get("fill_value") or 0)
    held = rows.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    blank = lambda k: F.array_repeat(F.lit(fill), min(chunks[1], width - k * chunks[1]))
    return held.select("idx", F.concat(*(F.coalesce(F.try_element_at("m", F.lit(k)), blank(k)) for k in range(parts))).alias("value"))


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    """``episode_id, frame_index, timestamp`` (null) ``, action, state`` of every frame.

    The action is the last array by name that has "action" in it, the state the last of
    ``STATES``; images (``is_image``) are not read. Frames join their
    episode and both arrays by their place in the store.
    """
    files = Files(spark, root)
    prefix = "data/" if files.glob("data/*/.zarray") else ""
    names = [p.rsplit("/", 2)[1] for p in files.glob(f"{prefix}*/.zarray")]
    metas = {n: array_meta(files, f"{prefix}{n}") for n in names if n != "episode_ends"}
    plain = [n for n, m in metas.items() if m["shape"] and not is_image(n, m)]
    picked = {"action": [n for n in plain if "action" in n.lower()][-1:], "state": [n for n in plain if n.lower() in STATES][-1:]}
    ends = next((n for n in ("meta/episode_ends", "episode_ends") if files.exists(f"{n}/.zarray")), None)
    if ends:
        found = read_array(spark, root, ends).select(F.col("idx").alias("n"), F.col("value")[0].cast("long").alias("end"))
        before = found.select((F.col("n") + 1).alias("n"), F.col("end").alias("start"))
        episodes = found.join(before, "n", "left").withColumn("start", F.coalesce("start", F.lit(0))).where("end > start")
        frames = episodes.select("n", (F.col("end") - F.col("start")).alias("len"), "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"))
    else:
        total = next((m["shape"][0] for m in metas.values() if m["shape"]), 0)
        frames = spark.range(total).select(F.lit(0).alias("n"), F.lit(0).alias("start"), F.col("id").alias("idx"))
    for column, chosen in picked.items():
        if not chosen:
            frames = frames.withColumn(column, F.lit(None).cast("array<double>"))
            continue
        meta = metas[chosen[0]]
        blank = F.array_repeat(F.lit(float(meta.get("fill_value") or 0)), int(np.prod(meta["shape"][1:])) if len(meta["shape"]) > 1 else 1)
        values = read_array(spark, root, f"{prefix}{chosen[0]}").withColumnRenamed("value", column)
        frames = frames.join(values, "idx", "left").withColumn(column, F.coalesce(column, F.when(F.col("idx") < meta["shape"][0], blank)))
    return frames.select(F.col("n").cast("string").alias("episode_id"), (F.col("idx") - F.col("start")).cast("long").alias("frame_index"), F.lit(None).cast("double").alias("timestamp"), "action", "state")
