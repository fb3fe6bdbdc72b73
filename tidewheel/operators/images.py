"""Image measures on numpy frames, perceptual hashes, and duplicates by keyframe signatures.

Frames come decoded, as arrays; decoding video needs a codec library that is a plug-in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import hamming
from tidewheel.operators.components import connected_components
from tidewheel.session import small_batches

#: Fixed values.
BLURRY, DARK, FROZEN = 100.0, 32.0, 0.1
SHADOW, HIGHLIGHT = 4, 254
KEYFRAMES = 16


def as_uint8(image: np.ndarray, longest: int | None = 128) -> np.ndarray:
    """Height x width x 3 bytes; floats are of [0, 1] or [0, 255]; shrunk to ``longest`` by nearest pixels."""
    x = np.asarray(image)
    if x.dtype != np.uint8:
        x = x.astype("f8")
        if not np.isfinite(x).all():
            raise ValueError("image has non-finite values")
        x = np.clip(np.rint(x * 255 if x.max(initial=0) <= 1 else x), 0, 255).astype(np.uint8)
    if x.ndim == 2:
        x = np.repeat(x[..., None], 3, axis=2)
    if x.ndim != 3 or x.shape[2] not in (3, 4):
        raise ValueError(f"not an image: {x.shape}")
    x = x[..., :3]
    if longest and max(x.shape[:2]) > longest:
        h, w = (max(1, round(n * longest / max(x.shape[:2]))) for n in x.shape[:2])
        x = x[(np.arange(h) * x.shape[0] // h)[:, None], np.arange(w) * x.shape[1] // w]
    return x


def luma(x: np.ndarray) -> np.ndarray:
    return x[..., 0] * 0.299 + x[..., 1] * 0.587 + x[..., 2] * 0.114


def sharpness(x: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian."""
    y = luma(x)
    if min(y.shape) < 3:
        return 0.0
    return float((y[:-2, 1:-1] + y[2:, 1:-1] + y[1:-1, :-2] + y[1:-1, 2:] - 4 * y[1:-1, 1:-1]).var())


def colourfulness(x: np.ndarray) -> float:
    r, g, b = (x[..., k].astype("f8") for k in range(3))
    rg, yb = r - g, (r + g) / 2 - b
    return float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()))


def frame_measures(x: np.ndarray, before: np.ndarray | None = None) -> dict[str, float | bool | None]:
    y = luma(x)
    return {
        "sharpness": sharpness(x), "brightness": float(y.mean()), "dark": bool(y.mean() < DARK), "blurry": sharpness(x) < BLURRY,
        "shadow_fraction": float((y <= SHADOW).mean()), "highlight_fraction": float((y >= HIGHLIGHT).mean()), "colourfulness": colourfulness(x),
        "frozen": None if before is None or before.shape != x.shape else bool(np.abs(x.astype("f8") - before).mean() < FROZEN),
    }


_MEASURES = "sharpness double, brightness double, shadow_fraction double, highlight_fraction double, colourfulness double, frozen boolean"


def measure_frames(frames: DataFrame, longest: int | None = 128) -> DataFrame:
    """Adds the measures of ``frame_measures`` to frames with ``pixels, height, width``, and ``outcome`` where it is not there.

    ``pixels`` are bytes, one or three a pixel. A frame without them is ``missing``, one whose
    size does not fit ``invalid``; both break the comparison with the frame before, as a
    change of size does. Each camera is walked in order, two frames at a time. These are
    the rows that ``video`` reads.
    """
    small_batches(frames.sparkSession)
    key = ["episode_id", "camera"]
    kept = [f for f in frames.schema.fields if f.name not in ("pixels", "outcome")]
    width = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in _MEASURES.split(", ")]

    def walk(batches):
        last = before = None
        for batch in batches:
            out = {n: [] for n in ("outcome", *names)}
            for episode, camera, pixels, h, w in zip(*(batch.column(n).to_pylist() for n in (*key, "pixels", "height", "width")), strict=True):
                if (episode, camera) != last:
                    last, before = (episode, camera), None
                fits = pixels is not None and h and w and len(pixels) in (h * w, 3 * h * w)
                out["outcome"].append("decoded" if fits else "missing" if pixels is None else "invalid")
                if not fits:
                    before = None
                    found = dict.fromkeys(names)
                else:
                    x = np.frombuffer(pixels, np.uint8).reshape(h, w, -1)
                    x = as_uint8(x if x.shape[2] == 3 else x[..., 0], longest)
                    same = before is not None and before[1] == (h, w)
                    found, before = frame_measures(x, before[0] if same else None), (x, (h, w))
                for n in names:
                    out[n].append(found[n])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(out["outcome"], pa.string()), *(pa.array(out[n], pa.bool_() if n == "frozen" else pa.float64()) for n in names)], names=[*(f.name for f in kept), "outcome", *names]
            )

    placed = frames.drop("outcome").repartition(width, *key).sortWithinPartitions(*key, "frame_index")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", outcome string, " + _MEASURES
    return placed.mapInArrow(walk, schema)


def _grey(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Grey levels averaged over an ``h`` x ``w`` grid."""
    y = luma(x)
    rows, columns = np.linspace(0, y.shape[0], h + 1).astype(int), np.linspace(0, y.shape[1], w + 1).astype(int)
    return np.array([[y[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(columns, columns[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)])


def _number(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel()).view(">u8")[0].astype("u8").view("i8"))


def average_hash(x: np.ndarray) -> int:
    g = _grey(x, 8, 8)
    return _number(g > g.mean())


def difference_hash(x: np.ndarray) -> int:
    g = _grey(x, 8, 9)
    return _number(g[:, 1:] > g[:, :-1])


def perceptual_hash(x: np.ndarray) -> int:
    g, n = _grey(x, 32, 32), np.arange(32)
    basis = np.cos(np.pi * (2 * n[None] + 1) * n[:, None] / 64)
    low = (basis @ g @ basis.T)[:8, :8]
    return _number(low > np.median(low))


def keyframes(n: int, count: int = KEYFRAMES) -> list[int]:
    return np.round(np.linspace(0, n - 1, count)).astype(int).tolist() if n else []


def signature_pairs(signatures: DataFrame, most: float = 0.10) -> DataFrame:
    """Pairs of episodes whose keyframe hashes differ in ``most`` of the bits or less: ``a, b, distance``.

    ``signatures``: ``episode_id, camera, keyframe, hash``. The distance of a camera is
    the mean over keyframes, that of a pair the largest over shared cameras; episodes that
    share none are no pair. Any ``most`` below 1 finds all pairs (see ``hamming``). Copies give
    all their pairs here; ``duplicate_clusters`` does not need them.
    """
    if not 0 <= most < 1:
        raise ValueError("most must be at least 0 and below 1")
    members, rows, n = hamming.classes(signatures)
    side = lambda n_: members.select(F.col("rep").alias(n_), F.col("episode_id").alias(f"e{n_}"))
    apart = hamming.class_pairs(rows, n, most).join(side("a"), "a").join(side("b"), "b")
    pairs = apart.select(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b"), "distance")
    equal = side("a").join(side("a").withColumnRenamed("ea", "eb"), "a").where("ea < eb").select(F.col("ea").alias("a"), F.col("eb").alias("b"), F.lit(0.0).alias("distance"))
    return pairs.unionByName(equal)


def duplicate_clusters(signatures: DataFrame, most: float = 0.10) -> DataFrame:
    """Single-linkage clusters: ``episode_id, representative`` (the smallest id), ``kept``.

    Episodes of equal signatures are one node, so copies are never paired with each other.
    An episode without a hash is a cluster of its own.
    """
    if not 0 <= most < 1:
        raise ValueError("most must be at least 0 and below 1")
    members, rows, n = hamming.classes(signatures)
    part = connected_components(hamming.class_pairs(rows, n, most).select("a", "b"))
    named = members.join(part, F.col("rep") == F.col("node"), "left").select("episode_id", F.coalesce("component", "rep").alias("part"))
    least = named.groupBy("part").agg(F.min("episode_id").alias("representative"))
    found = named.join(least, "part").select("episode_id", "representative")
    ids = signatures.select("episode_id").distinct()
    out = ids.join(found, "episode_id", "left").select("episode_id", F.coalesce("representative", "episode_id").alias("representative"))
    return out.withColumn("kept", F.col("episode_id") == F.col("representative"))
