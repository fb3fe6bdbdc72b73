"""Motion between decoded frames: dense flow by polynomial expansion, camera against scene, cuts.

Frames are rows ``episode_id, camera, frame_index, timestamp, pixels, height, width``;
``pixels`` are bytes, one or three a pixel, or null where a frame could not be had.
Flow follows the published method (two-frame motion estimation by polynomial expansion): each
neighbourhood is a quadratic, and the quadratics of two frames give the shift between
them, averaged over a window and refined from coarse to fine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators import quality
from tidewheel.operators.images import luma
from tidewheel.session import small_batches

#: Size that flow is estimated at, and what makes a cut or a shaky camera.
LONGEST, BLANK = 64, 1.0
CUT_CORRELATION, CUT_FACTOR, CUT_LEAST, SHAKY = 0.3, 5.0, 1.5, -28.0
#: Coarse to fine: levels, window, rounds at each level, and the reach and width of a neighbourhood.
LEVELS, WINDOW, ROUNDS, REACH, SIGMA = 3, 15, 3, 5, 1.2
#: Pixels whose flow is estimated at a time, and bytes of frames made grey at a time.
PIXELS, FRAME_BYTES = 1 << 15, 1 << 22


def _edged(x: np.ndarray, r: int, axis: int) -> np.ndarray:
    """``r`` more values on both sides of one of the last two axes; edges repeat."""
    return np.take(x, np.clip(np.arange(-r, x.shape[axis] + r), 0, x.shape[axis] - 1), axis=axis)


def _along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along axis -2 or -1; edges repeat."""
    padded, n = _edged(x, len(kernel) // 2, axis), x.shape[axis]
    out = np.zeros(x.shape)
    for k, w in enumerate(kernel):
        out += w * (padded[..., k : k + n, :] if axis == -2 else padded[..., k : k + n])
    return out


def _window_mean(planes: np.ndarray) -> np.ndarray:
    """Mean over a square window of each plane, by running sums; edges repeat."""
    r, x = WINDOW // 2, planes
    for axis in (-2, -1):
        x = _edged(x, r, axis)
    for axis in (-2, -1):
        sums = np.zeros([n + (a == x.ndim + axis) for a, n in enumerate(x.shape)])
        np.cumsum(x, axis=axis, out=sums[..., 1:, :] if axis == -2 else sums[..., 1:])
        x = sums[..., WINDOW:, :] - sums[..., :-WINDOW, :] if axis == -2 else sums[..., WINDOW:] - sums[..., :-WINDOW]
    return x / WINDOW**2


def expand(y: np.ndarray) -> np.ndarray:
    """Each pixel's neighbourhood as a quadratic: linear x and y, then xx, yy and xy, by weighted least squares."""
    at = np.arange(-REACH, REACH + 1.0)
    w = np.exp(-(at**2) / (2 * SIGMA**2))
    w /= w.sum()
    rows = [_along(y, w * at**p, -2) for p in range(3)]
    # moments by powers of x and y
    m = {(px, py): _along(rows[py], w * at**px, -1) for px, py in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))}
    s2, s4 = (w * at**2).sum(), (w * at**4).sum()
    lin_x, lin_y, cross = m[1, 0] / s2, m[0, 1] / s2, m[1, 1] / (s2 * s2)
    # constant and squares are fitted together; all else is orthogonal
    gram = np.array([[1, s2, s2], [s2, s4, s2 * s2], [s2, s2 * s2, s4]])
    solved = np.tensordot(np.linalg.inv(gram), np.stack([m[0, 0], m[2, 0], m[0, 2]]), axes=1)
    return np.stack([lin_x, lin_y, solved[1], solved[2], cross])


def _sample(planes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels, edges held; ``x`` and ``y`` are of one picture, or of each picture of the last axis but two."""
    h, w = planes.shape[-2:]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if x.ndim == 2:
        at = lambda yy, xx: planes[..., yy, xx]
    else:
        flat, base = planes.reshape(*planes.shape[:-3], -1), (np.arange(len(x)) * (h * w))[:, None, None]
        at = lambda yy, xx: np.take(flat, base + yy * w + xx, axis=-1)
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def _resized(planes: np.ndarray, h: int, w: int) -> np.ndarray:
    ys, xs = np.meshgrid((np.arange(h) + 0.5) * planes.shape[-2] / h - 0.5, (np.arange(w) + 0.5) * planes.shape[-1] / w - 0.5, indexing="ij")
    return _sample(planes, xs, ys)


def flows(frames: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Shift of each pixel between pairs of some grey frames of one size: two planes, x and y, of each pair.

    A frame is expanded once, whatever many pairs it is in.
    """
    h, w = frames.shape[1:]
    sizes = [(h, w)]
    while len(sizes) < LEVELS and min(sizes[-1]) >= 2 * WINDOW:
        sizes.append(((sizes[-1][0] + 1) // 2, (sizes[-1][1] + 1) // 2))
    found = np.zeros((2, len(first), *sizes[-1]))
    blur = np.array([1, 4, 6, 4, 1]) / 16
    pyramid = [frames.astype(float)]
    for size in sizes[1:]:
        pyramid.append(_resized(_along(_along(pyramid[-1], blur, -2), blur, -1), *size))
    for level in reversed(range(len(sizes))):
        hh, ww = sizes[level]
        if found.shape[2:] != (hh, ww):
            scale = np.array([ww / found.shape[3], hh / found.shape[2]])[:, None, None, None]
            found = _resized(found, hh, ww) * scale
        expanded = expand(pyramid[level])
        one, two = expanded[:, first], expanded[:, second]
        ys, xs = np.mgrid[0:hh, 0:ww].astype(float)
        for _ in range(ROUNDS):
            there = _sample(two, xs + found[0], ys + found[1])
            axx, ayy, axy = ((one[k] + there[k]) / 2 for k in (2, 3, 4))
            axy = axy / 2
            # shift that is left over, on top of the one assumed
            bx = (one[0] - there[0]) / 2 + axx * found[0] + axy * found[1]
            by = (one[1] - there[1]) / 2 + axy * found[0] + ayy * found[1]
            terms = np.stack([axx * axx + axy * axy, axy * (axx + ayy), ayy * ayy + axy * axy, axx * bx + axy * by, axy * bx + ayy * by])
            g11, g12, g22, h1, h2 = _window_mean(terms)
            det = g11 * g22 - g12 * g12 + 1e-3
            found = np.stack([(g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det])
    return found


def flow(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Shift of each pixel from one grey frame to the next: two planes, x and y."""
    return flows(np.stack([before, now]), np.array([0]), np.array([1]))[:, 0]


@functools.cache
def _affine(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Affine motions of a frame, and what fits them by least squares."""
    ys, xs = np.mgrid[0:h, 0:w].astype(float)
    design = np.stack([xs.ravel() / max(w - 1, 1), ys.ravel() / max(h - 1, 1), np.ones(h * w)], axis=1)
    return design, np.linalg.pinv(design)


def camera_shares(fields: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``camera_share`` of each pair of ``flows``."""
    n, h, w = fields.shape[1:]
    design, fit = _affine(h, w)
    f = fields.reshape(2 * n, -1).T
    rest = f - design @ (fit @ f)
    return np.hypot(rest[:, :n], rest[:, n:]).mean(axis=0), np.hypot(f[:, :n], f[:, n:]).mean(axis=0)


def camera_share(field: np.ndarray) -> tuple[float, float]:
    """Mean length of what one affine motion of the whole frame leaves over, and of all motion."""
    rest, whole = camera_shares(field[:, None])
    return float(rest[0]), float(whole[0])


def histograms(frames: np.ndarray) -> np.ndarray:
    """Grey levels of each frame in 32 bins."""
    n = len(frames)
    level = np.clip(frames.reshape(n, -1), 0, 255).astype(int) // 8
    return np.bincount((level + 32 * np.arange(n)[:, None]).ravel(), minlength=32 * n).reshape(n, 32).astype(float)


def _correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.where(size > 0, (a * b).sum(axis=1) / np.where(size > 0, size, 1), 1.0)


def histogram_correlation(before: np.ndarray, now: np.ndarray) -> float:
    """Of grey levels in 32 bins; 1 for histograms without any spread."""
    a, b = (np.histogram(x, 32, (0, 256))[0].astype(float) for x in (before, now))
    return float(_correlations(a[None], b[None])[0])


def _whole_greys(x: np.ndarray) -> np.ndarray:
    return np.clip(luma(x), 0, 255).astype(np.uint8)


#: What a frame of one byte a pixel has where three equal bytes are made of it.
_GREYS = _whole_greys(np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1))


def grey_frames(pixels: list[bytes], height: int, width: int) -> np.ndarray:
    """Grey levels as whole numbers at the size that flow is estimated at, of frames of one size and as many bytes a pixel."""
    x = np.frombuffer(b"".join(pixels), np.uint8).reshape(len(pixels), height, width, -1)
    if max(height, width) > LONGEST:
        h, w = (max(1, round(n * LONGEST / max(height, width))) for n in (height, width))
        x = x[:, (np.arange(h) * height // h)[:, None], np.arange(w) * width // w]
    return _whole_greys(x) if x.shape[3] == 3 else _GREYS[x[..., 0]]


_STEP = "start_frame long, end_frame long, elapsed double, magnitude double, scene_share double, correlation double, dx double, dy double"


def frame_motion(frames: DataFrame) -> DataFrame:
    """Motion between each frame and the one before it of its camera: magnitude, share that is not the camera's, mean shift.

    A frame without pixels, or without texture, is never bridged, nor is a change of size.
    Frames are walked in order, a batch at a time; a task holds the grey frames of one batch
    and the last one before it, and estimates the flow of ``PIXELS`` at a time.
    """
    small_batches(frames.sparkSession)
    kinds = {n: frames.schema[n].dataType.simpleString() for n in ("episode_id", "camera")}
    width = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["episode_id", "camera", *(x.split()[0] for x in _STEP.split(", "))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("episode_id").to_pylist(), batch.column("camera").to_pylist(), strict=True))
            index, at = batch.column("frame_index").to_pylist(), batch.column("timestamp").to_pylist()
            pixels = batch.column("pixels").to_pylist()
            sizes = list(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True))
            # the frame before is row 0 of what follows, and the batch's rows come after it
            greys: list[np.ndarray | None] = [last[4] if last else None, *[None] * len(keys)]
            if last:
                keys, index, at, sizes = [last[0], *keys], [last[1], *index], [last[2], *at], [last[3], *sizes]
            else:
                keys, index, at, sizes = [None, *keys], [None, *index], [None, *at], [None, *sizes]
            alike: dict[tuple, list[int]] = {}
            for i, (p, size) in enumerate(zip(pixels, sizes[1:], strict=True), 1):
                if p is not None and size[0] and size[1] and len(p) in (size[0] * size[1], 3 * size[0] * size[1]):
                    alike.setdefault((size, len(p)), []).append(i)
            for (size, _), rows in alike.items():
                step = max(1, FRAME_BYTES // len(pixels[rows[0] - 1]))
                for s in range(0, len(rows), step):
                    some = rows[s : s + step]
                    found = grey_frames([pixels[i - 1] for i in some], *size)
                    for i, grey, spread in zip(some, found, found.reshape(len(some), -1).astype(float).std(axis=1).tolist(), strict=True):
                        if spread >= BLANK:
                            greys[i] = grey
            pairs: dict[tuple, list[int]] = {}
            for i in range(1, len(keys)):
                if greys[i] is not None and greys[i - 1] is not None and keys[i] == keys[i - 1] and sizes[i] == sizes[i - 1]:
                    pairs.setdefault(greys[i].shape, []).append(i)
            out: dict[int, tuple] = {}
            for shape, rows in pairs.items():
                step = max(1, PIXELS // (shape[0] * shape[1]))
                for s in range(0, len(rows), step):
                    some = rows[s : s + step]
                    used = sorted({j for i in some for j in (i - 1, i)})
                    place = {j: k for k, j in enumerate(used)}
                    first, second = np.array([place[i - 1] for i in some]), np.array([place[i] for i in some])
                    frames_ = np.stack([greys[j] for j in used])
                    fields, bins = flows(frames_, first, second), histograms(frames_)
                    rest, whole = camera_shares(fields)
                    figures = np.stack([whole, rest / (whole + 1e-6), _correlations(bins[first], bins[second]), *fields.mean(axis=(2, 3))], axis=1)
                    out.update(zip(some, figures.tolist(), strict=True))
            if out:
                rows = sorted(out)
                elapsed = [None if at[i] is None or at[i - 1] is None else at[i] - at[i - 1] for i in rows]
                given = [[keys[i][0] for i in rows], [keys[i][1] for i in rows], [index[i - 1] for i in rows], [index[i] for i in rows], elapsed, *zip(*(out[i] for i in rows), strict=True)]
                types = [batch.schema.field("episode_id").type, batch.schema.field("camera").type, pa.int64(), pa.int64(), *[pa.float64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(given, types, strict=True)], names=names)
            last = (keys[-1], index[-1], at[-1], sizes[-1], greys[-1])

    some = frames.select("episode_id", "camera", F.col("frame_index").cast("long").alias("frame_index"), F.col("timestamp").cast("double").alias("timestamp"), "pixels", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    placed = some.repartition(width, "episode_id", "camera").sortWithinPartitions("episode_id", "camera", "frame_index")
    return placed.mapInArrow(walk, f"episode_id {kinds['episode_id']}, camera {kinds['camera']}, {_STEP}")


def camera_motion(frames: DataFrame, fps: float | None = None) -> DataFrame:
    """``mean_motion`` (pixels a frame), ``mean_motion_px_s, scene_motion_fraction, cut_count, motion_smoothness`` and flags by camera.

    A cut is a break in the histogram together with a jump of the flow, against the
    camera's median and in itself. Smoothness is that of the summed shifts, where no frame
    breaks the sequence and times are even. Every camera has a row; figures are null
    without motion to judge. ``mean_motion`` is what ``video.episode_rollup`` reads.
    """
    from tidewheel.session import materialize

    key = ["episode_id", "camera"]
    steps = materialize(frame_motion(frames), "motion")
    apart = F.col("end_frame") - F.col("start_frame")
    n = F.when(F.col("elapsed").isNotNull(), F.col("elapsed") * fps).otherwise(apart) if fps else apart
    steps = steps.withColumn("per_frame", F.try_divide(F.col("magnitude"), n.cast("double")))
    w = Window.partitionBy(*key)
    middle = steps.groupBy(*key).agg(F.greatest(F.median("per_frame") * CUT_FACTOR, F.lit(CUT_LEAST)).alias("_least"))
    cut = (F.col("correlation") < CUT_CORRELATION) & (F.col("per_frame") > F.col("_least"))
    totals = steps.join(middle, key).groupBy(*key).agg(
        F.avg("per_frame").alias("mean_motion"), F.avg(F.try_divide(F.col("magnitude"), F.col("elapsed"))).alias("mean_motion_px_s"), F.avg("scene_share").alias("scene_motion_fraction"), F.count_if(cut).alias("cut_count"),
        F.count("*").alias("_n"), F.count("elapsed").alias("_timed"), (F.stddev_pop("elapsed") / F.avg("elapsed")).alias("_uneven"), F.min("start_frame").alias("_first"), F.max("end_frame").alias("_last"),
    )
    in_order = w.orderBy("start_frame").rowsBetween(Window.unboundedPreceding, 0)
    path = steps.select(F.struct(*key).alias("episode_id"), F.col("start_frame").alias("frame_index"), F.array(F.sum("dx").over(in_order), F.sum("dy").over(in_order)).alias("state"))
    # the measure has no dimension, so any rate will do
    smooth = quality.ldlj(path, 1.0).select("episode_id.*", F.col("ldlj").alias("_ldlj"))
    whole = frames.groupBy(*key).agg(F.count("*").alias("_frames"))
    out = whole.join(totals, key, "left").join(smooth, key, "left")
    steady = (F.col("_n") == F.col("_frames") - 1) & ((F.col("_timed") == 0) | ((F.col("_timed") == F.col("_n")) & (F.col("_uneven") < 0.1))) & (F.col("_n") >= 3)
    out = out.withColumn("motion_smoothness", F.when(steady, F.col("_ldlj")))
    flags = F.array_compact(F.array(F.when(F.col("cut_count") > 0, F.lit("cut_detected")), F.when(F.col("motion_smoothness") < SHAKY, F.lit("shaky"))))
    return out.select(*key, "mean_motion", "mean_motion_px_s", "scene_motion_fraction", "cut_count", "motion_smoothness", flags.alias("flags"))
