"""Video quality by camera over a stream: frames in any order, one row for each camera when it has gone quiet.

State is kept by episode and camera: running figures, and in a map by frame the rows of the
last seconds. Rows older than these are taken into the figures in the order of frames, so
what comes out of order within that time counts as if it had come in order, and the map stays small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewheel.operators import video
from tidewheel.operators.images import BLURRY, DARK

MEASURES = ("sharpness", "brightness", "shadow_fraction", "highlight_fraction", "colourfulness")
_ROW = "timestamp double, outcome string, frozen boolean, height int, width int, " + ", ".join(f"{m} double" for m in MEASURES)
#: Running figures: counts and sums, then what the last frames were.
_COUNTS = ("expected_frames", *video.OUTCOMES, "n_late", "resolution_changes", "n_stored", "n_gaps", "n_dt", "n_lost", "n_sharp", "n_blurry", "n_over_known", "n_over", "n_under_known", "n_under", "n_luma", "n_colour", "n_frozen_known", "n_frozen", "run_frozen", "longest_frozen_run", "any_at", "large")
_SUMS = ("sum_sharp", "sum_luma", "sum_colour", "mean_dt", "m2_dt")
_LAST = ("min_sharp", "max_gap_s", "max_frozen_s", "last_time", "run_first", "run_last", "last_event_ms")
_STATE = ", ".join([*(f"{n} long" for n in _COUNTS), *(f"{n} double" for n in (*_SUMS, *_LAST)), "last_frame long", "last_height long", "last_width long", "first long"])
_NAMES = [x.split()[0] for x in _STATE.split(", ")]


class Figures:
    """The running figures of one camera; frames are added in order."""

    def __init__(self, values: tuple | None, fps: float):
        self.fps = fps
        for k, name in enumerate(_NAMES):
            setattr(self, name, values[k] if values else 0 if name in _COUNTS else 0.0 if name in _SUMS else None)

    def values(self) -> tuple:
        return tuple(getattr(self, n) for n in _NAMES)

    def add(self, frame: int, r: dict) -> None:
        self.expected_frames += 1
        self.last_frame = frame
        if r["outcome"] in video.OUTCOMES:
            setattr(self, r["outcome"], getattr(self, r["outcome"]) + 1)
        t = r["timestamp"]
        if t is not None:
            self.n_stored += 1
        # the frame right before decides, as a window's lag does
        if t is not None and self.last_time is not None and t > self.last_time:
            self._step(t - self.last_time)
        self.last_time = t
        if r["outcome"] == "decoded":
            self._decoded(frame, r)

    def _step(self, dt: float) -> None:
        self.n_dt += 1
        d = dt - self.mean_dt
        self.mean_dt += d / self.n_dt
        self.m2_dt += d * (dt - self.mean_dt)
        if dt > video.GAP_FACTOR / self.fps:
            lost = max(0, int(round(dt * self.fps)) - 1)
            self.n_gaps += 1
            self.n_lost += lost
            self.max_gap_s = dt if self.max_gap_s is None else max(self.max_gap_s, dt)
            if lost >= video.DROP_FRAMES or dt - 1 / self.fps >= video.DROP_SECONDS - 1e-9:
                self.large = 1

    def _decoded(self, frame: int, r: dict) -> None:
        sharp, luma, dark, bright, colour = (r[m] for m in MEASURES)
        if sharp is not None:
            self.n_sharp += 1
            self.sum_sharp += sharp
            self.min_sharp = sharp if self.min_sharp is None else min(self.min_sharp, sharp)
            self.n_blurry += sharp < BLURRY
        if luma is not None:
            self.n_luma += 1
            self.sum_luma += luma
        if colour is not None:
            self.n_colour += 1
            self.sum_colour += colour
        if bright is not None:
            self.n_over_known += 1
            self.n_over += bright > video.CLIPPED_PIXELS
        # either of two reasons; one alone may say so without the other
        a, b = None if dark is None else dark > video.CLIPPED_PIXELS, None if luma is None else luma < DARK
        if a or b or (a is not None and b is not None):
            self.n_under_known += 1
            self.n_under += bool(a or b)
        if r["height"] is not None and r["width"] is not None:
            if self.last_height is not None and (self.last_height, self.last_width) != (r["height"], r["width"]):
                self.resolution_changes += 1
            self.last_height, self.last_width = int(r["height"]), int(r["width"])
        at = r["timestamp"] if r["timestamp"] is not None else frame / self.fps
        self.any_at = 1
        if r["frozen"] is not None:
            self.n_frozen_known += 1
            self.n_frozen += bool(r["frozen"])
        if r["frozen"]:
            self._freeze(at)
        else:
            self.run_frozen, self.run_first, self.run_last = 0, at, None

    def _freeze(self, at: float) -> None:
        self.run_first = at if self.run_first is None else min(self.run_first, at)
        self.run_frozen += 1
        self.run_last = at if self.run_last is None else max(self.run_last, at)
        self.longest_frozen_run = max(self.longest_frozen_run, self.run_frozen)
        span = self.run_last - self.run_first
        self.max_frozen_s = span if self.max_frozen_s is None else max(self.max_frozen_s, span)

    def row(self) -> dict:
        share = lambda n, of: n / of if of else None
        return {
            **{n: getattr(self, n) for n in ("expected_frames", *video.OUTCOMES, "n_late", "resolution_changes", "longest_frozen_run")},
            "mean_sharpness": share(self.sum_sharp, self.n_sharp), "min_sharpness": self.min_sharp, "blurry_fraction": share(self.n_blurry, self.n_sharp), "overexposed_fraction": share(self.n_over, self.n_over_known),
            "underexposed_fraction": share(self.n_under, self.n_under_known), "mean_luma": share(self.sum_luma, self.n_luma), "mean_colourfulness": share(self.sum_colour, self.n_colour), "frozen_fraction": share(self.n_frozen, self.n_frozen_known),
            "max_frozen_s": (self.max_frozen_s or 0.0) if self.any_at else None, "timestamp_gaps": self.n_gaps, "max_gap_s": self.max_gap_s, "dropped_frames": self.n_lost if self.n_dt else None,
            "effective_fps": share(1.0, self.mean_dt), "jitter_ratio": share(math.sqrt(self.m2_dt / self.n_dt), self.mean_dt) if self.n_dt else None, "_n": self.n_dt, "_stored": self.n_stored, "_large": bool(self.large),
        }


_TOTALS = ", ".join(
    [*(f"{n} long" for n in ("expected_frames", *video.OUTCOMES, "n_late", "resolution_changes", "longest_frozen_run")), *(f"{n} double" for n in ("mean_sharpness", "min_sharpness", "blurry_fraction", "overexposed_fraction", "underexposed_fraction", "mean_luma", "mean_colourfulness", "frozen_fraction", "max_frozen_s")), "timestamp_gaps long, max_gap_s double, dropped_frames long, effective_fps double, jitter_ratio double, _n long, _stored long, _large boolean"]
)


_WAITING = f"event_ms long, {_ROW}"
_COLUMNS = [x.split()[0] for x in _WAITING.split(", ")]


def _known(x):
    return None if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x) else x


class CameraState(StatefulProcessor):
    def __init__(self, fps: float, late_ms: int, quiet_ms: int, ttl_ms: int | None):
        self.fps, self.late_ms, self.quiet_ms, self.ttl_ms = fps, late_ms, quiet_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.figures = handle.getValueState("figures", _STATE, self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "frame long", _WAITING, self.ttl_ms)

    def _figures(self) -> Figures:
        return Figures(tuple(self.figures.get()) if self.figures.exists() else None, self.fps)

    def _take(self, f: Figures, up_to_ms: float | None) -> None:
        """Waiting rows into the figures, all or those seen by then."""
        rows = sorted(((int(k[0]), tuple(v)) for k, v in self.waiting.iterator()), key=lambda x: x[0])
        for frame, v in rows:
            if up_to_ms is None or v[0] <= up_to_ms:
                f.add(frame, dict(zip(_COLUMNS, v, strict=True)))
                self.waiting.removeKey((frame,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        f = self._figures()
        for part in rows:
            columns = {n: part[n].tolist() if n in part else [None] * len(part) for n in _COLUMNS[1:]}
            for k, (frame, event) in enumerate(zip(part["frame_index"].tolist(), part["event_time"], strict=True)):
                frame, ms = int(frame), int(event.value // 1_000_000)
                f.last_event_ms = float(ms) if f.last_event_ms is None else max(f.last_event_ms, float(ms))
                if f.last_frame is not None and frame <= f.last_frame or self.waiting.containsKey((frame,)):
                    f.n_late += 1
                    continue
                v = {n: _known(c[k]) for n, c in columns.items()}
                as_ = lambda kind, n: None if v[n] is None else kind(v[n])  # noqa: B023, E731
                self.waiting.updateValue((frame,), (ms, as_(float, "timestamp"), v["outcome"], as_(bool, "frozen"), as_(int, "height"), as_(int, "width"), *(as_(float, m) for m in MEASURES)))
        self._take(f, f.last_event_ms - self.late_ms)
        self.figures.update(f.values())
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(f.last_event_ms) + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        f = self._figures()
        self._take(f, None)
        self.waiting.clear()
        self.figures.clear()
        if f.expected_frames:
            row = {"episode_id": key[0], "camera": key[1]} | f.row()
            yield pd.DataFrame({n: pd.Series([v], dtype="object") for n, v in row.items()})

    def close(self) -> None:
        pass


def camera_quality(frames: DataFrame, fps: float, event_time: str = "event_time", late_seconds: float = 10.0, quiet_seconds: float = 30.0, ttl_seconds: float | None = None) -> DataFrame:
    """``video.camera_quality`` of a stream: a row for each episode and camera, once it has been quiet for ``quiet_seconds``.

    ``event_time`` says when a frame was seen. Frames may come ``late_seconds`` out of order
    within their camera; one that comes later, or twice, counts in ``n_late`` and nowhere
    else. The watermark is both spans behind the latest frame of all cameras; what is older still is dropped by
    Spark. Where frames have ``height`` and ``width``, ``resolution_changes`` counts changes between decoded
    ones. State that nobody touches for ``ttl_seconds`` is given up.
    """
    seen = frames.withColumn("event_time", F.col(event_time)).withWatermark("event_time", f"{late_seconds + quiet_seconds} seconds")
    kinds = [seen.schema[n].dataType.simpleString() for n in video.KEY]
    state = CameraState(fps, int(late_seconds * 1000), int(quiet_seconds * 1000), int(ttl_seconds * 1000) if ttl_seconds else None)
    found = seen.groupBy(*video.KEY).transformWithStateInPandas(state, f"episode_id {kinds[0]}, camera {kinds[1]}, {_TOTALS}", "Append", "EventTime")
    return video.judged(found)
