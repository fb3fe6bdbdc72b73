"""What SQL can call by name: events of an episode as a table function, and smoothness as an aggregate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidewheel.operators import kernels
from tidewheel.operators.diagnostics import GAP_STEPS, REPEAT_EPS, SLOW

_NEEDED = ("episode_id", "frame_index", "timestamp", "state", "action")


def _steps(a, b) -> list[float | None]:
    n = max(len(a), len(b))
    at = lambda x, k: x[k] if k < len(x) else None
    return [None if at(a, k) is None or at(b, k) is None else abs(at(a, k) - at(b, k)) for k in range(n)]


class QualityEvents:
    """``quality_events(TABLE(frames) PARTITION BY episode_id ORDER BY (frame_index), fps => 30.0 [, min_seconds => 0.5])``.

    Gaps in time, held commands and pauses of each partition, as ``diagnostics.proprio_events``
    finds them: ``episode_id, kind, start, end, start_time, end_time``. A frame is looked at once, and only the one
    before and the open runs are kept, whatever the episode's length.
    """

    @staticmethod
    def analyze(frames: AnalyzeArgument, fps: AnalyzeArgument, min_seconds: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not frames.isTable:
            raise ValueError("the first argument must be a table")
        names = {f.name: f.dataType for f in frames.dataType.fields}
        if missing := [n for n in _NEEDED if n not in names]:
            raise ValueError(f"the table has no columns {missing}")
        for name, a in (("fps", fps), ("min_seconds", min_seconds)):
            if a is not None and (a.isTable or a.value is None or not float(a.value) >= 0):
                raise ValueError(f"{name} must be a number of 0 or more")
        if not float(fps.value) > 0:
            raise ValueError("fps must be above 0")
        return AnalyzeResult(
            StructType([StructField("episode_id", names["episode_id"]), StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("start_time", DoubleType()), StructField("end_time", DoubleType())])
        )

    def __init__(self):
        self.last = None
        self.at = -1
        self.open: dict[str, list] = {}
        self.least: dict[str, float] = {}

    def eval(self, row, fps, min_seconds=0.5):
        self.at += 1
        before, self.last = self.last, row
        self.least = {"timestamp_gap": 0.0, "held_command": float(min_seconds), "motion_pause": float(min_seconds)}
        if before is None:
            return
        t, t0 = row["timestamp"], before["timestamp"]
        dt = None if t is None or t0 is None else t - t0
        valid = dt is not None and 0 < dt <= GAP_STEPS / float(fps)
        held = slow = False
        if valid and row["action"] is not None and before["action"] is not None:
            held = all(d is not None and d <= REPEAT_EPS for d in _steps(row["action"], before["action"]))
        if valid and row["state"] is not None and before["state"] is not None:
            moved = [d for d in _steps(row["state"], before["state"]) if d is not None]
            # a number that is none is the largest
            slow = bool(moved) and not any(math.isnan(d) for d in moved) and max(moved) / dt <= SLOW
        for kind, on in (("timestamp_gap", dt is not None and not valid), ("held_command", held), ("motion_pause", slow)):
            if on:
                run = self.open.setdefault(kind, [self.at - 1, t0, t])
                run[1], run[2] = min(run[1], t0), max(run[2], t)
            elif kind in self.open:
                yield from self._close(kind, self.at, before["episode_id"])

    def _close(self, kind, end, episode):
        start, a, b = self.open.pop(kind)
        if b - a + 1e-9 >= self.least[kind]:
            yield episode, kind, start, end, a, b

    def terminate(self):
        for kind in list(self.open):
            yield from self._close(kind, self.at + 1, self.last["episode_id"])


def _smoothness(state: pd.Series, frame_index: pd.Series, fps: pd.Series) -> float:
    order = np.argsort(frame_index.to_numpy(), kind="stable")
    found = kernels.sparc(kernels._matrix(state.iloc[order]), 1.0 / float(fps.iloc[0])) if len(state) else None
    return float("nan") if found is None else found


def register(spark: SparkSession) -> None:
    """``quality_events`` as a table function and ``sparc(state, frame_index, fps)`` as an aggregate, null without motion."""
    spark.udtf.register("quality_events", udtf(QualityEvents))
    spark.udf.register("sparc", pandas_udf(_smoothness, DoubleType()))
