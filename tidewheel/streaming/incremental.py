"""Streams of frames and of new episodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewheel.plans.catalog import Catalog


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Episodes of a stream split where nothing came for ``gap``; late events up to ``late`` count."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n_frames"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(key, "n_frames", "first", "last")


def windows(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def ingest_stream(episodes: DataFrame, root: str, checkpoint: str):
    """Register a stream's episodes in a catalog, each content once.

    A micro-batch's id is the id of its commit: a batch that is run again after a
    failure finds its commit and is passed over. The catalog stays open between
    micro-batches, so each reads the commits since the one before.
    """
    opened: list[Catalog] = []

    def batch(df: DataFrame, epoch: int) -> None:
        if not opened:
            opened.append(Catalog(df.sparkSession, root))
        catalog = opened[0]
        name = f"stream-{epoch:012d}"
        if not catalog.log.has_batch(name):
            from tidewheel.functions.vectors import latest

            new = latest(df, ["content_hash"], F.col("episode_id")).join(catalog.table("episodes").select("content_hash"), "content_hash", "left_anti")
            catalog.commit({"episodes": new}, name)

    return episodes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


class FrameCounter(StatefulProcessor):
    """Running figures of each episode: frames, path length, longest gap. Frames out of order count as late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("figures", "n long, late long, path double, gap double, t double, x double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, late, path, gap, t, x = self.state.get() if self.state.exists() else (0, 0, 0.0, 0.0, None, None)
        for part in rows:
            for at, value in part.sort_values("timestamp")[["timestamp", "x"]].itertuples(index=False):
                if t is not None and at <= t:
                    late += 1
                    continue
                if t is not None:
                    path, gap = path + abs(value - x), max(gap, at - t)
                n, t, x = n + 1, float(at), float(value)
        self.state.update((n, late, path, gap, t, x))
        yield pd.DataFrame({"episode_id": [key[0]], "n_frames": [n], "n_late": [late], "path": [path], "longest_gap": [gap]})

    def close(self) -> None:
        pass


def frame_figures(frames: DataFrame) -> DataFrame:
    """Figures of each episode after every micro-batch that has frames of it (``timestamp``, ``x``)."""
    kind = frames.schema["episode_id"].dataType.simpleString()
    return frames.groupBy("episode_id").transformWithStateInPandas(
        FrameCounter(), f"episode_id {kind}, n_frames long, n_late long, path double, longest_gap double", "Update", "None"
    )
