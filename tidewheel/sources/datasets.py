"""Any known dataset as frames and episodes, and conversion from one format to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources import lerobot, messages, rlds, zarr

READABLE = ("lerobot-v2", "lerobot-v3", "groot", "rlds", "zarr", "mcap")
WRITABLE = ("lerobot-v3", "rlds", "mcap")
COLUMNS = ("episode_id", "frame_index", "timestamp", "action", "state")


def open_dataset(spark: SparkSession, root: str, fps: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Frames ``episode_id, frame_index, timestamp, action, state`` and episodes ``episode_id, language_instruction``.

    ``fps`` times the frames of formats that carry no times. An RLDS episode is named by
    its file and place in it. Formats that are only detected raise.
    """
    kind = lerobot.detect_format(spark, root)
    if kind not in READABLE:
        raise ValueError(f"{kind} datasets are detected, not read")
    if kind == "rlds":
        steps = rlds.read_frames(spark, root, fps)
        name = F.concat(F.regexp_extract("path", "[^/]+$", 0), F.lit("#"), F.lpad(F.col("record").cast("string"), 6, "0"))
        frames = steps.withColumn("episode_id", name)
        said = F.min_by("language_instruction", "frame_index")
        return frames.select(*COLUMNS), frames.groupBy("episode_id").agg(F.nullif(said, F.lit("")).alias("language_instruction"))
    if kind == "zarr":
        frames = zarr.read_frames(spark, root).withColumn("timestamp", F.coalesce("timestamp", F.col("frame_index") / fps))
        return frames.select(*COLUMNS), frames.select("episode_id").distinct().withColumn("language_instruction", F.lit(None).cast("string"))
    if kind == "mcap":
        frames, episodes = messages.read_numbered(spark, root) if messages.has_episode_topics(spark, root) else messages.read_episodes(spark, root)
        return frames.select(*COLUMNS), episodes
    return lerobot.read_frames(spark, root).select(*COLUMNS), lerobot.read_episodes(spark, root).select("episode_id", "language_instruction")


def convert(spark: SparkSession, source: str, target: str, kind: str, fps: float = 30.0, name: str = "episodes") -> None:
    """Write the dataset at ``source`` to ``target`` in the format ``kind``."""
    if kind not in WRITABLE:
        raise ValueError(f"the format to write must be one of {WRITABLE}")
    frames, episodes = open_dataset(spark, source, fps)
    if kind == "rlds":
        rlds.write(frames, episodes, target, name, fps)
    elif kind == "mcap":
        messages.write_episodes(frames, episodes, target)
    else:
        lerobot.write_v3(frames, episodes, target, fps)
