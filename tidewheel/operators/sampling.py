"""Frames that stand for an episode, and models that turn them into vectors."""

from __future__ import annotations

import datetime
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_FRAMES = 32
POOLING = ("mean", "first-mid-last")
#: A model's name to a function that makes it; a model maps a list of frames or texts to rows of numbers.
MODELS: dict[str, Callable[[], Callable]] = {}


def register_model(name: str):
    def keep(make: Callable[[], Callable]) -> Callable[[], Callable]:
        if name in MODELS:
            raise ValueError(f"there is a model named {name}")
        MODELS[name] = make
        return make

    return keep


def model(name: str) -> Callable:
    if name not in MODELS:
        raise ValueError(f"no such model: {name}; there are {sorted(MODELS)}")
    return MODELS[name]()


def sampled_frames(frames: DataFrame, fps: float | None, hz: float = 1.0, most: int = MOST_FRAMES, key: tuple[str, ...] = ("episode_id",)) -> DataFrame:
    """About ``hz`` frames a second of each key, evenly thinned to ``most``; all frames stand for an unknown rate.

    The k-th of ``most`` is frame ``round(k * (n - 1) / (most - 1))`` of the n that the stride leaves, halves to even.
    """
    stride = max(1, round(fps / hz)) if fps and fps > 0 and hz > 0 else 1
    w = Window.partitionBy(*key)
    x = frames.withColumn("_i", F.row_number().over(w.orderBy("frame_index")) - 1).where(F.col("_i") % stride == 0)
    x = x.withColumns({"_n": F.count("*").over(w), "_j": F.row_number().over(w.orderBy("frame_index")) - 1})
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(max(most - 1, 1))).cast("int"))
    return x.where((F.col("_n") <= most) | F.array_contains(places, F.col("_j").cast("int"))).drop("_i", "_n", "_j")


def pool(vectors: np.ndarray, method: str = "mean") -> np.ndarray:
    """One vector from those of the sampled frames: the mean of all, or of the first, middle and last."""
    x = np.asarray(vectors, "f4")
    if x.ndim != 2 or not len(x):
        raise ValueError("there are no vectors to pool")
    if method not in POOLING:
        raise ValueError(f"pooling must be one of {POOLING}")
    return x.mean(axis=0) if method == "mean" else x[sorted({0, len(x) // 2, len(x) - 1})].mean(axis=0)


def embed_episodes(images: DataFrame, name: str, fps: float | None, done: DataFrame | None = None, pooling: str = "mean", hz: float = 1.0, make: Callable[[], Callable] | None = None) -> DataFrame:
    """A vector for each episode and camera, as rows of the catalog's ``embeddings``.

    ``images`` has ``episode_id, camera, frame_index, image``; episodes of ``done`` that have
    vectors of the model are left out. A task holds the sampled frames of one camera,
    ``MOST_FRAMES`` at most. ``make`` gives the model where tasks do not know ``MODELS``.
    """
    if pooling not in POOLING:
        raise ValueError(f"pooling must be one of {POOLING}")
    build = make or MODELS.get(name)
    if build is None:
        raise ValueError(f"no such model: {name}; there are {sorted(MODELS)}")
    if done is not None:
        images = images.join(done.where(F.col("model_id") == name).select("episode_id").distinct(), "episode_id", "left_anti")
    chosen = sampled_frames(images, fps, hz, key=("episode_id", "camera"))
    now = datetime.datetime.now(datetime.timezone.utc)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_index", kind="stable")
        found = np.asarray(build()(list(rows["image"])), "f4")
        vector = pool(found, pooling)
        return pd.DataFrame({"episode_id": [rows["episode_id"].iloc[0]], "camera": [rows["camera"].iloc[0]], "dim": [len(vector)], "vector": [vector.tolist()], "num_frames_sampled": [len(found)]})

    made = chosen.groupBy("episode_id", "camera").applyInPandas(run, "episode_id string, camera string, dim int, vector array<float>, num_frames_sampled int")
    return made.withColumns({"model_id": F.lit(name), "level": F.lit("episode"), "pooling": F.lit(pooling), "computed_at": F.lit(now)})


def embed_instructions(episodes: DataFrame, name: str, make: Callable[[], Callable] | None = None) -> DataFrame:
    """A vector for the instruction of each episode that has one, as rows of ``embeddings``."""
    build = make or MODELS.get(name)
    if build is None:
        raise ValueError(f"no such model: {name}; there are {sorted(MODELS)}")
    now = datetime.datetime.now(datetime.timezone.utc)

    def run(batches):
        embed = build()
        for rows in batches:
            x = np.asarray(embed(list(rows["language_instruction"])), "f4")
            yield pd.DataFrame({"episode_id": rows["episode_id"], "dim": x.shape[1], "vector": list(x.tolist())})

    said = episodes.where(F.trim(F.coalesce("language_instruction", F.lit(""))) != "").select(F.col("episode_id").cast("string").alias("episode_id"), "language_instruction")
    made = said.mapInPandas(run, "episode_id string, dim int, vector array<float>")
    return made.withColumns({"model_id": F.lit(name), "level": F.lit("instruction"), "camera": F.lit(None).cast("string"), "pooling": F.lit("none"), "num_frames_sampled": F.lit(None).cast("int"), "computed_at": F.lit(now)})
