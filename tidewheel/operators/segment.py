"""Change-point segmentation of episodes and the phase that each segment shows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators.kernels import pelt

#: Gripper change that counts as opening or closing, and the level that counts as closed.
GRIPPER_STEP, GRIPPER_CLOSED = 0.15, 0.5


#: Names that a signal goes by, and the columns that are looked at for it, in order.
SIGNALS = {"observation.state": ("state", "joint_positions"), "state": ("state", "joint_positions"), "qpos": ("joint_positions",), "joint_positions": ("joint_positions",), "joint_velocities": ("joint_velocities",), "action": ("action",)}


def with_signal(frames: DataFrame, name: str = "observation.state", out: str = "signal") -> DataFrame:
    """Adds a signal by its name: in each frame the first of its columns that is there and not null.

    An unknown name, or one of which the frames have no column, raises.
    """
    if name not in SIGNALS:
        raise ValueError(f"no signal {name!r}; there are {', '.join(SIGNALS)}")
    there = [c for c in SIGNALS[name] if c in frames.columns]
    if not there:
        raise ValueError(f"the frames have no column for the signal {name!r}")
    return frames.withColumn(out, F.coalesce(*there))


def penalty_of(penalty: str | float, n: int, dims: int) -> float:
    return math.log(max(n, 1)) * dims if penalty == "bic" else 2.0 * dims if penalty == "aic" else float(penalty)


def segment_episodes(frames: DataFrame, signal: str = "state", model: str = "rbf", penalty: str | float = "bic", min_size: int = 10, min_frames: int = 5) -> DataFrame:
    """Segments of each episode: ``episode_id, segment, start, end`` (exclusive).

    Frames without a signal are left out; NaN counts as zero; dimensions are brought to
    zero mean and unit deviation. Episodes under ``min_frames`` are one segment.
    """
    kind = frames.schema["episode_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_index", kind="stable")
        x = np.nan_to_num(np.array([np.asarray(v, "f8") for v in rows["signal"]]), nan=0.0, posinf=0.0, neginf=0.0)
        if len(x) < min_frames:
            ends = [len(x)]
        else:
            ends = pelt((x - x.mean(0)) / (x.std(0) + 1e-8), penalty_of(penalty, *x.shape), min_size, model)
        return pd.DataFrame({"episode_id": rows["episode_id"].iloc[0], "segment": range(len(ends)), "start": [0, *ends[:-1]], "end": ends})

    source = frames.select("episode_id", "frame_index", F.col(signal).alias("signal")).where("signal is not null")
    return source.groupBy("episode_id").applyInPandas(run, f"episode_id {kind}, segment long, start long, end long")


def label_phases(frames: DataFrame, segments: DataFrame, signal: str = "state", gripper: str | None = None) -> DataFrame:
    """The phase of each segment by speed and gripper: adds ``mean_speed, speed_std, label``.

    Starts of segments are put in order with the frames, so each frame takes the last one
    before it, in time linear in both.
    """
    w = Window.partitionBy("episode_id").orderBy("frame_index")
    step = F.zip_with(signal, F.lag(signal).over(w), lambda a, b: a - b)
    x = frames.withColumn("_v", F.coalesce(F.sqrt(F.aggregate(step, F.lit(0.0), lambda s, v: s + v * v)), F.lit(0.0)))
    x = x.withColumn("_pos", F.row_number().over(w) - 1)
    moving = F.when(F.col("_v") > 1e-8, F.col("_v"))
    limits = x.groupBy("episode_id").agg(F.percentile(moving, 0.2).alias("_p20"), F.percentile(moving, 0.7).alias("_p70"), F.count(moving).alias("_n"))
    limits = limits.select("episode_id", F.when(F.col("_n") < 5, 1e-6).otherwise(F.col("_p20")).alias("low"), F.when(F.col("_n") < 5, 1e-3).otherwise(F.col("_p70")).alias("high"))
    g = F.col(gripper) if gripper else F.lit(None).cast("double")
    span = F.struct("segment", "start", "end")
    marks = segments.select("episode_id", F.col("start").cast("int").alias("_pos"), F.lit(None).cast("double").alias("_v"), F.lit(None).cast("double").alias("_g"), span.alias("_span"))
    rows = x.select("episode_id", "_pos", "_v", g.cast("double").alias("_g"), F.lit(None).cast(marks.schema["_span"].dataType).alias("_span")).unionByName(marks)
    upto = Window.partitionBy("episode_id").orderBy("_pos", F.col("_span").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_in", F.last("_span", ignorenulls=True).over(upto)).where(F.col("_span").isNull() & (F.col("_pos") < F.col("_in.end"))).select("episode_id", "_pos", "_v", "_g", "_in.*")
    per = inside.groupBy("episode_id", "segment", "start", "end").agg(
        F.avg("_v").alias("mean_speed"), F.stddev_pop("_v").alias("speed_std"), F.avg("_g").alias("_gm"), (F.max_by("_g", "_pos") - F.min_by("_g", "_pos")).alias("_gd")
    )
    per = per.join(limits, "episode_id")
    slow, c = F.col("mean_speed") < F.col("low"), F.col
    if gripper:
        label = (
            F.when(slow & (F.abs("_gd") < GRIPPER_STEP), "idle")
            .when(c("_gd") < -GRIPPER_STEP, "grasping")
            .when(c("_gd") > GRIPPER_STEP, "placing")
            .when((c("mean_speed") > c("low")) & (c("_gm") < GRIPPER_CLOSED), "transporting")
            .when((c("mean_speed") >= c("high")) & (c("_gm") < GRIPPER_CLOSED), "transporting")
            .when((c("mean_speed") > c("low")) | (c("mean_speed") >= c("high")), "reaching")
            .when(c("speed_std") < c("low"), "fine_manipulation")
            .otherwise("unknown")
        )
    else:
        label = F.when(slow, "idle").when(c("speed_std") < c("low"), "fine_manipulation").otherwise("moving")
    out = per.withColumn("label", label)
    if gripper:
        before = F.lag("label").over(Window.partitionBy("episode_id").orderBy("segment"))
        again = (before == "placing") & (c("mean_speed") >= c("high")) & c("label").isin("reaching", "moving", "unknown")
        out = out.withColumn("label", F.when(again, "retracting").otherwise(c("label")))
    return out.drop("_gm", "_gd", "low", "high")


def segment_summary(segments: DataFrame) -> DataFrame:
    """Segments per episode over the dataset: mean, upper median, least, most, and change points in all."""
    per = segments.groupBy("episode_id").agg(F.count("*").alias("n"))
    middle = F.percentile("n", 0.5)  # the upper of two middle values is the ceiling of half the count
    ranked = per.agg(F.avg("n").alias("mean_segments"), F.min("n").alias("min_segments"), F.max("n").alias("max_segments"), F.sum(F.col("n") - 1).alias("total_changepoints"), F.expr("percentile_disc(0.5) within group (order by n desc)").alias("median_segments"), middle.alias("_m"))
    return ranked.drop("_m")
