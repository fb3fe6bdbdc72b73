"""Video quality by camera and by episode, from one row per expected frame of a camera.

Rows: ``episode_id, camera, frame_index, timestamp, outcome`` (``decoded missing
decode_failure invalid stride cap``) and, where decoded, the measures of
``images.frame_measures``: ``sharpness, brightness, shadow_fraction, highlight_fraction,
colourfulness, frozen`` (null for the first frame and after a break). All is SQL over one
shuffle by episode and camera.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators.images import BLURRY, DARK
from tidewheel.operators.temporal import runs

#: Fixed values.
CLIPPED_PIXELS, BLURRY_FRAMES, EXPOSURE_FRAMES = 0.20, 0.30, 0.25
FROZEN_FRAMES, FROZEN_SECONDS, FROZEN_RUN = 0.5, 0.5, 10
GAP_FACTOR, DROP_FRAMES, DROP_SECONDS, DROP_FRACTION = 1.5, 3, 0.2, 0.05
NO_MOTION = 0.05

KEY = ["episode_id", "camera"]
OUTCOMES = ("missing", "decoded", "decode_failure", "invalid", "stride", "cap")


def _decoded():
    return F.col("outcome") == "decoded"


def _count(condition):
    return F.count_if(condition).cast("long")


def _timed(frames: DataFrame, fps: float) -> DataFrame:
    """Each frame beside the time before it, the gap, and the frames that the gap hides."""
    w = Window.partitionBy(*KEY).orderBy("frame_index")
    gap = F.col("timestamp") - F.lag("timestamp").over(w)
    known = frames.withColumns({"_pos": F.row_number().over(w) - 1, "_dt": F.when(gap > 0, gap)})
    is_gap = F.col("_dt") > F.lit(GAP_FACTOR / fps)
    lost = F.greatest(F.lit(0), F.bround(F.col("_dt") * fps).cast("int") - 1)
    known = known.withColumn("_lost", F.when(is_gap, lost))
    large = (F.col("_lost") >= DROP_FRAMES) | (F.col("_dt") - 1 / fps >= DROP_SECONDS - 1e-9)
    return known.withColumn("_large", F.col("_lost").isNotNull() & large)


def frame_gaps(frames: DataFrame, fps: float) -> DataFrame:
    """Gaps in a camera's times: where, how long, frames they hide, and if that is significant."""
    return _timed(frames, fps).where("_lost is not null").select(*KEY, "frame_index", F.col("_dt").alias("gap_s"), F.col("_lost").alias("missing"), F.col("_large").alias("significant"))


def integrity_events(frames: DataFrame) -> DataFrame:
    """Runs of missing, undecodable and invalid frames, as positions in the camera's sequence."""
    out = None
    for outcome in ("missing", "decode_failure", "invalid"):
        found = runs(frames, KEY, "frame_index", F.col("outcome") == outcome).withColumn("kind", F.lit(outcome))
        out = found if out is None else out.unionByName(found)
    return out


def camera_quality(frames: DataFrame, fps: float) -> DataFrame:
    """Counts, coverage, pixel, frozen and timing figures of each camera, and its flags.

    A frozen run is counted in frames after the one that they repeat and timed from that
    one; a frame without a time has that of its index. A camera whose times are not all
    there and increasing has no drop fraction. Null measures leave their figure null. Where
    frames have ``height`` and ``width``, changes between decoded ones are counted.
    """
    w = Window.partitionBy(*KEY).orderBy("frame_index")
    starts = F.when(_decoded() & ~F.coalesce("frozen", F.lit(False)), 1).otherwise(0)
    at = F.coalesce("timestamp", F.col("frame_index") / fps)
    x = _timed(frames, fps).withColumns({"_run": F.sum(starts).over(w), "_at": F.when(_decoded(), at)})
    over = F.col("highlight_fraction") > CLIPPED_PIXELS
    under = (F.col("shadow_fraction") > CLIPPED_PIXELS) | (F.col("brightness") < DARK)
    mean_of = lambda c: F.avg(F.when(_decoded(), c.cast("double")))
    sized = {"height", "width"} <= set(frames.columns)
    if sized:
        size = F.when(_decoded() & F.col("height").isNotNull() & F.col("width").isNotNull(), F.struct("height", "width"))
        x = x.withColumn("_size", size)
        x = x.withColumn("_resized", F.col("_size") != F.last("_size", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    per_run = Window.partitionBy(*KEY, "_run")
    x = x.withColumns({
        "_frozen_n": F.count_if(_decoded() & F.col("frozen")).over(per_run),
        "_frozen_s": F.max(F.when(F.col("frozen"), F.col("_at"))).over(per_run) - F.min("_at").over(per_run),
    })
    per = x.groupBy(*KEY).agg(
        F.count("*").alias("expected_frames"),
        *(_count(F.col("outcome") == o).alias(o) for o in OUTCOMES),
        F.avg(F.when(_decoded(), F.col("sharpness"))).alias("mean_sharpness"), F.min(F.when(_decoded(), F.col("sharpness"))).alias("min_sharpness"),
        mean_of(F.col("sharpness") < BLURRY).alias("blurry_fraction"), mean_of(over).alias("overexposed_fraction"), mean_of(under).alias("underexposed_fraction"),
        F.avg(F.when(_decoded(), F.col("brightness"))).alias("mean_luma"), F.avg(F.when(_decoded(), F.col("colourfulness"))).alias("mean_colourfulness"),
        mean_of(F.col("frozen")).alias("frozen_fraction"), F.max("_frozen_n").alias("longest_frozen_run"),
        F.when(F.count("_at") > 0, F.coalesce(F.max("_frozen_s"), F.lit(0.0))).alias("max_frozen_s"),
        F.count("_lost").alias("timestamp_gaps"), F.max(F.when(F.col("_lost").isNotNull(), F.col("_dt"))).alias("max_gap_s"),
        F.when(F.count("_dt") > 0, F.coalesce(F.sum("_lost"), F.lit(0))).alias("dropped_frames"),
        (1 / F.avg("_dt")).alias("effective_fps"), (F.stddev_pop("_dt") / F.avg("_dt")).alias("jitter_ratio"),
        F.count("_dt").alias("_n"), F.count("timestamp").alias("_stored"), F.bool_or("_large").alias("_large"), *([F.count_if("_resized").alias("resolution_changes")] if sized else []),
    )
    return judged(per)


def judged(per: DataFrame) -> DataFrame:
    """Shares and flags from a camera's totals."""
    present = F.col("expected_frames") - F.col("missing")
    complete = (F.col("_stored") == F.col("expected_frames")) & (F.col("expected_frames") > 1) & (F.col("_n") == F.col("expected_frames") - 1)
    per = per.withColumns({
        "missing_fraction": F.col("missing") / F.col("expected_frames"),
        "decode_coverage": F.when(present > 0, F.col("decoded") / present),
        "drop_fraction": F.when(complete, F.col("dropped_frames") / (F.col("_n") + F.col("dropped_frames"))),
        "invalid_timestamps": F.when(F.col("_stored") > 0, F.col("expected_frames") - 1 - F.col("_n")).otherwise(0),
    })
    frozen = F.when(F.col("max_frozen_s").isNotNull(), F.col("max_frozen_s") >= FROZEN_SECONDS).otherwise(F.col("longest_frozen_run") > FROZEN_RUN)
    flags = [
        ("video_camera_missing", F.col("missing") > 0), ("video_decode_failure", F.col("decode_failure") > 0), ("video_invalid_pixels", F.col("invalid") > 0),
        ("blurry", F.col("blurry_fraction") > BLURRY_FRAMES), ("over_exposed", F.col("overexposed_fraction") > EXPOSURE_FRAMES), ("under_exposed", F.col("underexposed_fraction") > EXPOSURE_FRAMES),
        ("frozen_frames", F.col("frozen_fraction").isNotNull() & (frozen | (F.col("frozen_fraction") > FROZEN_FRAMES))),
        ("video_invalid_timestamps", F.col("invalid_timestamps") > 0), ("video_frame_drops", F.col("_large") | (F.col("drop_fraction") > DROP_FRACTION)),
    ]
    if "resolution_changes" in per.columns:
        flags.append(("video_resolution_change", F.col("resolution_changes") > 0))
    raised = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags)))
    return per.withColumn("flags", raised).drop("_n", "_stored", "_large")


def episode_rollup(cameras: DataFrame) -> DataFrame:
    """Worst camera of each episode: least sharpness, largest defect fractions, all flags.

    A column ``mean_motion`` may come with the cameras; "no_motion" is raised only where
    every camera has it and the most active one is below the bound.
    """
    moved = F.col("mean_motion") if "mean_motion" in cameras.columns else F.lit(None).cast("double")
    per = cameras.groupBy("episode_id").agg(
        F.count("*").alias("cameras"), F.min("min_sharpness").alias("min_sharpness"), F.avg("mean_sharpness").alias("mean_sharpness"),
        *(F.max(c).alias(c) for c in ("blurry_fraction", "overexposed_fraction", "underexposed_fraction", "frozen_fraction")),
        F.max("longest_frozen_run").alias("max_frozen_run"), F.avg("mean_colourfulness").alias("mean_colourfulness"), F.max(moved).alias("mean_motion"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"), F.count(moved).alias("_moved"),
    )
    still = (F.col("_moved") == F.col("cameras")) & (F.col("mean_motion") < NO_MOTION)
    return per.withColumn("flags", F.when(still, F.array_append("flags", F.lit("no_motion"))).otherwise(F.col("flags"))).drop("_moved")
