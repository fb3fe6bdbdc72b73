"""Events in the robot's own signals: pauses, holds, gaps, reversals, tracking."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators import stretches
from tidewheel.operators.quality import by_episode
from tidewheel.operators.temporal import align, min_duration_events
from tidewheel.session import materialize

#: Fixed values.
SLOW = 1e-3
REPEAT_EPS = 1e-6
GAP_STEPS = 2.5


def columns_of(chosen: Iterable[int], width: int, name: str) -> list[int]:
    """Column numbers from 0; negative ones count from the end."""
    out = []
    for k in chosen:
        if isinstance(k, bool) or not isinstance(k, int) or not -width <= k < width:
            raise ValueError(f"{name}: there is no column {k} among {width}")
        out.append(k % width)
    if len(set(out)) < len(out):
        raise ValueError(f"{name}: a column comes twice")
    return out


def scaled(x: Column, dims: Sequence[int] | None = None, scales: Sequence[float] | None = None) -> Column:
    """The chosen columns of an array, each divided by its scale; ``scales`` has one for each original column."""
    if scales is not None:
        x = F.zip_with(x, F.array(*(F.lit(float(v)) for v in scales)), lambda v, c: v / c)
    return x if dims is None else F.when(x.isNotNull(), F.array(*(F.element_at(x, k + 1) if k >= 0 else F.element_at(x, k) for k in dims)))


def transitions(frames: DataFrame, fps: float, dims: Sequence[int] | None = None, scales: Sequence[float] | None = None) -> DataFrame:
    """Each frame with the step that led to it: ``dt, valid, speed, held, step, slow``."""
    w = by_episode()
    d = lambda c: F.zip_with(c, F.lag(c).over(w), lambda x, y: F.abs(x - y))
    x = frames.withColumns({"dt": F.col("timestamp") - F.lag("timestamp").over(w), "_ds": d(scaled(F.col("state"), dims, scales)), "_da": d(F.col("action"))})
    return x.withColumns(
        {
            "valid": F.coalesce((F.col("dt") > 0) & (F.col("dt") <= GAP_STEPS / fps), F.lit(False)),
            "speed": F.try_divide(F.array_max("_ds"), F.when(F.col("dt") > 0, F.col("dt"))),
            "held": F.coalesce(F.forall("_da", lambda v: v <= REPEAT_EPS), F.lit(False)),
            "step": F.sqrt(F.aggregate("_ds", F.lit(0.0), lambda s, v: s + v * v)),
        }
    ).drop("_ds", "_da").withColumn("slow", F.coalesce(F.col("valid") & (F.col("speed") <= SLOW), F.lit(False)))


def run_seconds(flag: str, min_seconds: float, w=None, carry: Column | None = None) -> Column:
    """At the last row of a run of flagged transitions, its seconds if they are enough; else null.

    Running frames of the episode's own order, so a run costs its rows once. ``carry``: where
    the rows are a stretch, the time of the last unflagged row before it; only its own rows count then.
    """
    w = w if w is not None else by_episode()
    on = F.col(flag)
    off = ~on if carry is None else ~on & F.col("_own")
    before = F.last(F.when(off, F.col("timestamp")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    long = F.col("timestamp") - (before if carry is None else F.coalesce(before, carry))
    return F.when(on & ~F.coalesce(F.lead(flag).over(w), F.lit(False)) & (long + 1e-9 >= min_seconds), long)


def seen_seconds() -> Column:
    return F.sum(F.when(F.col("valid"), F.col("dt")).otherwise(0.0))


def static_share() -> Column:
    """Reads ``_pause``, the seconds of each pause at its last row."""
    seen = seen_seconds()
    share = F.when(seen > 0, F.try_divide(F.coalesce(F.sum("_pause"), F.lit(0.0)), seen)).otherwise(0.0)
    return F.when(F.count_if(F.size("state") > 0) > 0, share).alias("static_fraction")


def static_fraction(frames: DataFrame, fps: float, min_seconds: float = 0.5) -> DataFrame:
    """Share of the observed time that lies in pauses: no dimension moves faster than ``SLOW`` for ``min_seconds``.

    Without observed time it is 0, without states null.
    """
    x = transitions(frames, fps).withColumn("_pause", run_seconds("slow", min_seconds))
    return x.groupBy("episode_id").agg(static_share())


def time_coverage(frames: DataFrame, fps: float) -> DataFrame:
    x = transitions(frames, fps)
    seen = seen_seconds()
    whole = F.max("timestamp") - F.min("timestamp")
    length = F.sum(F.when(F.col("valid"), F.col("step")).otherwise(0.0))
    out = x.groupBy("episode_id").agg(seen.alias("valid_duration_s"), F.try_divide(seen, F.when(whole > 0, whole)).alias("time_coverage"), length.alias("path_length"), F.bool_and(F.col("valid") | F.col("dt").isNull()).alias("_all"), F.min_by("state", "frame_index").alias("_a"), F.max_by("state", "frame_index").alias("_b"))
    net = F.sqrt(F.aggregate(F.zip_with("_a", "_b", lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda s, v: s + v))
    ratio = F.when(F.col("_all") & (F.col("path_length") > 0), F.least(F.lit(1.0), net / F.col("path_length")))
    return out.withColumn("net_to_path_ratio", ratio).drop("_all", "_a", "_b")


def proprio_events(frames: DataFrame, fps: float, min_seconds: float = 0.5, dims: Sequence[int] | None = None, scales: Sequence[float] | None = None, stretch_rows: int | None = None) -> DataFrame:
    """Events of all kinds, ``episode_id, kind, start, end, start_time, end_time``.

    With ``stretch_rows`` an episode of more frames is shared by several tasks.
    """
    if stretch_rows:
        x = materialize(stretches.halo(stretches.place(frames, stretch_rows), 2, 1), "stretches")
        x = transitions(x, fps, dims, scales)
    else:
        x = transitions(frames, fps, dims, scales)
    found = None
    for kind, flag, least in (
        ("timestamp_gap", F.col("dt").isNotNull() & ~F.col("valid"), 0.0),
        ("held_command", F.col("held") & F.col("valid"), min_seconds),
        ("motion_pause", F.col("slow"), min_seconds),
    ):
        one = stretches.long_runs(x, flag, min_seconds=least) if stretch_rows else min_duration_events(x, ["episode_id"], "frame_index", "timestamp", flag, least)
        one = one.withColumn("kind", F.lit(kind))
        found = one if found is None else found.unionByName(one)
    return found


def direction_reversals(frames: DataFrame, fps: float, column: str = "state", deadband: float = 1e-3, min_seconds: float = 0.1) -> DataFrame:
    """Per dimension, changes of sign between runs of motion that last ``min_seconds``.

    Steps slower than ``deadband`` have no sign; shorter runs are passed over; a gap in
    time begins anew.
    """
    key = ["episode_id", "dim"]
    w = Window.partitionBy(*key).orderBy("frame_index")
    x = frames.select("episode_id", "frame_index", "timestamp", F.posexplode(column).alias("dim", "x"))
    x = x.withColumns({"dt": F.col("timestamp") - F.lag("timestamp").over(w), "d": F.col("x") - F.lag("x").over(w)}).where("dt is not null")
    valid = (F.col("dt") > 0) & (F.col("dt") <= GAP_STEPS / fps)
    x = x.withColumn("valid", valid).withColumn("sign", F.when(F.col("valid") & (F.abs(F.col("d")) > deadband * F.col("dt")), F.signum("d").cast("int")).otherwise(0))
    x = x.withColumn("gap", F.sum((~F.col("valid")).cast("int")).over(w))
    change = F.when((F.col("sign") != F.lag("sign").over(w)) | (F.col("gap") != F.lag("gap").over(w)), 1).otherwise(0)
    x = x.withColumn("_c", change).withColumn("run", F.sum("_c").over(w))
    long_ = x.groupBy(*key, "gap", "run", "sign").agg(F.sum("dt").alias("s")).where((F.col("sign") != 0) & (F.col("s") + 1e-9 >= min_seconds))
    by_gap = Window.partitionBy(*key, "gap").orderBy("run")
    flips = long_.withColumn("flip", (F.col("sign") != F.lag("sign").over(by_gap)).cast("int"))
    return flips.groupBy(*key).agg(F.coalesce(F.sum("flip"), F.lit(0)).cast("long").alias("n_reversals"))


def tracking_error(frames: DataFrame, lag_s: float = 0.0) -> DataFrame:
    """Mean and 95th percentile of the largest difference of a state from the action commanded ``lag_s`` before."""
    want = frames.select("episode_id", (F.col("timestamp") - lag_s).alias("ts"), "state", "frame_index")
    said = frames.select("episode_id", F.col("timestamp").alias("ts"), F.col("action").alias("value"))
    held = align(want, said, ["episode_id"], "ts", "value", "hold").where("source_ts <= ts")
    error = F.array_max(F.zip_with("state", "value", lambda x, y: F.abs(x - y)))
    return held.withColumn("error", error).groupBy("episode_id").agg(F.avg("error").alias("tracking_mean"), F.percentile("error", 0.95).alias("tracking_p95"))


def _tracked(frames: DataFrame, fps: float, pairs: Sequence[tuple[int, int]], lag_s: float, scales: Sequence[float] | None) -> DataFrame:
    """Frames with ``dt, valid, residual, supported, stalled``; ``residual`` is null where no command of the same stretch is that old."""
    w = by_episode()
    actions, states = [a for a, _ in pairs], [s for _, s in pairs]
    x = transitions(frames, fps)
    x = x.withColumn("_gap", F.sum(F.when(F.col("dt").isNotNull() & ~F.col("valid"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = x.select("episode_id", (F.col("timestamp") - lag_s).alias("ts"), "timestamp", "frame_index", "dt", "valid", "_gap", scaled(F.col("state"), states, scales).alias("_s"))
    said = x.select("episode_id", F.col("timestamp").alias("ts"), F.struct(F.col("_gap").alias("g"), scaled(F.col("action"), actions).alias("a")).alias("value"))
    held = align(want, said, ["episode_id"], "ts", "value", "hold")
    part = F.array(*(F.lit(float(scales[s]) if scales is not None else 1.0) for s in states))
    error = F.array_max(F.zip_with("_s", F.zip_with("value.a", part, lambda a, c: a / c), lambda s, a: F.abs(a - s)))
    known = (F.col("source_ts") <= F.col("ts")) & (F.col("value.g") == F.col("_gap"))
    held = held.withColumn("residual", F.when(known, error))
    speed = F.try_divide(F.array_max(F.zip_with("_s", F.lag("_s").over(w), lambda a, b: F.abs(a - b))), F.col("dt"))
    both = F.col("residual").isNotNull() & F.lag("residual").over(w).isNotNull()
    return held.withColumns({"supported": F.coalesce(F.col("valid") & both, F.lit(False)), "_v": speed, "_least": F.least("residual", F.lag("residual").over(w))})


def tracking(frames: DataFrame, fps: float, pairs: Sequence[tuple[int, int]], lag_s: float = 0.0, scales: Sequence[float] | None = None, limit: float = 0.05, min_seconds: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """How states follow position commands: figures by episode, and stall events.

    ``pairs`` name an action column and the state column that it commands. A state is held
    against the last command given ``lag_s`` or more before, unless a gap in time lies
    between. A stall is a run of transitions without motion whose error is above ``limit``
    at both ends. Figures: ``tracking_mean, tracking_p95, stall_fraction`` of the
    transitions that can be judged.
    """
    x = _tracked(frames, fps, pairs, lag_s, scales)
    x = x.withColumn("stalled", F.coalesce(F.col("supported") & (F.col("_v") <= SLOW) & (F.col("_least") > limit), F.lit(False)))
    events = min_duration_events(x, ["episode_id"], "frame_index", "timestamp", F.col("stalled"), min_seconds).withColumn("kind", F.lit("tracking_stall_candidate"))
    x = x.withColumn("_long", run_seconds("stalled", min_seconds))
    judged = F.sum(F.when(F.col("supported"), F.col("dt")).otherwise(0.0))
    share = F.when(judged > 0, F.try_divide(F.coalesce(F.sum("_long"), F.lit(0.0)), judged)).alias("stall_fraction")
    figures = x.groupBy("episode_id").agg(F.avg("residual").alias("tracking_mean"), F.percentile("residual", 0.95).alias("tracking_p95"), share)
    return figures, events
