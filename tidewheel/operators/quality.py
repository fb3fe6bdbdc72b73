"""Episode quality: one row of metrics per episode, and the composite score.

Frames are rows ``episode_id, frame_index, timestamp, action, state`` with arrays of
doubles. Metrics that a window or a higher-order function can say are plain columns;
spectra, nearest neighbours and change points run per episode on Arrow batches
(``kernels``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators import stretches
from tidewheel.operators.temporal import runs
from tidewheel.session import materialize

#: Thresholds that results must agree on.
DEAD_EPS = 1e-6
CHATTER_RATE = 2.0
JITTER_LIMIT = 0.1
SATURATION_MARGIN = 0.05
DEAD_LIMIT, JERKY_LIMIT, SATURATION_LIMIT, STATIC_LIMIT, ENTROPY_LOW, ENTROPY_HIGH = 0.10, -25.0, 0.30, 0.50, 0.20, 0.95
PSD_HIGH_LIMIT = 0.20
MIN_FRAMES = 5
SIGNALS = ("actions", "states", "timestamps")
#: Weight of each part of the score.
WEIGHTS = {"dead": 0.15, "smooth": 0.25, "gripper": 0.15, "timestamp": 0.10, "saturation": 0.10, "static": 0.15, "diversity": 0.10}


def by_episode(key: str = "episode_id", order: str = "frame_index"):
    return Window.partitionBy(key).orderBy(order)


def _difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def dead_flag(action: str = "action", key: str = "episode_id", order: str = "frame_index") -> Column:
    """A frame is dead if its action is zero, or that of a neighbour, in all dimensions."""
    w, a = by_episode(key, order), F.col(action)
    small = lambda x: F.forall(x, lambda v: F.abs(v) <= DEAD_EPS)
    zero = F.forall(a, lambda v: F.abs(v) < DEAD_EPS)
    like = lambda b: F.coalesce(small(_difference(a, b)), F.lit(False))
    return zero | like(F.lag(action).over(w)) | like(F.lead(action).over(w))


def _dead_totals() -> list[Column]:
    return [F.avg(F.col("_dead").cast("double")).alias("dead_fraction"), F.count_if("_dead").alias("n_dead")]


def dead_actions(frames: DataFrame, action: str = "action") -> DataFrame:
    return frames.withColumn("_dead", dead_flag(action)).groupBy("episode_id").agg(*_dead_totals())


def dead_runs(frames: DataFrame, action: str = "action") -> DataFrame:
    return runs(frames.withColumn("_dead", dead_flag(action)), ["episode_id"], "frame_index", F.col("_dead"))


def _path_total(step: str) -> Column:
    return F.coalesce(F.sum(step), F.lit(0.0)).alias("joint_path_length")


def path_length(frames: DataFrame, state: str = "state") -> DataFrame:
    step = norm(_difference(F.col(state), F.lag(state).over(by_episode())))
    return frames.select("episode_id", step.alias("_s")).groupBy("episode_id").agg(_path_total("_s"))


def _with_turns(frames: DataFrame, channel: Column) -> DataFrame:
    """Adds ``_turn``: the channel crosses its mid-range here."""
    whole = Window.partitionBy("episode_id")
    x = frames.withColumn("_g", channel).withColumns({"_lo": F.min("_g").over(whole), "_hi": F.max("_g").over(whole)})
    x = x.withColumn("_on", F.col("_g") > (F.col("_lo") + F.col("_hi")) / 2)
    return x.withColumn("_turn", (F.col("_on") != F.lag("_on").over(by_episode())) & (F.col("_hi") - F.col("_lo") >= 1e-6))


def _turn_totals(duration: Column | None = None) -> list[Column]:
    span = duration if duration is not None else F.max("timestamp") - F.min("timestamp")
    return [F.count_if("_turn").alias("n_transitions"), span.alias("_span")]


def _turn_rate(totals: DataFrame) -> DataFrame:
    rate = F.col("n_transitions") / F.greatest(F.col("_span"), F.lit(1e-6))
    return totals.withColumns({"gripper_chatter_rate": rate, "chattery": rate > CHATTER_RATE}).drop("_span")


def gripper_chatter(frames: DataFrame, channel: Column, duration: Column | None = None) -> DataFrame:
    """Crossings of the mid-range per second; none where the range is under 1e-6."""
    return _turn_rate(_with_turns(frames, channel).groupBy("episode_id").agg(*_turn_totals(duration)))


def _time_totals(dt: str, fps: float) -> list[Column]:
    return [F.avg(dt).alias("dt_mean"), F.coalesce(F.stddev_pop(dt), F.lit(0.0)).alias("dt_std"), F.count_if(F.col(dt) > 2.0 / fps).alias("n_gaps")]


def _time_ratios(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {"jitter_ratio": F.col("dt_std") / F.greatest("dt_mean", F.lit(1e-10)), "effective_fps": F.when(F.col("dt_mean") > 0, 1.0 / F.col("dt_mean")).otherwise(F.lit(0.0))}
    )


def timestamp_regularity(frames: DataFrame, fps: float) -> DataFrame:
    dt = F.col("timestamp") - F.lag("timestamp").over(by_episode())
    return _time_ratios(frames.select("episode_id", dt.alias("_dt")).groupBy("episode_id").agg(*_time_totals("_dt", fps)))


def _limits(limits) -> tuple[Column, Column]:
    """Lower and upper limit of each dimension: one pair for all, or a pair for each."""
    if isinstance(limits[0], (int, float)):
        return F.lit(float(limits[0])), F.lit(float(limits[1]))
    at = [F.element_at(F.array(*(F.lit(float(pair[k])) for pair in limits)), F.col("dim") + 1) for k in (0, 1)]
    return at[0], at[1]


def _dimensions(frames: DataFrame, action: str, limits=None, spread: bool = False) -> DataFrame:
    """``episode_id, dim, f, r, h``: share of frames at an edge, range, entropy of the bins.

    The arrays are shuffled by episode and opened afterwards, so the windows and
    aggregates by dimension and bin all read that one shuffle. With ``spread`` they stay
    where they are, and ranges are aggregated and joined, so that a long episode has many tasks.
    """
    w, c = Window.partitionBy("episode_id", "dim"), F.col
    if spread:
        x = frames.select("episode_id", F.posexplode(action).alias("dim", "x"))
        x = x.join(x.groupBy("episode_id", "dim").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.count("*").alias("_n")), ["episode_id", "dim"])
    else:
        x = frames.select("episode_id", action).repartition("episode_id").select("episode_id", F.posexplode(action).alias("dim", "x"))
        x = x.withColumns({"_lo": F.min("x").over(w), "_hi": F.max("x").over(w), "_n": F.count("*").over(w)})
    x = x.withColumn("_bins", F.greatest(F.ceil(F.log2(c("_n").cast("double")) + 1), F.lit(2)).cast("double"))
    width = c("_hi") - c("_lo")
    place = F.when(width < 1e-10, 0).otherwise(F.least(F.floor(F.try_divide((c("x") - c("_lo")) * c("_bins"), width)), c("_bins").cast("long") - 1))
    lo, hi = _limits(limits) if limits is not None else (c("_lo"), c("_hi"))
    margin = (hi - lo) * SATURATION_MARGIN
    at_edge = (c("x") <= lo + margin) | (c("x") >= hi - margin)
    bins = x.withColumns({"_b": place, "_edge": at_edge.cast("long"), "_r": hi - lo}).groupBy("episode_id", "dim", "_b").agg(
        F.count("*").alias("_c"), F.sum("_edge").alias("_e"), F.count("_edge").alias("_k"), F.max("_r").alias("_r"), F.max("_bins").alias("_bins"), F.max("_n").alias("_n")
    )
    p = c("_c") / c("_n")
    return bins.groupBy("episode_id", "dim").agg(
        F.try_divide(F.sum("_e").cast("double"), F.sum("_k").cast("double")).alias("f"), F.max("_r").alias("r"), (F.sum(-p * F.log2(p)) / F.max(F.log2("_bins"))).alias("h")
    )


def _saturation_totals(limits) -> list[Column]:
    """The edge share counts as saturation only against limits that were given."""
    moves = F.col("r") > 1e-10
    mean, n = F.coalesce(F.avg(F.when(moves, F.col("f"))), F.lit(0.0)), F.count_if(moves & (F.col("f") > 0.05))
    none = F.lit(None).cast("double")
    if limits is None:
        return [none.alias("overall_saturation"), F.lit(None).cast("long").alias("n_saturated_dims"), mean.alias("observed_range_edge_fraction")]
    return [mean.alias("overall_saturation"), n.alias("n_saturated_dims"), none.alias("observed_range_edge_fraction")]


def _entropy_total() -> Column:
    return F.avg("h").alias("mean_entropy")


def action_saturation(frames: DataFrame, action: str = "action", limits=None) -> DataFrame:
    """Mean over dimensions of the share of frames within 5 % of either limit.

    ``limits`` is a pair for all dimensions or one for each. Without limits nothing is known
    of saturation: it is null, and the share at the edges of the observed range, which
    describes only, is ``observed_range_edge_fraction``.
    """
    return _dimensions(frames, action, limits).groupBy("episode_id").agg(*_saturation_totals(limits))


def action_entropy(frames: DataFrame, action: str = "action") -> DataFrame:
    """Normalised Shannon entropy of equal-width bins (Sturges' number), mean over dimensions."""
    return _dimensions(frames, action).groupBy("episode_id").agg(_entropy_total())


def _gradient(column: str, spacing: float) -> Column:
    """Central differences of arrays inside, one-sided at the ends; frames without the array are passed over."""
    over = "IGNORE NULLS OVER (PARTITION BY episode_id ORDER BY frame_index)"
    x, a, b = F.col(column), F.expr(f"lag({column}) {over}"), F.expr(f"lead({column}) {over}")
    steps = F.when(a.isNull() & b.isNull(), None).when(a.isNull() | b.isNull(), 1.0).otherwise(2.0) * spacing
    step = F.transform(_difference(F.coalesce(b, x), F.coalesce(a, x)), lambda d: d / steps)
    return F.when(x.isNotNull(), step)


def _with_motion(frames: DataFrame, fps: float, state: str = "state") -> DataFrame:
    """Adds speed ``_speed`` and squared jerk ``_jerk`` of each frame; windows of one order, so one shuffle and sort."""
    x = frames.withColumn("_x", F.when(F.size(state) > 0, F.col(state)))
    for now, new in (("_x", "_v"), ("_v", "_a"), ("_a", "_j")):
        x = x.withColumn(new, _gradient(now, 1.0 / fps))
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    return x.withColumns({"_speed": norm(F.col("_v")), "_jerk": squares("_j"), "_seen": F.col("_x").isNotNull()}).drop("_x", "_v", "_a", "_j")


def _motion_totals(fps: float) -> Column:
    n, peak = F.count_if("_seen"), F.max("_speed")
    span = (n - 1) / fps
    value = -F.log(F.greatest(F.try_divide(span * span * span, peak * peak) * F.sum("_jerk") / fps, F.lit(1e-10)))
    return F.when((n >= 4) & (peak >= 1e-10), value).alias("ldlj")


def ldlj(frames: DataFrame, fps: float, state: str = "state") -> DataFrame:
    """Log dimensionless jerk; null under four frames or without motion."""
    return _with_motion(frames, fps, state).groupBy("episode_id").agg(_motion_totals(fps))


def composite_score(metrics: DataFrame) -> DataFrame:
    """Score of 0 to 10 from the parts that are there, and the flags raised.

    Reads ``dead_fraction, ldlj, gripper_chatter_rate, jitter_ratio, overall_saturation,
    static_fraction, mean_entropy``; each may be null. Without any part the score is null.
    """
    c = F.col
    parts = {
        "dead": 1.0 - c("dead_fraction"),
        "smooth": 1.0 / (1.0 + F.exp(-(c("ldlj") + 18.0) / 4.0)),
        "gripper": F.when(c("gripper_chatter_rate") > CHATTER_RATE, F.greatest(F.lit(0.0), 1.0 - c("gripper_chatter_rate") / 5.0)).when(c("gripper_chatter_rate").isNotNull(), 1.0),
        "timestamp": F.when(c("jitter_ratio") < JITTER_LIMIT, 1.0).when(c("jitter_ratio").isNotNull(), F.greatest(F.lit(0.0), 1.0 - c("jitter_ratio"))),
        "saturation": 1.0 - c("overall_saturation"),
        "static": 1.0 - c("static_fraction"),
        "diversity": F.when(c("mean_entropy").isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.abs(c("mean_entropy") - 0.7) / 0.3)),
    }
    total = sum(F.coalesce(p * WEIGHTS[k], F.lit(0.0)) for k, p in parts.items())
    weight = sum(F.when(p.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, p in parts.items())
    flags = {
        "dead_actions": c("dead_fraction") > DEAD_LIMIT,
        "jerky": c("ldlj") < JERKY_LIMIT,
        "gripper_chatter": c("gripper_chatter_rate") > CHATTER_RATE,
        "timestamp_jitter": c("jitter_ratio") > JITTER_LIMIT,
        "saturated": c("overall_saturation") > SATURATION_LIMIT,
        "mostly_static": c("static_fraction") > STATIC_LIMIT,
        "low_entropy": c("mean_entropy") < ENTROPY_LOW,
        "high_entropy": c("mean_entropy") > ENTROPY_HIGH,
    }
    raised = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in flags.items())))
    return metrics.withColumns({"overall_score": F.try_divide(total * 10.0, weight), "flags": raised})


def _marked(frames: DataFrame) -> DataFrame:
    """Frames with ``_bad_*`` and ``_has_*`` by signal."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    arrays = {"actions": F.col("action"), "states": F.col("state")}
    x = frames.withColumns({f"_has_{k}": F.coalesce(F.size(v) > 0, F.lit(False)) for k, v in arrays.items()} | {"_has_timestamps": F.col("timestamp").isNotNull()})
    return x.withColumns({f"_bad_{k}": F.coalesce(F.exists(v, odd), F.lit(False)) for k, v in arrays.items()} | {"_bad_timestamps": F.coalesce(odd(F.col("timestamp")), F.lit(False))})


def _checked(frames: DataFrame, fps: float) -> DataFrame:
    """``_marked`` frames; where an episode has no time at all, its own of ``fps``."""
    w, x = by_episode(), _marked(frames)
    timed = F.count("timestamp").over(Window.partitionBy("episode_id"))
    return x.withColumn("timestamp", F.when(timed == 0, (F.row_number().over(w) - 1) / F.lit(float(fps))).otherwise(F.col("timestamp").cast("double")))


def _stretched(frames: DataFrame, fps: float, grippers: list[Column], rows: int) -> DataFrame:
    """``_checked`` frames by stretch, with the range of each gripper channel over its whole episode."""
    x = _marked(frames).withColumns({f"_g{k}": g for k, g in enumerate(grippers)})
    ranges = [f(f"_g{k}").alias(f"_{n}{k}") for k in range(len(grippers)) for n, f in (("lo", F.min), ("hi", F.max))]
    whole = x.groupBy(F.col("episode_id").alias("_id")).agg(F.count("timestamp").alias("_timed"), *ranges)
    x = stretches.place(x, rows)
    x = x.join(whole, x["episode_id"].eqNullSafe(whole["_id"])).drop("_id")
    x = x.withColumn("timestamp", F.when(F.col("_timed") == 0, F.col("_pos") / F.lit(float(fps))).otherwise(F.col("timestamp").cast("double"))).drop("_timed")
    return materialize(stretches.halo(x, 3, 3), "stretches")


def _check_totals() -> list[Column]:
    n = F.count("*")
    bad = [((F.count_if(f"_has_{k}") > 0) & ((F.count_if(f"_has_{k}") < n) | F.bool_or(f"_bad_{k}"))).alias(f"nan_in_{k}") for k in SIGNALS]
    return [n.alias("num_frames"), *(F.bool_or(f"_has_{k}").alias(f"_any_{k}") for k in SIGNALS), *bad, F.coalesce(F.bool_or(F.col("dt") <= 0), F.lit(False)).alias("_not_rising")]


def episode_metrics(
    frames: DataFrame,
    fps: float,
    gripper: Column | list[Column] | None = None,
    limits=None,
    dims: Sequence[int] | None = None,
    scales: Sequence[float] | None = None,
    spectra: bool = False,
    tracking_pairs: Sequence[tuple[int, int]] = (),
    tracking_lag_s: float = 0.0,
    stretch_rows: int | None = None,
) -> DataFrame:
    """All metrics of each episode beside its score, or the reason why it has none.

    An episode abstains, with null metrics, where a number is missing or not finite
    (flags ``nan_in_actions, nan_in_states, nan_in_timestamps``), where it has under
    ``MIN_FRAMES`` frames (no flag), and where its times do not increase
    (``invalid_timestamps``). Where times have gaps or jitter above the limit, what needs a
    steady rate (``ldlj``, spectra) and the score are null; ``timestamp_gaps``,
    ``sample_rate_mismatch`` and ``timestamp_jitter`` say so. A stored state without
    measurable motion gives no score either. An episode without any time gets that of
    ``fps``. ``status`` says how the score came about.

    ``gripper``: the channels, if any. ``limits``: of the commands; without them there is no
    saturation. ``dims`` and ``scales``: of the state. ``spectra``: also ``sparc``, the
    shares of power by band, the variance of actions in like states and the flag
    ``psd_high_band_chatter``, and the ``content_hash``, by a pass on Arrow batches. ``tracking_pairs``: see
    ``diagnostics.tracking``.

    Two reads, each shuffled once by episode: what needs the frames' order (windows of
    one order, so one sort), and what needs each action dimension's range. Their results,
    a row per episode, are joined as they lie.

    ``stretch_rows``: episodes of more frames are cut into stretches with a halo of three
    frames, so that none is a single task (see ``stretches``). Spectra and tracking hold
    an episode at a time and can't be asked for together with it.
    """
    from tidewheel.operators import diagnostics, kernels

    c = F.col
    grippers = [] if gripper is None else list(gripper) if isinstance(gripper, (list, tuple)) else [gripper]
    if stretch_rows and (spectra or tracking_pairs):
        raise ValueError("spectra and tracking hold an episode at a time")
    checked = _stretched(frames, fps, grippers, stretch_rows) if stretch_rows else _checked(frames, fps)
    x = diagnostics.transitions(checked, fps, dims, scales).withColumn("_dead", dead_flag()).withColumn("_at", diagnostics.scaled(c("state"), dims, scales))
    carry = None
    if stretch_rows:
        before = stretches.carried(x, F.when(~c("slow"), c("timestamp"))).withColumnRenamed("episode_id", "_stretch")
        x, carry = x.join(before, x["episode_id"] == before["_stretch"]).drop("_stretch"), c("_carry")
    x = _with_motion(x.withColumn("_pause", diagnostics.run_seconds("slow", 0.5, carry=carry)), fps, "_at")
    totals = [*_check_totals(), *_dead_totals(), _motion_totals(fps), *_time_totals("dt", fps), diagnostics.static_share(), F.coalesce(F.sum(F.when(c("valid"), c("step"))), F.lit(0.0)).alias("joint_path_length")]
    for k, channel in enumerate(grippers):
        if stretch_rows:
            x = x.withColumn("_on", c(f"_g{k}") > (c(f"_lo{k}") + c(f"_hi{k}")) / 2)
            x = x.withColumn(f"_turn{k}", (c("_on") != F.lag("_on").over(by_episode())) & (c(f"_hi{k}") - c(f"_lo{k}") >= 1e-6)).drop("_on")
        else:
            x = _with_turns(x, channel).withColumnRenamed("_turn", f"_turn{k}").drop("_g", "_lo", "_hi", "_on")
        totals.append(F.count_if(f"_turn{k}").alias(f"_turns{k}"))
    if stretch_rows:
        x = x.where("_own").withColumn("episode_id", c("episode_id.id"))
    out = _time_ratios(x.groupBy("episode_id").agg(*totals, (F.max("timestamp") - F.min("timestamp")).alias("_span")))
    turns = [c(f"_turns{k}") for k in range(len(grippers))]
    most = F.greatest(*turns) if len(turns) > 1 else turns[0] if turns else F.lit(None).cast("long")
    out = out.withColumns({"n_transitions": sum(turns[1:], turns[0]) if turns else F.lit(None).cast("long"), "gripper_chatter_rate": most / F.greatest("_span", F.lit(1e-6))})
    by_dim = _dimensions(frames, "action", limits, bool(stretch_rows)).groupBy("episode_id").agg(*_saturation_totals(limits), _entropy_total())
    out = out.join(by_dim, "episode_id", "left")
    if spectra:
        # joined by episode; the kernels hold one episode at a time
        out = out.join(kernels.episode_kernels(_checked(frames, fps).select(frames.columns), fps).drop("n_frames"), "episode_id", "left")
    if tracking_pairs:
        follow, stalls = diagnostics.tracking(frames, fps, tracking_pairs, tracking_lag_s, scales)
        out = out.join(follow, "episode_id", "left").join(stalls.groupBy("episode_id").agg(F.count("*").alias("n_stalls")), "episode_id", "left")
    return _judged(out, fps)


def _judged(out: DataFrame, fps: float) -> DataFrame:
    """Nulls what the episode's data cannot support, then scores the rest."""
    c = F.col
    odd = [f"nan_in_{k}" for k in SIGNALS]
    broken = c(odd[0]) | c(odd[1]) | c(odd[2])
    short = c("num_frames") < MIN_FRAMES
    usable = ~broken & ~short & ~c("_not_rising")
    stored = c("_any_timestamps")
    regular = ~stored | ((c("n_gaps") == 0) & (c("jitter_ratio") <= JITTER_LIMIT))
    of_time, of_action = ("dt_mean", "dt_std", "n_gaps", "jitter_ratio", "effective_fps"), ("dead_fraction", "n_dead", "n_transitions", "gripper_chatter_rate", "overall_saturation", "n_saturated_dims", "observed_range_edge_fraction", "mean_entropy")
    steady = [n for n in ("ldlj", "sparc", "psd_low", "psd_mid", "psd_high") if n in out.columns]
    others = [n for n in ("static_fraction", "joint_path_length", "neighbour_variance", "tracking_mean", "tracking_p95", "stall_fraction", "n_stalls") if n in out.columns]
    keep = {n: F.when(usable & stored, c(n)) for n in of_time} | {n: F.when(usable & c("_any_actions"), c(n)) for n in of_action} | {n: F.when(usable & regular, c(n)) for n in steady} | {n: F.when(usable, c(n)) for n in others}
    keep["joint_path_length"] = F.when(usable & c("_any_states"), c("joint_path_length"))
    marks = {n: c(n) for n in odd} | {"invalid_timestamps": ~broken & ~short & c("_not_rising")}
    marks |= {"timestamp_gaps": usable & stored & (c("n_gaps") > 0), "sample_rate_mismatch": usable & stored & (F.abs(c("effective_fps") / fps - 1) > JITTER_LIMIT)}
    if "psd_high" in out.columns:
        marks["psd_high_band_chatter"] = usable & regular & (c("psd_high") > PSD_HIGH_LIMIT)
    raised = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in marks.items())))
    why = F.when(broken, "invalid input").when(short, "too few frames").when(c("_not_rising"), "times do not increase").when(~regular, "irregular times")
    out = out.withColumns({"_marks": raised, "_why": why, "_states": c("_any_states")} | keep)
    out = composite_score(out)
    flags = F.concat("_marks", "flags")
    if "n_stalls" in out.columns:
        flags = F.when(c("n_stalls") > 0, F.concat(flags, F.array(F.lit("tracking_stall_candidate")))).otherwise(flags)
    why = F.coalesce("_why", F.when(c("overall_score").isNull() | (c("_states") & c("ldlj").isNull()), "no motion to judge"))
    out = out.withColumns({"flags": flags, "status": F.coalesce(why, F.lit("scored")), "overall_score": F.when(why.isNull(), c("overall_score")), "chattery": c("gripper_chatter_rate") > CHATTER_RATE})
    return out.drop(*(n for n in out.columns if n.startswith("_")), *(f"nan_in_{k}" for k in SIGNALS))


def dataset_report(scored: DataFrame) -> DataFrame:
    """Mean of the scores there are, and for each flag how many episodes raise it."""
    flags = scored.select("episode_id", F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n_episodes"))
    return flags.crossJoin(scored.agg(F.avg("overall_score").alias("mean_score"), F.count("overall_score").alias("n_scored")))
