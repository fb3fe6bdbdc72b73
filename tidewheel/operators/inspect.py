"""What a dataset's numbers say about itself: rate, gripper, kind of action, parts of the state, success."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators.quality import by_episode

#: Rates that an estimate within two of them is taken for.
COMMON_FPS = (10, 15, 20, 24, 25, 30, 50, 60)
#: Words in camera names, the first kind that has one counts.
CAMERA_WORDS = {"wrist": ("wrist", "hand", "gripper"), "overhead": ("overhead", "top", "bird"), "front": ("front", "forward"), "side": ("side", "lateral"), "depth": ("depth",)}


def first_episodes(frames: DataFrame, episodes: int, per_episode: int | None = None) -> DataFrame:
    """Frames of the first ``episodes`` episodes by id, of each the first ``per_episode`` frames if given."""
    chosen = frames.select("episode_id").distinct().orderBy("episode_id").limit(episodes)
    x = frames.join(F.broadcast(chosen), "episode_id", "left_semi")  # ``episodes`` rows
    return x if per_episode is None else x.withColumn("_n", F.row_number().over(by_episode())).where(F.col("_n") <= per_episode).drop("_n")


def every(frames: DataFrame, key: list[str], n: int, order: list[str]) -> DataFrame:
    """``n`` evenly spaced rows of each key, the first and last among them; all if there are no more."""
    w = Window.partitionBy(*key)
    x = frames.withColumns({"_n": F.row_number().over(w.orderBy(*order)) - 1, "_all": F.count("*").over(w)})
    at = lambda k: F.floor(k * (F.col("_all") - 1) / F.lit(max(n - 1, 1)))
    # the k-th place is floor(k * (all - 1) / (n - 1)); a row is one of them if some k falls on it
    k = F.ceil(F.col("_n") * F.lit(max(n - 1, 1)) / F.greatest(F.col("_all") - 1, F.lit(1)))
    return x.where((F.col("_all") <= n) | ((at(k) == F.col("_n")) & (k < n))).drop("_n", "_all")


def frame_rate(frames: DataFrame) -> DataFrame:
    """``episode_id, fps`` from the stored times, null where they do not tell.

    The mean of the steps within a half and twice the median, if two or more are;
    a rate within two of a common one is taken for it.
    """
    dt = F.col("timestamp") - F.lag("timestamp").over(by_episode())
    x = frames.where("timestamp is not null").select("episode_id", dt.alias("dt")).where("dt is not null")
    x = x.withColumn("mid", F.median("dt").over(Window.partitionBy("episode_id")))
    near = (F.col("dt") > F.col("mid") * 0.5) & (F.col("dt") < F.col("mid") * 2)
    per = x.groupBy("episode_id").agg(F.max("mid").alias("mid"), F.when(F.count_if(near) >= 2, F.avg(F.when(near, F.col("dt")))).otherwise(F.avg("dt")).alias("step"))
    rate = F.try_divide(F.lit(1.0), F.col("step"))
    known = F.coalesce(*(F.when(F.abs(rate - c) < 2, F.lit(float(c))) for c in COMMON_FPS), F.round(rate, 1))
    return per.select("episode_id", F.when((F.col("mid") > 0) & (F.col("step") > 0), known).alias("fps"))


@dataclass
class Signals:
    """What a sample of frames shows; None or an empty dictionary where it does not tell."""

    gripper: int | None = None
    action_type: str = "unknown"
    parts: dict[str, tuple[int, int]] = field(default_factory=dict)


# The numbers in the three functions below are fixed values: what a gripper, a part of the state and a kind of action are told by.


def _gripper(dims: list) -> int | None:
    """The last dimension if it stays within 0 to 1 beside wider ones, else the first that jumps between still stretches."""
    if len(dims) < 2 or dims[0]["n"] < 10:
        return None
    bounded = [d["lo"] >= -0.1 and d["hi"] <= 1.1 for d in dims]
    others = max(d["hi"] for d in dims[:-1]) - min(d["lo"] for d in dims[:-1])
    if bounded[-1] and (others > 1.0 or dims[-1]["hi"] - dims[-1]["lo"] < others * 0.5):
        return len(dims) - 1
    return next((k for k, d in enumerate(dims) if bounded[k] and (d["jump"] or 0) > 0.3 and (d["moves"] or 0) < 0.1), None)


def _parts(width: int, gripper: int | None) -> dict[str, tuple[int, int]]:
    out = {} if gripper is None else {"gripper": (gripper, gripper + 1)}
    end = width if gripper is None else gripper
    if end in (7, 8):
        out["joint_positions"] = (0, end - 1)
    elif end >= 12:
        out |= {"joint_positions": (0, end // 2), "joint_velocities": (end // 2, end)}
    return out


def signals(frames: DataFrame) -> Signals:
    """Gripper, kind of action and parts of the state, from a sample (``first_episodes``).

    The driver gets a row for each dimension of the state and one of the actions.
    """
    w = Window.partitionBy("dim").orderBy("episode_id", "frame_index")
    x = frames.where("state is not null").select("episode_id", "frame_index", F.posexplode("state").alias("dim", "x")).withColumn("d", F.abs(F.col("x") - F.lag("x").over(w)))
    dims = x.groupBy("dim").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("d").alias("jump"), F.avg("d").alias("moves")).orderBy("dim").collect()
    a = frames.where("action is not null").select("episode_id", "frame_index", F.explode("action").alias("x"))
    act = a.agg(F.count_distinct("episode_id", "frame_index").alias("n"), F.avg(F.abs("x")).alias("size"), F.stddev_pop("x").alias("std"), (F.max("x") - F.min("x")).alias("range"), F.median("x").alias("mid")).first()
    kind = "unknown"
    if act["n"] >= 5:
        span = max(d["hi"] for d in dims) - min(d["lo"] for d in dims) if dims else None
        if act["size"] < 0.1 and act["std"] < 0.1:
            kind = "delta"
        elif span is not None and 0.3 < act["range"] / max(span, 0.001) < 3.0:
            kind = "absolute"
        elif span is not None and act["range"] < span * 0.3:
            kind = "delta"
        elif abs(act["mid"]) < act["std"] * 0.5:
            kind = "velocity"
    gripper = _gripper(dims)
    return Signals(gripper, kind, _parts(len(dims), gripper) if dims and dims[0]["n"] >= 10 else {})


def camera_type(name: str, channels: int = 3) -> str:
    found = next((kind for kind, words in CAMERA_WORDS.items() if any(w in name.lower() for w in words)), None)
    return found or ("depth" if channels == 1 else "rgb")


def success(frames: DataFrame) -> DataFrame:
    """``episode_id, success`` by the last frame's reward, else by all rewards: over 0.5, below -0.5, else null.

    ``frames`` has ``reward`` and may have ``is_last`` and ``is_terminal``.
    """
    ends = [F.col(c) for c in ("is_last", "is_terminal") if c in frames.columns]
    end = F.coalesce(F.greatest(*ends) if len(ends) > 1 else ends[0], F.lit(False)) if ends else F.lit(False)
    told = lambda r: F.when(r > 0.5, True).when(r < -0.5, False)
    last = F.max_by(F.struct("reward"), F.when(end, F.col("frame_index")))["reward"]
    return frames.groupBy("episode_id").agg(F.coalesce(told(last), told(F.sum("reward"))).alias("success"))


def gripper_source(frames: DataFrame, candidates: tuple[str, ...] = ("gripper_state", "action_gripper")) -> DataFrame:
    """``episode_id, gripper_source``: the first column of which no frame of the episode lacks a value, else null."""
    there = [c for c in candidates if c in frames.columns]
    whole = [F.when(F.count(c) == F.count("*"), F.lit(c)) for c in there]
    return frames.groupBy("episode_id").agg((F.coalesce(*whole) if whole else F.lit(None).cast("string")).alias("gripper_source"))


def collected_stats(frames: DataFrame, episodes: DataFrame, cameras: DataFrame | None = None) -> DataFrame:
    """One row on a dataset: lengths, shares of episodes with language, success and rewards, and whether widths and cameras agree.

    An episode counts for success if its success is known, for rewards if a frame has one.
    ``cameras`` has ``episode_id, name``; an episode without any has the empty set.
    """
    rewards = F.count("reward") if "reward" in frames.columns else F.lit(0)
    per = frames.groupBy("episode_id").agg(F.count("*").alias("n"), rewards.alias("r"), F.min_by(F.size("state"), "frame_index").alias("sd"), F.min_by(F.size("action"), "frame_index").alias("ad"))
    known = success(frames) if "reward" in frames.columns else frames.select("episode_id", F.lit(None).cast("boolean").alias("success")).distinct()
    x = per.join(known, "episode_id").join(episodes.select("episode_id", "language_instruction"), "episode_id", "left")
    if cameras is not None:
        x = x.join(cameras.groupBy("episode_id").agg(F.array_sort(F.collect_set("name")).alias("cams")), "episode_id", "left")
    else:
        x = x.withColumn("cams", F.array().cast("array<string>"))
    share = lambda c: F.avg(c.cast("double"))
    return x.agg(
        F.count("*").alias("n_episodes"), F.sum("n").alias("n_frames"), F.min("n").alias("min_frames"), F.max("n").alias("max_frames"), F.avg("n").alias("mean_frames"),
        share(F.trim(F.coalesce("language_instruction", F.lit(""))) != "").alias("language_coverage"), share(F.col("success").isNotNull()).alias("success_coverage"), share(F.col("r") > 0).alias("reward_coverage"),
        (F.count_distinct("sd") <= 1).alias("consistent_state"), (F.count_distinct("ad") <= 1).alias("consistent_action"), (F.count_distinct(F.coalesce("cams", F.array().cast("array<string>"))) <= 1).alias("consistent_cameras"),
    )


def report(frames: DataFrame, episodes: DataFrame, fps: float | None = None, robot: str | None = None, sample: int = 5, per_episode: int = 100) -> dict:
    """What a dataset is, from a sample of frames and its episodes, and ``missing``: what it does not say."""
    some = first_episodes(frames, sample, per_episode)
    found = signals(some)
    rates = [r["fps"] for r in frame_rate(some).orderBy("episode_id").collect() if r["fps"]]  # ``sample`` rows at most
    said = episodes.agg(F.count("*").alias("n"), F.avg((F.trim(F.coalesce("language_instruction", F.lit(""))) != "").cast("double")).alias("share"), F.min_by("language_instruction", F.when(F.trim("language_instruction") != "", F.col("episode_id"))).alias("one")).first()
    fps = fps or (rates[0] if rates else None)
    return {
        "n_episodes": said["n"], "fps": fps, "robot": robot, "gripper": found.gripper, "action_type": found.action_type, "parts": found.parts,
        "language_coverage": said["share"] or 0.0, "sample_language": said["one"], "missing": [k for k, v in (("fps", fps), ("robot_type", robot)) if not v],
    }
