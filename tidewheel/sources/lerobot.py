"""LeRobot datasets (v2 and v3): columnar scan to frames and episodes, and a v3 writer."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators.curation import dimension_stats, pooled_stats
from tidewheel.operators.numbering import number_rows
from tidewheel.plans.catalog import Files


def info(spark: SparkSession, root: str) -> dict:
    return json.loads(Files(spark, root).read("meta/info.json"))


def _pick(columns: list[str], words: tuple[str, ...]) -> str | None:
    return next((c for c in columns if any(w in c for w in words) and "image" not in c), None)


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    """Frames of all episodes: ``episode_id, frame_index, timestamp, action, state, task_index``.

    Only the columns of the robot's own signals are read, never video. State is the first
    column named for state or observation, action the first named for action. Frame
    indices count from 0 within an episode.
    """
    files = Files(spark, root)
    folder = "data/train" if files.exists("data/train") else "data"
    raw = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(f"{root}/{folder}")
    columns = raw.columns
    state, action = _pick(columns, ("state", "observation")), _pick([c for c in columns if "token" not in c], ("action",))
    number = F.col("episode_index") if "episode_index" in columns else F.regexp_extract(F.input_file_name(), r"episode_(\d+)", 1).cast("long")
    null = F.lit(None).cast("array<double>")
    order = next((c for c in ("frame_index", "index", "timestamp") if c in columns), None)
    x = raw.select(
        number.alias("_n"),
        (F.col(order) if order else F.monotonically_increasing_id()).alias("_o"),
        (F.col("timestamp").cast("double") if "timestamp" in columns else F.lit(None).cast("double")).alias("timestamp"),
        (F.col(f"`{action}`").cast("array<double>") if action else null).alias("action"),
        (F.col(f"`{state}`").cast("array<double>") if state else null).alias("state"),
        (F.col("task_index").cast("long") if "task_index" in columns else F.lit(0).cast("long")).alias("task_index"),
    )
    w = Window.partitionBy("_n").orderBy("_o")
    return x.select(F.format_string("episode_%06d", F.col("_n").cast("long")).alias("episode_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_index"), "timestamp", "action", "state", "task_index")


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    files = Files(spark, root)
    if files.exists("meta/tasks.parquet"):
        t = spark.read.parquet(f"{root}/meta/tasks.parquet")
        name = next(c for c in t.columns if c != "task_index")
        return t.select("task_index", F.col(name).alias("task"))
    if files.exists("meta/tasks.jsonl"):
        return spark.read.schema("task_index long, task string").json(f"{root}/meta/tasks.jsonl")
    return spark.createDataFrame([], "task_index long, task string")


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """One row per episode: length, widths, and its instruction: the first task that its own record names, else that of its first frame."""
    x = read_frames(spark, root)
    fps = float(info(spark, root).get("fps") or 0)
    per = x.groupBy("episode_id").agg(F.count("*").alias("num_frames"), F.min_by("task_index", "frame_index").alias("task_index"), F.max(F.size("state")).alias("state_dim"), F.max(F.size("action")).alias("action_dim"))
    per = per.withColumns({"fps": F.lit(fps), "duration_s": F.when(F.lit(fps) > 0, F.col("num_frames") / fps).otherwise(0.0)})
    out = per.join(read_tasks(spark, root), "task_index", "left")
    own = episode_tasks(spark, root)
    if own is not None:
        out = out.join(own, "episode_id", "left").withColumn("task", F.coalesce("_own", "task")).drop("_own")
    return out.withColumnRenamed("task", "language_instruction")


def episode_tasks(spark: SparkSession, root: str) -> DataFrame | None:
    """``episode_id`` and the first task of each episode's record, from Parquet or JSON lines; None without records."""
    files = Files(spark, root)
    if files.exists("meta/episodes"):
        x = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")
    elif files.exists("meta/episodes.jsonl"):
        x = spark.read.schema("episode_index long, tasks array<string>, length long").json(f"{root}/meta/episodes.jsonl")
    else:
        return None
    if "tasks" not in x.columns:
        return None
    return x.select(F.format_string("episode_%06d", F.col("episode_index").cast("long")).alias("episode_id"), F.get("tasks", 0).alias("_own"))


def write_v3(frames: DataFrame, episodes: DataFrame, root: str, fps: float, robot: str = "unknown") -> None:
    """Write frames as a v3 dataset: data by episode, tasks, statistics, and ``info.json`` last.

    ``frames``: ``episode_id, frame_index, timestamp, action, state``; ``episodes``:
    ``episode_id, language_instruction``. Episodes are numbered by id, tasks in the order
    of their first episode; an episode without an instruction has the task "default".
    Frames may have ``action_tokens`` beside or instead of ``action``.
    """
    spark = frames.sparkSession
    sizes = frames.groupBy("episode_id").agg(F.count("*").alias("length"))
    named = episodes.select("episode_id", F.coalesce("language_instruction", F.lit("default")).alias("task")).join(sizes, "episode_id")
    numbered = number_rows(named, "episode_id", "episode_index", F.col("length"))
    # tasks are few beside episodes: their rank is one window over one row each
    tasks = numbered.groupBy("task").agg(F.min("episode_index").alias("_f")).withColumn("task_index", (F.row_number().over(Window.orderBy("_f")) - 1).cast("long")).drop("_f")
    full = numbered.join(tasks, "task")
    x = frames.join(full.select("episode_id", "episode_index", "task_index", "_base"), "episode_id")
    out = x.select(
        "episode_index", F.col("frame_index").cast("long").alias("frame_index"), (F.col("_base") + F.col("frame_index")).cast("long").alias("index"), "task_index",
        F.coalesce(F.col("timestamp"), F.col("frame_index") / fps).cast("float").alias("timestamp"), F.col("state").cast("array<float>").alias("observation.state"),
        *([F.col("action").cast("array<float>").alias("action")] if "action" in x.columns else []), *([F.col("action_tokens").cast("array<bigint>").alias("action_tokens")] if "action_tokens" in x.columns else []),
    )
    out.repartitionByRange("episode_index", "frame_index").sortWithinPartitions("episode_index", "frame_index").write.parquet(f"{root}/data")
    full.select("episode_index", F.array("task").alias("tasks"), "length").write.parquet(f"{root}/meta/episodes")
    tasks.coalesce(1).write.parquet(f"{root}/meta/tasks.parquet")
    pooled = {}
    for name, column in (("observation.state", "state"), ("action", "action")):
        if column not in frames.columns:
            continue
        stats = dimension_stats(frames, column, ["episode_id"])
        rows = pooled_stats(stats).orderBy("dim").collect()  # one row per dimension
        pooled[name] = {k: [r[k] for r in rows] for k in ("min", "max", "mean", "std")} | {"count": [rows[0]["count"] if rows else 0]}
    total = sizes.agg(F.count("*"), F.sum("length")).first()
    tokens = {}
    if "action_tokens" in frames.columns:
        tokens = {"action_tokens": {"dtype": "int64", "shape": [frames.agg(F.max(F.size("action_tokens"))).first()[0] or 0], "names": None}}
    files = Files(spark, root)
    files.write("meta/stats.json", json.dumps(pooled))
    files.write("meta/info.json", json.dumps({"codebase_version": "v3.0", "robot_type": robot, "fps": fps, "total_episodes": total[0], "total_frames": total[1] or 0, "features": {k: {"dtype": "float32", "shape": [len(v["min"])], "names": None} for k, v in pooled.items()} | tokens}))


HUB_URL = re.compile(r"^hf://(?P<org>[^/:@]+)/(?P<repo>[^/:@]+)(?::(?P<subset>[^@]+))?(?:@(?P<revision>.+))?$")


def parse_hub_url(url: str) -> dict[str, str | None]:
    """Parts of ``hf://org/repo[:subset][@revision]``."""
    found = HUB_URL.match(url)
    if not found:
        raise ValueError(f"not a hub address: {url}")
    return found.groupdict()


def detect_format(spark: SparkSession, root: str) -> str:
    """The format of a dataset folder or file; the most specific is tried first."""
    files = Files(spark, root)
    if files.exists("meta/info.json"):
        meta = json.loads(files.read("meta/info.json"))
        robot = str(meta.get("robot_type", ""))
        if any(x.lower() in robot.lower() for x in ("GR1", "SO100", "Panda")) or any("annotation.human" in k for k in meta.get("features", {})):
            return "groot"
        return "lerobot-v3" if str(meta.get("codebase_version", "")).startswith("v3") else "lerobot-v2"
    for pattern, name in (("*.vla", "robodm"), ("*.tfrecord*", "rlds"), ("*/dataset_info.json", "rlds"), (".zgroup", "zarr"), ("zarr.json", "zarr"), ("*.hdf5", "hdf5"), ("*.h5", "hdf5"), ("*.mcap", "mcap"), ("*.bag", "rosbag"), ("metadata.yaml", "rosbag")):
        if files.glob(pattern):
            return name
    for end, name in ((".vla", "robodm"), (".zarr", "zarr"), (".hdf5", "hdf5"), (".h5", "hdf5"), (".mcap", "mcap"), (".bag", "rosbag")):
        if root.rstrip("/").endswith(end):
            return name
    raise ValueError(f"no known dataset format at {root}")
