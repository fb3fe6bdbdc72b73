"""Numbers, text and images out of the messages of robot logs, and episodes out of their topics and back."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators import segment, temporal
from tidewheel.operators.numbering import number_rows
from tidewheel.session import materialize
from tidewheel.sources import mcap, topics, wire

STRATEGIES = ("single", "time_gap", "marker", "segment")
MAX_SKEW_MS = 50.0


def read_topics(spark: SparkSession, path: str, parts: dict[str, str | None | list]) -> DataFrame:
    """``path, topic, ts_ns, part, value, text`` of the wanted topics.

    ``parts`` names each topic's part that holds numbers, or lists several, each with a numpy type
    or None; ``part`` is the place in that list.
    Only chunks of these topics are read, and messages are decoded by the file's own schema; one
    that can't be decoded has neither value nor text.
    """
    return mcap.read(spark, path, "fields", parts=parts)


def read_images(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """``path, topic, ts_ns, height, width, encoding, format, data`` of image messages; compressed ones have no size."""
    return mcap.read(spark, path, "images", topics=topics)


@dataclass
class LogConfig:
    """Which topics feed which fields, and how a log becomes episodes."""

    fields: dict[str, dict] = field(default_factory=dict)
    strategy: str = "single"
    marker_topic: str | None = None
    time_gap_seconds: float | None = None
    segment_signal: str | None = None
    min_length_frames: int = 0
    drop_first_n_frames: int = 0
    primary: str | None = None
    method: str = "nearest"
    max_skew_ms: float = MAX_SKEW_MS
    task: str | None = None
    task_topic: str | None = None
    attachments: list[dict] = field(default_factory=list)


def load_config(raw: dict | str | None) -> LogConfig:
    """A config from a dictionary or the text of a YAML or JSON file; what is wrong is named by its place."""

    def need(ok: bool, place: str, why: str) -> None:
        if not ok:
            raise ValueError(f"{place}: {why}")

    if isinstance(raw, str):
        try:
            import yaml

            raw = yaml.safe_load(raw)
        except ImportError:
            raw = json.loads(raw)
    raw = raw or {}
    need(isinstance(raw, dict), "config", "must be a mapping")
    parts = {k: raw.get(k) or {} for k in ("episodes", "fields", "sync", "task")}
    for k, v in parts.items():
        need(isinstance(v, dict), k, "must be a mapping")
    e, s, t = parts["episodes"], parts["sync"], parts["task"]
    need(e.get("strategy", "single") in STRATEGIES, "episodes.strategy", f"must be one of {', '.join(STRATEGIES)}")
    if e.get("strategy") == "marker":
        need(bool(e.get("marker_topic")), "episodes.marker_topic", "a topic that marks the starts is needed")
    if e.get("strategy") == "time_gap":
        need(isinstance(e.get("time_gap_seconds"), (int, float)) and e["time_gap_seconds"] > 0, "episodes.time_gap_seconds", "a number of seconds above 0 is needed")
    if e.get("strategy") == "segment":
        need(bool(e.get("segment_signal")), "episodes.segment_signal", "the field to cut by is needed")
    need(s.get("method", "nearest") in temporal.METHODS, "sync.method", f"must be one of {', '.join(temporal.METHODS)}")
    for name, f in parts["fields"].items():
        need(isinstance(f, dict), f"fields.{name}", "must be a mapping")
        need(bool(f.get("topic")), f"fields.{name}.topic", "must name a topic")
        shape = f.get("target_shape")
        need(shape is None or isinstance(shape, (list, tuple)) and all(isinstance(n, int) and n > 0 for n in shape), f"fields.{name}.target_shape", "must list whole numbers above 0")
        if f.get("dtype") is not None:
            try:
                np.dtype(f["dtype"])
            except TypeError:
                need(False, f"fields.{name}.dtype", f"no number type {f['dtype']!r}")
    attached = raw.get("attachments") or []
    need(isinstance(attached, list), "attachments", "must be a list")
    for k, a in enumerate(attached):
        need(isinstance(a, dict) and bool(a.get("name")), f"attachments[{k}]", "must be a mapping with a name")
    for place, name in (("sync.primary", s.get("primary")), ("episodes.segment_signal", e.get("segment_signal"))):
        need(name is None or name in parts["fields"], place, f"no field {name!r}")
    return LogConfig(
        parts["fields"], e.get("strategy", "single"), e.get("marker_topic"), e.get("time_gap_seconds"), e.get("segment_signal"), int(e.get("min_length_frames", 0)), int(e.get("drop_first_n_frames", 0)),
        s.get("primary"), s.get("method", "nearest"), float(s.get("max_skew_ms", MAX_SKEW_MS)), t.get("description"), t.get("topic"), attached,
    )


def proposed_config(spark: SparkSession, path: str) -> LogConfig:
    """A config from the channels of the logs: number fields, marker and task of the first file that names them."""
    channels = mcap.read(spark, path, "channels")
    first = F.min_by(F.struct("topic", "part", "encoding"), "path").alias("first")
    found = topics.propose_fields(channels).groupBy("field").agg(first).select("field", "first.*").orderBy("field").collect()  # a row for each field name
    config = LogConfig(max_skew_ms=topics.MAX_SKEW_MS)
    for r in found:
        if r["field"] == "episode_marker":
            config.marker_topic = r["topic"]
        elif r["field"] == "task":
            config.task_topic = r["topic"]
        elif r["encoding"] is None:
            config.fields[r["field"]] = {"topic": r["topic"], "field": r["part"]}
    if config.marker_topic:
        config.strategy = "marker"
    return config


def _split(config: LogConfig, primary: DataFrame, all_topics: DataFrame, signal: DataFrame | None) -> DataFrame:
    """Adds ``episode`` to the primary field's rows ``path, ts``."""
    if config.strategy == "time_gap":
        return temporal.split_time_gap(primary, ["path"], "ts", int(config.time_gap_seconds * 1e9))
    if config.strategy == "marker":
        marks = all_topics.where((F.col("topic") == config.marker_topic) & (F.col("part") == 0)).select("path", F.col("ts_ns").alias("ts"))
        return temporal.split_marker(primary, marks, ["path"], "ts")
    if config.strategy == "segment":
        w = Window.partitionBy("path").orderBy("ts")
        rows = primary.withColumn("_pos", F.row_number().over(w) - 1)
        cut = segment.segment_episodes(signal.select(F.col("path").alias("episode_id"), (F.row_number().over(w) - 1).alias("frame_index"), F.col("value").alias("state")), "state", "rbf", 10.0, max(2, config.min_length_frames))
        spans = cut.select(F.col("episode_id").alias("path"), F.col("segment").alias("episode"), "start", "end")
        return rows.join(spans, "path").where("_pos >= start and _pos < end").drop("_pos", "start", "end")
    return primary.withColumn("episode", F.lit(0).cast("long"))


def read_episodes(spark: SparkSession, path: str, config: LogConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames and episodes of MCAP logs.

    The primary field, the configured one or that of most messages, sets the frames; all
    others are aligned to its times. A frame that a field is further from than ten times
    ``max_skew_ms`` is dropped; ``skewed`` marks those over ``max_skew_ms``. Frames:
    ``episode_id, frame_index, timestamp`` (seconds from the episode's first), ``state``
    (all fields that begin with observation.state, in order), ``action``, ``skewed`` and the
    other fields by name in ``others``. Episodes: ``episode_id, language_instruction``.

    A field's ``dtype`` rounds its numbers to that type; with a ``target_shape`` messages of
    another number of values count as missing. Values stay flat.
    """
    config = config or proposed_config(spark, path)
    if not config.fields:
        raise ValueError(f"no field of numbers in the logs at {path}")
    wanted: dict[str, set] = {}
    for f in config.fields.values():
        wanted.setdefault(f["topic"], set()).add((f.get("field"), f.get("dtype")))
    parts = {t: [list(p) for p in sorted(found, key=str)] for t, found in wanted.items()} | {t: None for t in (config.marker_topic, config.task_topic) if t and t not in wanted}
    rows = materialize(read_topics(spark, path, parts), "topics")  # decoded once, whatever reads it below

    def stream(f: dict) -> DataFrame:
        part = parts[f["topic"]].index([f.get("field"), f.get("dtype")])
        size = int(np.prod(f["target_shape"])) if f.get("target_shape") else None
        fits = F.col("value").isNotNull() & (F.lit(True) if size is None else F.size("value") == size)
        return rows.where((F.col("topic") == f["topic"]) & (F.col("part") == part) & fits).select("path", F.col("ts_ns").alias("ts"), "value")

    streams = {n: stream(f) for n, f in config.fields.items()}
    primary = config.primary
    if primary is None:
        counts = dict(rows.where("value is not null and part = 0").groupBy("topic").count().collect())  # a row for each topic
        primary = max(config.fields, key=lambda n: counts.get(config.fields[n]["topic"], 0))
    signal = streams[config.segment_signal] if config.segment_signal else None
    if signal is not None and config.segment_signal != primary:
        signal = temporal.align(streams[primary].select("path", "ts"), signal, ["path"], "ts", "value", config.method).select("path", "ts", "value")
    column = {n: f"_f{k}" for k, n in enumerate(config.fields)}  # names of fields hold dots
    x = _split(config, streams[primary].withColumnRenamed("value", column[primary]), rows, signal)
    x = x.withColumn("_skew", F.lit(0).cast("long"))
    for name, stream in streams.items():
        if name != primary:
            x = temporal.align(x, stream, ["path"], "ts", "value", config.method).withColumnRenamed("value", column[name])
            x = x.withColumn("_skew", F.greatest("_skew", F.coalesce(F.col("skew").cast("long"), F.lit(0)))).drop("source_ts", "skew")
    most = config.max_skew_ms * 1e6
    x = x.where(F.col("_skew") <= 10 * most).withColumn("skewed", F.col("_skew") > most)
    if config.drop_first_n_frames or config.min_length_frames:
        x = temporal.post_filter(x, ["path", "episode"], ["ts"], config.drop_first_n_frames, max(1, config.min_length_frames))
    w = Window.partitionBy("path", "episode").orderBy("ts")
    states = [F.col(column[n]) for n in config.fields if n.startswith("observation.state")]
    others = [n for n in config.fields if n != "action" and not n.startswith("observation.state")]
    null = F.lit(None).cast("array<double>")
    frames = x.select(
        F.concat(F.regexp_extract("path", "[^/]+$", 0), F.lit("#"), F.lpad(F.col("episode").cast("string"), 4, "0")).alias("episode_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_index"),
        ((F.col("ts") - F.first("ts").over(w)) / F.lit(1e9)).alias("timestamp"), (F.col(column["action"]) if "action" in config.fields else null).alias("action"),
        (F.concat(*states) if len(states) > 1 else states[0] if states else null).alias("state"), "skewed",
        (F.create_map(*(c for n in others for c in (F.lit(n), F.col(column[n])))) if others else F.lit(None).cast("map<string,array<double>>")).alias("others"), "path",
    )
    said = F.lit(config.task).cast("string")
    episodes = frames.groupBy("episode_id").agg(F.first("path").alias("path"))
    if config.task is None and config.task_topic:
        first = rows.where((F.col("topic") == config.task_topic) & F.col("text").isNotNull()).groupBy("path").agg(F.min_by("text", "ts_ns").alias("said"))
        episodes, said = episodes.join(first, "path", "left"), F.col("said")
    return frames.drop("path"), episodes.select("episode_id", said.alias("language_instruction"))


#: What follows the topics of each episode in a log that holds several.
SUFFIX = r"/ep_(\d+)$"


def write_episodes(frames: DataFrame, episodes: DataFrame | None, path: str, state_topic: str = "/observation/state", action_topic: str = "/action", task_topic: str = "/task", compression: str = "zstd", attachments: list[dict] | None = None, mode: str = "append") -> None:
    """Write frames as logs: joint states on topics that end with the number of their episode.

    Episodes are numbered by id; all of an episode goes to one file. A frame without
    a time, or without an id, raises. ``episodes`` gives the text of the task topic.
    """
    spark = frames.sparkSession
    ids = number_rows(frames.select("episode_id").distinct(), "episode_id", "episode")
    said = None if episodes is None else episodes.groupBy("episode_id").agg(F.min("language_instruction").alias("said"))
    ids = ids.withColumn("said", F.lit(None).cast("string")) if said is None else ids.join(said, "episode_id", "left")
    checked = F.when(F.col("episode_id").isNull() | F.col("timestamp").isNull(), F.raise_error(F.lit("a frame has no episode or no time"))).otherwise(F.round(F.col("timestamp") * 1e9).cast("long"))
    rows = frames.select("episode_id", checked.alias("ts_ns"), "frame_index", F.col("action").cast("array<double>").alias("action"), F.col("state").cast("array<double>").alias("state")).join(ids, "episode_id")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(width, "episode").sortWithinPartitions("episode", "frame_index")
    joint, text = ("sensor_msgs/JointState", wire.ros_text("sensor_msgs/JointState").encode()), ("std_msgs/String", wire.ros_text("std_msgs/String").encode())
    schema = "topic string, ts_ns long, data binary, encoding string, schema_name string, schema_encoding string, schema binary"

    def messages(batches):
        last = None
        for batch in batches:
            out = []
            for episode, ts, said_, *vectors in zip(*(batch.column(n).to_pylist() for n in ("episode", "ts_ns", "said")), *(batch.column(n) for n in ("state", "action")), strict=True):
                if episode != last and said_ is not None:
                    out.append((f"{task_topic}/ep_{episode:04d}", ts, wire.string_cdr(said_), "cdr", text[0], "ros2msg", text[1]))
                last = episode
                for base, v in zip((state_topic, action_topic), vectors, strict=True):
                    if v.is_valid:
                        values = v.values.to_numpy(zero_copy_only=False)
                        out.append((f"{base}/ep_{episode:04d}", ts, wire.joint_state_cdr(ts, values), "cdr", joint[0], "ros2msg", joint[1]))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("topic", "ts_ns", "data", "encoding", "schema_name", "schema_encoding", "schema"), map(list, zip(*out, strict=True)), strict=True)))

    mcap.write(placed.mapInArrow(messages, schema), path, mode, compression, attachments)


def has_episode_topics(spark: SparkSession, path: str) -> bool:
    """Whether the logs hold episodes on topics of their own."""
    return not mcap.read(spark, path, "channels").where(F.col("topic").rlike(SUFFIX)).isEmpty()


def read_numbered(spark: SparkSession, path: str, state_topic: str = "/observation/state", action_topic: str = "/action", task_topic: str = "/task") -> tuple[DataFrame, DataFrame]:
    """Frames and episodes of logs whose topics end with their episode's number: what ``write_episodes`` writes."""
    rows = mcap.read(spark, path, "fields").withColumns({"base": F.regexp_replace("topic", SUFFIX, ""), "episode": F.regexp_extract("topic", SUFFIX, 1)})
    rows = materialize(rows.where("episode <> ''").withColumn("episode_id", F.concat(F.lit("ep_"), "episode")).drop("path", "topic", "episode"), "numbered-topics")
    moved = rows.where(F.col("base").isin(state_topic, action_topic)).groupBy("episode_id", "ts_ns").agg(*(F.max(F.when(F.col("base") == t, F.col("value"))).alias(n) for t, n in ((action_topic, "action"), (state_topic, "state"))))
    w = Window.partitionBy("episode_id").orderBy("ts_ns")
    frames = moved.select("episode_id", (F.row_number().over(w) - 1).cast("long").alias("frame_index"), (F.col("ts_ns") / F.lit(1e9)).alias("timestamp"), "action", "state")
    said = rows.where(F.col("base") == task_topic).groupBy("episode_id").agg(F.min_by("text", "ts_ns").alias("language_instruction"))
    return frames, moved.select("episode_id").distinct().join(said, "episode_id", "left")
