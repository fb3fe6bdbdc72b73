"""Which topic feeds which field: proposed from an inventory of channels, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Message types by what they carry, and words in topic names.
IMAGES = ["sensor_msgs/msg/Image", "sensor_msgs/Image", "sensor_msgs/msg/CompressedImage", "sensor_msgs/CompressedImage", "foxglove.RawImage", "foxglove.CompressedImage", "foxglove.CompressedVideo"]
JOINTS = ["sensor_msgs/msg/JointState", "sensor_msgs/JointState", "schemas.proto.JointState"]
POSES = ["geometry_msgs/msg/PoseStamped", "geometry_msgs/PoseStamped", "foxglove.PoseInFrame"]
ARRAYS = ["std_msgs/msg/Float32MultiArray", "std_msgs/msg/Float64MultiArray", "std_msgs/Float32MultiArray", "std_msgs/Float64MultiArray"]
TASKS = ["std_msgs/msg/String", "foxglove.KeyValuePair"]
COMMAND = "(?i)(cmd|command|target|commanded|desired|action|goal)"
TOOL = "(?i)(ee|tool|tcp|wrist)"
MARKER = "(?i)(/episode/|/marker|/task_description)"
IMAGE_WORDS = ["image", "image_raw", "image_rect", "compressed", "video_compressed", "rgb"]
MAX_SKEW_MS = 150.0


def short_name(topic: Column) -> Column:
    """Up to three parts of a topic, without words that only say "image"."""
    parts = F.filter(F.split(topic, "/"), lambda x: x != "")
    telling = F.array_except(parts, F.array(*map(F.lit, IMAGE_WORDS)))
    kept = F.when(F.size(telling) > 0, F.filter(parts, lambda x: ~x.isin(IMAGE_WORDS))).otherwise(parts)
    return F.when(F.size(parts) == 0, F.lit("topic")).otherwise(F.array_join(F.slice(kept, 1, 3), "_"))


def propose_fields(channels: DataFrame) -> DataFrame:
    """Fields of each file from ``records.mcap_inventory``: ``path, field, topic, part, encoding, n_messages``.

    The joint topic of most messages that isn't named as a command is the state, others
    are states by their own names; the first command among joints, else among number
    arrays, is the action; each image topic is a camera; the first tool pose, text and
    marker topics are pose, task and split marker. A file with no joints, images, poses
    or arrays gives no row. First is by topic name; ties of messages too.
    """
    role = F.when(F.col("schema_name").isin(JOINTS), F.when(F.col("topic").rlike(COMMAND), "command").otherwise("joint"))
    for name, types in (("image", IMAGES), ("pose", POSES), ("array", ARRAYS), ("text", TASKS)):
        role = role.when(F.col("schema_name").isin(types), name)
    # a file has few channels: its rows meet once, and everything below stays in place
    mine = Window.partitionBy("path")
    x = channels.withColumn("role", role).withColumn("marks", F.col("topic").rlike(MARKER))
    x = x.withColumns({
        "known": F.count_if(F.col("role").isin("joint", "command", "image", "pose", "array")).over(mine) > 0,
        "commanded": F.count_if(F.col("role") == "command").over(mine) > 0,
        "busiest": F.row_number().over(Window.partitionBy("path", "role").orderBy(F.desc("n_messages"), "topic")),
    }).where("known")
    fits = F.when(F.col("role") == "array", F.col("topic").rlike(COMMAND)).when(F.col("role") == "pose", F.col("topic").rlike(TOOL)).otherwise(True)
    x = x.withColumn("fits", fits).withColumn("first", F.row_number().over(Window.partitionBy("path", "role", "fits").orderBy("topic")) == 1)
    name = short_name(F.col("topic"))
    field = (
        F.when((F.col("role") == "joint") & (F.col("busiest") == 1), F.lit("observation.state"))
        .when(F.col("role") == "joint", F.concat(F.lit("observation.state."), name))
        .when((F.col("role") == "command") & F.col("first"), F.lit("action"))
        .when((F.col("role") == "array") & F.col("fits") & F.col("first") & ~F.col("commanded"), F.lit("action"))
        .when(F.col("role") == "image", F.concat(F.lit("observation.images."), name))
        .when((F.col("role") == "pose") & F.col("fits") & F.col("first"), F.lit("observation.ee_pose"))
        .when((F.col("role") == "text") & F.col("first"), F.lit("task"))
    )
    part = F.when(F.col("role").isin("joint", "command"), "position").when(F.col("role") == "array", "data")
    encoding = F.when(F.col("role") == "image", F.when(F.col("schema_name").contains("Video"), "video").when(F.col("schema_name").contains("Compressed"), "jpeg"))
    fields = x.withColumns({"field": field, "part": part, "encoding": encoding})
    marker = F.when(F.col("marks") & (F.row_number().over(Window.partitionBy("path", "marks").orderBy("topic")) == 1), F.lit("episode_marker"))
    both = F.array_compact(F.array(F.col("field"), F.col("marker")))
    return fields.withColumn("marker", marker).withColumn("field", F.explode(both)).select("path", "field", "topic", F.when(F.col("field") != "episode_marker", F.col("part")).alias("part"), "encoding", "n_messages")


def extract(messages: DataFrame, topic: str, part: str) -> DataFrame:
    """``path, ts_ns, value`` of a topic of JSON messages: the numbers under ``part``, one or a list; else null."""
    found = F.get_json_object(F.col("data").cast("string"), f"$.{part}")
    one = F.expr("try_cast(found AS double)")
    value = F.when(F.col("found").startswith("["), F.from_json("found", "array<double>")).when(one.isNotNull(), F.array(one))
    return messages.where(F.col("topic") == topic).select("path", "ts_ns", found.alias("found")).select("path", "ts_ns", value.alias("value"))
