"""RLDS datasets: TFRecord shards with one example per episode, read to frames and written from them.

The layout is the published one: flat features ``steps/...`` of all steps end to end,
``dataset_info.json`` and ``features.json`` beside the shards.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.numbering import number_rows
from tidewheel.plans.catalog import Files
from tidewheel.session import materialize
from tidewheel.sources.records import parse_example, tfrecords

#: Where the state is looked for, in this order; episodes of a shard.
STATE_KEYS = ("state", "proprio", "proprioception", "robot_state")
SHARD_EPISODES = 10
VERSION = "1.0.0"
_FRAMES = "path string, record long, frame_index long, timestamp double, action array<double>, state array<double>, reward double, language_instruction string"
_STEPS = ("is_first", "is_last", "is_terminal", "reward", "discount")


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC = _crc_table()


def masked_crc32c(raw: bytes) -> int:
    """The checksum that TFRecord frames carry: CRC-32C, rotated and offset."""
    crc = 0xFFFFFFFF
    for b in raw:
        crc = crc >> 8 ^ _CRC[(crc ^ b) & 255]
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame_record(raw: bytes) -> bytes:
    size = struct.pack("<Q", len(raw))
    return size + struct.pack("<I", masked_crc32c(size)) + raw + struct.pack("<I", masked_crc32c(raw))


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _part(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def build_example(features: dict[str, list]) -> bytes:
    """A serialised example; a list of strings, floats or whole numbers per name."""
    entries = b""
    for name, values in sorted(features.items()):
        if values and isinstance(values[0], str):
            kind = _part(1, b"".join(_part(1, v.encode()) for v in values))
        elif values and isinstance(values[0], float):
            kind = _part(2, _part(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            kind = _part(3, _part(1, b"".join(map(_varint, values))))
        entries += _part(1, _part(1, name.encode()) + _part(2, kind))
    return _part(1, entries)


def _split(values: list | None, steps: int) -> list[list[float] | None]:
    width = len(values or ()) // steps
    return [[float(v) for v in values[k * width : (k + 1) * width]] if width else None for k in range(steps)]


def episode_steps(example: dict[str, list], fps: float) -> Iterator[tuple]:
    """``frame_index, timestamp, action, state, reward, language_instruction`` of each step.

    The number of steps is that of a flag or scalar that every step has; without any, the
    example has no steps. A state is the first of ``STATE_KEYS`` under ``steps/observation``
    or ``steps``; a missing reward is 0.0.
    """
    steps = next((len(v) for n in _STEPS if (v := example.get(f"steps/{n}"))), 0)
    if not steps:
        return
    found = (example.get(f"{p}/{k}") for k in STATE_KEYS for p in ("steps/observation", "steps"))
    action, state = _split(example.get("steps/action"), steps), _split(next((v for v in found if v), None), steps)
    reward, text = example.get("steps/reward") or [0.0] * steps, example.get("steps/language_instruction") or []
    for k in range(steps):
        yield k, k / fps, action[k], state[k], float(reward[k]), text[min(k, len(text) - 1)] if text else None


def read_frames(spark: SparkSession, root: str, fps: float = 30.0) -> DataFrame:
    """Frames of all episodes with ``path`` and ``record``, which name the episode.

    Shards are split by file; each is parsed in one task, an example at a time.
    """
    schema = pa.schema([("path", pa.string()), ("record", pa.int64()), ("frame_index", pa.int64()), ("timestamp", pa.float64()), ("action", pa.list_(pa.float64())), ("state", pa.list_(pa.float64())), ("reward", pa.float64()), ("language_instruction", pa.string())])

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for record, one in enumerate(tfrecords(raw)):
                    rows = [(path, record, *r) for r in episode_steps(parse_example(one), fps)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tfrecord*").load(root)
    return files.select("path", "content").mapInArrow(run, _FRAMES)


def _encode(rows: list[dict], action_dim: int) -> bytes:
    n = len(rows)
    flat = lambda c, width: [float(v) for r in rows for v in (r[c] if r[c] is not None else [0.0] * width)]
    last = [int(k == n - 1) for k in range(n)]
    features = {
        "steps/is_first": [int(k == 0) for k in range(n)], "steps/is_last": last, "steps/is_terminal": last, "steps/reward": [0.0] * n, "steps/discount": [1.0] * n,
        "steps/action": flat("action", action_dim), "steps/language_instruction": [rows[0]["language_instruction"] or ""] * n, "episode_metadata/episode_id": [str(rows[0]["episode_id"])],
    }
    width = max((len(r["state"]) for r in rows if r["state"] is not None), default=0)
    if width:
        features["steps/observation/state"] = flat("state", width)
    return build_example({k: v for k, v in features.items() if v})


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def write(frames: DataFrame, episodes: DataFrame, root: str, name: str = "episodes", fps: float = 30.0) -> DataFrame:
    """Write ``frames`` as shards of ten episodes under ``root/name/1.0.0``; metadata last.

    ``frames``: ``episode_id, frame_index, action, state``; ``episodes``: ``episode_id,
    language_instruction``, one row each. Episodes are ordered by id. A missing action is
    zeros of the episode data's width, a missing state likewise where the episode has one.
    A shard is one task, which holds an episode's rows at a time and moves the shard into
    place when it is whole, so a repeated task replaces equal bytes. ``root`` is a folder
    that all executors reach by pyarrow. Returns ``shard, n_episodes, n_frames``.
    """
    spark = frames.sparkSession
    sizes = frames.groupBy("episode_id").agg(F.max(F.size("action")).alias("_width"))
    named = number_rows(sizes.join(episodes.select("episode_id", "language_instruction"), "episode_id", "left"), "episode_id", "_index")
    named = materialize(named, "rlds-episodes")
    total, width = named.agg(F.count("*"), F.coalesce(F.max("_width"), F.lit(0))).first()
    shards, width = -(-total // SHARD_EPISODES), max(0, width)
    folder = f"{root.rstrip('/')}/{name}/{VERSION}"
    x = frames.join(named.drop("_width"), "episode_id").withColumn("_shard", F.floor(F.col("_index") / SHARD_EPISODES))
    x = x.select("_shard", "_index", F.col("episode_id").cast("string").alias("episode_id"), "frame_index", "action", "state", "language_instruction")

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        now = {"shard": None, "rows": [], "out": None, "temp": None, "episodes": 0, "frames": 0}

        def end_episode():
            if now["rows"]:
                now["out"].write(frame_record(_encode(now["rows"], width)))
                now["episodes"] += 1
                now["frames"] += len(now["rows"])
                now["rows"] = []

        def end_shard():
            end_episode()
            if now["out"] is None:
                return
            now["out"].close()
            fs.move(now["temp"], f"{base}/{name}-train.tfrecord-{now['shard']:05d}-of-{shards:05d}")
            yield pa.RecordBatch.from_pydict({"shard": [now["shard"]], "n_episodes": [now["episodes"]], "n_frames": [now["frames"]]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["_shard"] != now["shard"]:
                    yield from end_shard()
                    temp = f"{base}/.{uuid.uuid4().hex}.tmp"
                    now.update(shard=row["_shard"], temp=temp, out=fs.open_output_stream(temp), episodes=0, frames=0)
                elif now["rows"] and row["_index"] != now["rows"][0]["_index"]:
                    end_episode()
                now["rows"].append(row)
        yield from end_shard()

    made = x.repartition("_shard").sortWithinPartitions("_shard", "_index", "frame_index").mapInArrow(run, "shard long, n_episodes long, n_frames long")
    done = materialize(made, "rlds-shards")
    lengths = [str(r["n_episodes"]) for r in done.orderBy("shard").toLocalIterator()]
    files = Files(spark, folder)
    files.write("features.json", json.dumps({"steps": {"action": {"dtype": "float32", "shape": [width]}, "observation": {"state": {"dtype": "float32"}}, "language_instruction": {"dtype": "string"}}}))
    files.write("dataset_info.json", json.dumps({"name": name, "version": VERSION, "fileFormat": "tfrecord", "splits": [{"name": "train", "shardLengths": lengths, "filepathTemplate": "{DATASET}-{SPLIT}.{FILEFORMAT}-{SHARD_X_OF_Y}"}], "fps": fps}))
    return done
