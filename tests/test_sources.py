import gzip
import json
import struct

from pyspark.sql import functions as F

from tidewheel.sources import lerobot, records, topics


def test_lerobot_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    rows = [(e, i, i / 10, [float(i), float(n)], [float(-i)]) for n, e in enumerate(("a", "b")) for i in range(5)]
    frames = spark.createDataFrame(rows, "episode_id string, frame_index long, timestamp double, state array<double>, action array<double>")
    lerobot.write_v3(frames, spark.createDataFrame([("a", "lift"), ("b", None)], "episode_id string, language_instruction string"), root, 10.0)
    assert lerobot.detect_format(spark, root) == "lerobot-v3"
    back = lerobot.read_frames(spark, root).orderBy("episode_id", "frame_index").collect()
    assert [(r["episode_id"], r["frame_index"], r["state"], r["action"]) for r in back] == [(f"episode_{'ab'.index(e):06d}", i, s, a) for e, i, _, s, a in rows]
    episodes = {r["episode_id"]: r for r in lerobot.read_episodes(spark, root).collect()}
    assert [episodes[k]["language_instruction"] for k in sorted(episodes)] == ["lift", "default"]
    stats = json.loads((tmp_path / "d/meta/stats.json").read_text())
    assert stats["observation.state"]["mean"] == [2.0, 0.5] and stats["action"]["count"] == [10]


def test_hub_url():
    assert lerobot.parse_hub_url("hf://org/repo:sub@main") == {"org": "org", "repo": "repo", "subset": "sub", "revision": "main"}


def _example(**features):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    body = lambda tag, raw: varint(tag << 3 | 2) + varint(len(raw)) + raw
    entries = b""
    for name, v in features.items():
        if isinstance(v[0], float):
            inner = body(2, body(1, struct.pack(f"<{len(v)}f", *v)))
        elif isinstance(v[0], int):
            inner = body(3, body(1, b"".join(varint(x & (1 << 64) - 1) for x in v)))
        else:
            inner = body(1, b"".join(body(1, x.encode()) for x in v))
        entries += body(1, body(1, name.encode()) + body(2, inner))
    return body(1, entries)


def test_tfrecord(spark, tmp_path):
    raw = b"".join(struct.pack("<QI", len(r), 0) + r + struct.pack("<I", 0) for r in (_example(action=[0.5, 1.5], n=[3, -1]), _example(text=["hi"])))
    (tmp_path / "a.tfrecord").write_bytes(raw)
    (tmp_path / "b.tfrecord").write_bytes(gzip.compress(raw))
    got = records.read_tfrecord(spark, f"file://{tmp_path}").groupBy("record", "name").agg(F.count("*").alias("n"), F.first("values").alias("v")).collect()
    assert {(r["record"], r["name"]): (r["n"], json.loads(r["v"])) for r in got} == {(0, "action"): (2, [0.5, 1.5]), (0, "n"): (2, [3, -1]), (1, "text"): (2, ["hi"])}


def test_mcap(spark, tmp_path):
    (tmp_path / "a.mcap").write_bytes(records.write_mcap([("/joint", 10, b"{}"), ("/cam", 11, b"x"), ("/joint", 12, b"[1]")]))
    got = records.read_mcap(spark, f"file://{tmp_path}", ["/joint"]).orderBy("ts_ns").collect()
    assert [(r["topic"], r["ts_ns"], bytes(r["data"])) for r in got] == [("/joint", 10, b"{}"), ("/joint", 12, b"[1]")]
    assert lerobot.detect_format(spark, f"file://{tmp_path}") == "mcap"


def test_mcap_inventory_and_fields(spark, tmp_path):
    joint, image = "sensor_msgs/msg/JointState", "sensor_msgs/msg/CompressedImage"
    schemas = {"/arm/joint": joint, "/base/joint": joint, "/arm/cmd": joint, "/cam/front/image_raw": image, "/tool/pose": "geometry_msgs/msg/PoseStamped", "/episode/start": "std_msgs/msg/String", "/out/target": "std_msgs/msg/Float64MultiArray"}
    body = json.dumps({"position": [1, 2.5]}).encode()
    messages = [(t, 10 + k, body) for t in schemas for k in range(3 if t == "/arm/joint" else 2)]
    (tmp_path / "a.mcap").write_bytes(records.write_mcap(messages, schemas=schemas))
    (tmp_path / "b.mcap").write_bytes(records.write_mcap([("/points", 1, b"x")], schemas={"/points": "sensor_msgs/msg/PointCloud2"}))
    channels = records.mcap_inventory(spark, f"file://{tmp_path}")
    found = {(r["path"][-6:], r["topic"]): (r["schema_name"], r["n_messages"], r["start_ns"], r["end_ns"]) for r in channels.collect()}
    assert found["a.mcap", "/arm/joint"] == (joint, 3, 10, 12) and found["b.mcap", "/points"][1] == 1 and len(found) == 8
    fields = {r["field"]: (r["topic"], r["part"], r["encoding"]) for r in topics.propose_fields(channels).collect()}
    assert fields == {
        "observation.state": ("/arm/joint", "position", None), "observation.state.base_joint": ("/base/joint", "position", None), "action": ("/arm/cmd", "position", None),
        "observation.images.cam_front": ("/cam/front/image_raw", None, "jpeg"), "observation.ee_pose": ("/tool/pose", None, None), "task": ("/episode/start", None, None), "episode_marker": ("/episode/start", None, None),
    }
    read = records.read_mcap(spark, f"file://{tmp_path}")
    assert [r["value"] for r in topics.extract(read, "/arm/joint", "position").collect()] == [[1.0, 2.5]] * 3
    assert [r["value"] for r in topics.extract(read, "/points", "x").collect()] == [None]
