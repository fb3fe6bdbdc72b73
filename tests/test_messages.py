import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.sources import datasets, mcap, messages, records, wire


def cdr(*parts):
    out = b""
    for kind, value in parts:
        if kind == "s":
            out += b"\0" * (-len(out) % 4) + struct.pack("<I", len(value) + 1) + value.encode() + b"\0"
        else:
            size = struct.calcsize(kind)
            out += b"\0" * (-len(out) % size) + struct.pack("<" + kind, value)
    return b"\0\1\0\0" + out


def joint_state(position):
    return cdr(("i", 1), ("I", 2), ("s", "base"), ("I", 2), ("s", "j1"), ("s", "joint2"), ("I", len(position)), *(("d", x) for x in position), ("I", 0), ("I", 0))


def decoded(schema, raw, text=b"", schema_encoding="ros2msg", encoding="cdr"):
    return wire.decode(wire.decoder(schema, schema_encoding, text, encoding), raw)


def plain(x):
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x.tolist() if isinstance(x, np.ndarray) else [plain(v) for v in x] if isinstance(x, list) else x


def test_cdr():
    got = plain(decoded("sensor_msgs/msg/JointState", joint_state([1.5, -2.0])))
    assert got.pop("header") == {"stamp": {"sec": 1, "nanosec": 2}, "frame_id": "base"}
    assert got == {"name": ["j1", "joint2"], "position": [1.5, -2.0], "velocity": [], "effort": []}
    array = cdr(("I", 1), ("s", "dim"), ("I", 2), ("I", 2), ("I", 0), ("I", 2), ("f", 0.5), ("f", 2.5))
    assert plain(decoded("std_msgs/Float32MultiArray", array))["data"] == [0.5, 2.5]
    assert decoded("std_msgs/msg/String", cdr(("s", "pick it"))) == {"data": "pick it"}
    pose = cdr(("i", 1), ("I", 2), ("s", "w"), *(("d", float(k)) for k in range(7)))
    made = decoded("geometry_msgs/msg/PoseStamped", pose)
    assert mcap.numbers_of(made, None).tolist() == mcap.numbers_of(made, "pose").tolist() == [float(k) for k in range(7)]
    assert mcap.numbers_of(made, "pose.orientation").tolist() == [3.0, 4.0, 5.0, 6.0]
    assert decoded("x/Y", pose) is None and decoded("sensor_msgs/JointState", pose[:20]) is None
    for message, part, want in (({"joint_positions": [1, 2]}, "position", [1.0, 2.0]), ({"data": 3}, None, [3.0]), ({"data": b"\1\2"}, None, [1.0, 2.0])):
        assert mcap.numbers_of(message, part).tolist() == want
    assert mcap.numbers_of({"data": "a"}, None) is None and mcap.numbers_of({"data": 1.7}, None, "i4").tolist() == [1.0]


CUSTOM = b"""# a gripper's own state
uint8 OPEN=1
string<=16 label
bool[3] flags
Finger[] fingers
pkg/Frame frame
wstring note
int16[<=8] raw
================================================================================
MSG: pkg/Finger
float32 force 0.5
string name "left"
================================================================================
MSG: pkg/Frame
geometry_msgs/Point at
int64 count
"""


def test_types_that_only_the_file_defines():
    raw = cdr(("s", "g1"), ("?", True), ("?", False), ("?", True), ("I", 2), ("f", 1.5), ("s", "l"), ("f", 2.5), ("s", "right"), ("d", 1.0), ("d", 2.0), ("d", 3.0), ("q", -7))
    at = len(raw) - 4
    raw += b"\0" * (-at % 4) + struct.pack("<I", 2) + "hé".encode("utf-16-le") + struct.pack("<I", 3) + struct.pack("<3h", 1, -2, 3)
    got = plain(decoded("pkg/msg/Grip", raw, CUSTOM))
    assert got == {"label": "g1", "flags": [True, False, True], "fingers": [{"force": 1.5, "name": "l"}, {"force": 2.5, "name": "right"}], "frame": {"at": {"x": 1.0, "y": 2.0, "z": 3.0}, "count": -7}, "note": "hé", "raw": [1, -2, 3]}
    assert decoded("pkg/Grip", raw, b"Unknown x") is None
    ros1 = struct.pack("<III", 5, 6, 7) + struct.pack("<I", 2) + b"ab" + struct.pack("<I", 2) + struct.pack("<2d", 1, 2)
    assert plain(decoded("a/B", ros1, b"Header header\nfloat64[] x\n" + b"=" * 80 + b"\nMSG: std_msgs/Header\nuint32 seq\ntime stamp\nstring frame_id", "ros1msg", "ros1")) == {"header": {"seq": 5, "stamp": {"secs": 6, "nsecs": 7}, "frame_id": "ab"}, "x": [1.0, 2.0]}


def test_image_messages():
    raw = cdr(("i", 1), ("I", 2), ("s", "cam"), ("I", 1), ("I", 2), ("s", "rgb8"), ("B", 0), ("I", 6), ("I", 6)) + bytes(range(6))
    assert mcap.image_of(decoded("sensor_msgs/msg/Image", raw)) == (1, 2, "rgb8", "raw", bytes(range(6)))
    small = cdr(("i", 1), ("I", 2), ("s", "cam"), ("s", "jpeg"), ("I", 3)) + b"xyz"
    assert mcap.image_of(decoded("sensor_msgs/CompressedImage", small)) == (None, None, None, "jpeg", b"xyz")


# --- protobuf


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def tagged(number, kind, body):
    return varint(number << 3 | kind) + (varint(len(body)) + body if kind == 2 else body)


def descriptor(name, *fields, nested=(), is_map=False):
    out = tagged(1, 2, name.encode())
    for number, field, kind, repeated, of in fields:
        out += tagged(2, 2, tagged(1, 2, field.encode()) + tagged(3, 0, varint(number)) + tagged(4, 0, varint(3 if repeated else 1)) + tagged(5, 0, varint(kind)) + (tagged(6, 2, of.encode()) if of else b""))
    out += b"".join(tagged(3, 2, n) for n in nested)
    return out + (tagged(7, 2, tagged(7, 0, varint(1))) if is_map else b"")


ENTRY = descriptor("NotesEntry", (1, "key", 9, False, ""), (2, "value", 5, False, ""), is_map=True)
ARM = descriptor(
    "Arm", (1, "joint_positions", 1, True, ""), (2, "ticks", 5, True, ""), (3, "name", 9, False, ""), (4, "pose", 11, False, ".robot.Pose"), (5, "steps", 18, True, ""),
    (6, "notes", 11, True, ".robot.Arm.NotesEntry"), (7, "done", 8, False, ""), (8, "kind", 14, False, ""), (9, "raw", 12, False, ""), (10, "tags", 9, True, ""), nested=[ENTRY],
)
POSE = descriptor("Pose", (1, "x", 2, False, ""), (2, "count", 3, False, ""))
ROBOT = tagged(1, 2, tagged(1, 2, b"robot.proto") + tagged(2, 2, b"robot") + tagged(4, 2, ARM) + tagged(4, 2, POSE))


def test_protobuf_by_descriptors():
    pose = tagged(1, 5, struct.pack("<f", 0.5)) + tagged(2, 0, varint(-3))
    raw = tagged(1, 2, struct.pack("<2d", 1.5, -2)) + tagged(1, 1, struct.pack("<d", 9)) + tagged(2, 2, varint(1) + varint(300) + varint(-1)) + tagged(3, 2, "ä".encode())
    raw += tagged(4, 2, pose) + tagged(5, 2, varint(1) + varint(2) + varint((1 << 64) - 1)) + tagged(6, 2, tagged(1, 2, b"k") + tagged(2, 0, varint(7))) + tagged(7, 0, varint(1)) + tagged(99, 0, varint(5)) + tagged(10, 2, b"a") + tagged(10, 2, b"b")
    got = plain(decoded("robot.Arm", raw, ROBOT, "protobuf", "protobuf"))
    assert got == {"joint_positions": [1.5, -2.0, 9.0], "ticks": [1, 300, -1], "name": "ä", "pose": {"x": 0.5, "count": -3}, "steps": [-1, 1, -(1 << 63)], "notes": {"k": 7}, "done": True, "kind": 0, "raw": b"", "tags": ["a", "b"]}
    assert mcap.numbers_of(decoded("robot.Arm", raw, ROBOT, "protobuf", "protobuf"), "position").tolist() == [1.5, -2.0, 9.0]
    assert decoded("robot.Arm", raw[:-1], ROBOT, "protobuf", "protobuf") is None and decoded("robot.Leg", raw, ROBOT, "protobuf", "protobuf") is None
    assert plain(decoded("robot.Arm", b"", ROBOT, "protobuf", "protobuf"))["pose"] is None


@pytest.mark.parametrize("values", [[], [0], [127, 128], [(1 << 64) - 1, 5, 1 << 63]])
def test_varints_at_once(values):
    assert wire.varints(b"".join(map(varint, values))).tolist() == values


@pytest.fixture
def log(spark, tmp_path):
    """Joints each 100 ms, commands 20 ms later, a pause of 5 s after ten, a marker at it."""
    rows = []
    for k in range(20):
        t = 10**9 + k * 10**8 + (5 * 10**9 if k >= 10 else 0)
        rows.append(("/joint_states", t, json.dumps({"position": [float(k), 1.0]}).encode()))
        rows.append(("/command", t + 2 * 10**7, json.dumps({"position": [float(k) + 0.5]}).encode()))
    rows += [("/episode/marker", 10**9 + 11 * 10**8 - 1, b'{"data": "next"}'), ("/task", 10**9, b'{"data": "stack the cups"}'), ("/joint_states", 5 * 10**9, b"broken")]
    kinds = {"/joint_states": "sensor_msgs/msg/JointState", "/command": "sensor_msgs/msg/JointState", "/task": "std_msgs/msg/String", "/episode/marker": "std_msgs/msg/String"}
    (tmp_path / "a.mcap").write_bytes(records.write_mcap(sorted(rows, key=lambda r: r[1]), schemas=kinds))
    return f"file://{tmp_path}"


FIELDS = {"observation.state": {"topic": "/joint_states", "field": "position"}, "action": {"topic": "/command", "field": "position"}}


@pytest.mark.parametrize(("episodes", "lengths"), [({}, [20]), ({"strategy": "time_gap", "time_gap_seconds": 2}, [10, 10]), ({"strategy": "marker", "marker_topic": "/episode/marker"}, [10, 10]), ({"strategy": "time_gap", "time_gap_seconds": 2, "drop_first_n_frames": 3, "min_length_frames": 7}, [7, 7]), ({"min_length_frames": 21}, [])])
def test_episodes_of_logs(spark, log, episodes, lengths):
    config = messages.load_config({"episodes": episodes, "fields": FIELDS, "sync": {"primary": "observation.state", "method": "nearest"}, "task": {"topic": "/task"}})
    frames, said = messages.read_episodes(spark, f"{log}/a.mcap", config)
    per = frames.groupBy("episode_id").count().orderBy("episode_id").collect()
    assert [r["count"] for r in per] == lengths
    assert all(r["action"] == [r["state"][0] + 0.5] and r["state"][1] == 1.0 for r in frames.collect())
    if lengths:
        assert {r["language_instruction"] for r in said.collect()} == {"stack the cups"}
        first = frames.orderBy("episode_id", "frame_index").first()
        assert (first["episode_id"], first["frame_index"], first["timestamp"], first["skewed"]) == ("a.mcap#0000", 0, 0.0, False)


def test_segments_and_skew(spark, log):
    base = {"fields": FIELDS, "sync": {"primary": "observation.state", "max_skew_ms": 1}}
    frames, _ = messages.read_episodes(spark, f"{log}/a.mcap", messages.load_config(base))
    assert frames.count() == 0  # 20 ms are over ten times 1 ms
    frames, _ = messages.read_episodes(spark, f"{log}/a.mcap", messages.load_config(base | {"sync": {"primary": "observation.state", "max_skew_ms": 10}}))
    assert frames.count() == 20 and frames.where("skewed").count() == 20
    config = messages.load_config({"fields": FIELDS, "sync": {"primary": "observation.state"}, "episodes": {"strategy": "segment", "segment_signal": "observation.state", "min_length_frames": 2}})
    assert messages.read_episodes(spark, f"{log}/a.mcap", config)[0].count() == 20


def test_logs_open_as_datasets(spark, log):
    frames, episodes = datasets.open_dataset(spark, log)
    assert frames.count() == 20 and episodes.count() == 2
    assert frames.columns == list(datasets.COLUMNS) and frames.where("action is null or state is null").count() == 0


def test_config_names_what_is_wrong():
    for raw, place in (({"episodes": {"strategy": "x"}}, "episodes.strategy"), ({"episodes": {"strategy": "marker"}}, "episodes.marker_topic"), ({"episodes": {"strategy": "time_gap"}}, "episodes.time_gap_seconds"), ({"fields": {"a": {}}}, "fields.a.topic"), ({"fields": []}, None), ({"fields": [1]}, "fields"), ({"sync": {"method": "x"}}, "sync.method"), ({"sync": {"primary": "x"}}, "sync.primary")):
        if place is None:
            assert messages.load_config(raw).fields == {}
        else:
            with pytest.raises(ValueError, match=place):
                messages.load_config(raw)
    assert messages.load_config('{"fields": {"action": {"topic": "/c"}}}').fields == {"action": {"topic": "/c"}}
