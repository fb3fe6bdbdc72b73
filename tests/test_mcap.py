"""The MCAP source: which bytes are read, files with and without an index, filters, and the writer."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.sources import datasets, mcap, messages, records, wire


pytestmark = pytest.mark.usefixtures("spark")


def reader(path, content="messages", **options):
    return mcap.McapReader({"path": str(path), "content": content, **options}, StructType.fromDDL(mcap.CONTENTS[content]))


def taken(r):
    """Rows and bytes that a reader's partitions read."""
    rows, read = [], []
    made = mcap.Ranges.__exit__
    mcap.Ranges.__exit__ = lambda self, *a: (read.append(self.bytes_read), made(self, *a))[1]
    try:
        parts = list(r.partitions())
        planned = sum(read)
        for p in parts:
            for batch in r.read(p):
                rows += batch.to_pylist()
    finally:
        mcap.Ranges.__exit__ = made
    return rows, planned, sum(read) - planned, parts


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    """Chunks of joints and chunks of images in turn; images make up nearly all bytes."""
    path = tmp_path_factory.mktemp("logs") / "big.mcap"
    rng = np.random.default_rng(0)
    with path.open("wb") as f:
        log = mcap.LogFile(f, "none", 1 << 20)
        joint = log.channel("/joint", "json", "sensor_msgs/msg/JointState")
        cam = log.channel("/cam", "cdr", "sensor_msgs/msg/Image")
        for k in range(40):
            for j in range(10):
                log.message(joint, (k * 10 + j) * 10**6, json.dumps({"position": [k, j]}).encode())
            log._close()
            log.message(cam, k * 10**7 + 5, rng.bytes(200_000))
            log._close()
        log.attach("robot.urdf", "application/xml", b"<robot/>")
        log.finish()
    return path


def test_only_wanted_chunks_are_read(big):
    size = os.path.getsize(big)
    rows, planned, read, parts = taken(reader(big, topics='["/joint"]'))
    assert len(rows) == 400 and {r["topic"] for r in rows} == {"/joint"}
    assert planned <= 2 * mcap.TAIL and read < size / 100
    rows, _, read, _ = taken(reader(big, topics='["/joint"]', start_ns=100 * 10**6, end_ns=109 * 10**6))
    assert [r["ts_ns"] for r in rows] == [k * 10**6 for k in range(100, 110)] and read < 2000
    rows, _, read, parts = taken(reader(big, group_bytes=500_000))
    assert len(rows) == 440 and len(parts) > 10 and read < size


def test_channels_come_from_the_summary(big, spark):
    rows, _, read, _ = taken(reader(big, "channels"))
    assert read < 2 * mcap.TAIL
    assert [tuple(r.values())[1:] for r in rows] == [("/joint", "sensor_msgs/msg/JointState", "json", 400, 0, 399 * 10**6), ("/cam", "sensor_msgs/msg/Image", "cdr", 40, 5, 39 * 10**7 + 5)]
    got = mcap.read(spark, str(big), "attachments").collect()
    assert [(r["name"], r["media_type"], bytes(r["data"])) for r in got] == [("robot.urdf", "application/xml", b"<robot/>")]


def test_filters_are_taken_over(big, spark):
    df = mcap.read(spark, str(big)).where("topic = '/joint' and ts_ns >= 5000000 and ts_ns < 9000000")
    assert sorted(r["ts_ns"] for r in df.collect()) == [5 * 10**6, 6 * 10**6, 7 * 10**6, 8 * 10**6]
    r = reader(big)
    left = list(r.pushFilters([ds.EqualTo(("topic",), "/joint"), ds.In(("topic",), ("/joint", "/x")), ds.GreaterThan(("ts_ns",), 3), ds.LessThanOrEqual(("ts_ns",), 9), ds.IsNotNull(("topic",)), ds.EqualTo(("encoding",), "json")]))
    assert r.topics == {"/joint"} and (r.low, r.high) == (4, 9) and len(left) == 1
    assert mcap.read(spark, str(big)).where("topic = 'none'").count() == 0
    assert mcap.read(spark, str(big)).where("encoding = 'cdr' and topic in ('/joint', '/cam')").count() == 40


@pytest.mark.parametrize("compression", ["zstd", "lz4", "none"])
@pytest.mark.parametrize("cut", ["whole", "no summary", "truncated"])
def test_files_without_a_summary(tmp_path, compression, cut):
    path = tmp_path / "a.mcap"
    with path.open("wb") as f:
        log = mcap.LogFile(f, compression, 300)
        c = log.channel("/a", "json", "x", "jsonschema", b"{}")
        d = log.channel("/b", "json")
        for k in range(50):
            log.message(c if k % 3 else d, 1000 - k, json.dumps({"data": k}).encode())
        log.attach("n", "m", b"zz", 3, 4)
        log.finish()
    raw = path.read_bytes()
    if cut == "no summary":
        end = raw.rindex(bytes([mcap.DATA_END]) + struct.pack("<Q", 4))
        path.write_bytes(raw[: end + 13] + bytes([mcap.FOOTER]) + struct.pack("<QQQI", 20, 0, 0, 0) + mcap.MAGIC)
    elif cut == "truncated":
        path.write_bytes(raw[: raw.rindex(bytes([mcap.DATA_END]) + struct.pack("<Q", 4)) + 5])
    rows, *_ = taken(reader(path, "fields", topics='["/a"]'))
    assert [r["value"] for r in rows] == [[float(k)] for k in range(50) if k % 3]
    channels, *_ = taken(reader(path, "channels"))
    assert [tuple(c.values())[1:] for c in channels] == [("/a", "x", "json", 33, 951, 999), ("/b", "", "json", 17, 952, 1000)]
    found, *_ = taken(reader(path, "attachments"))
    assert [tuple(a.values())[1:] for a in found] == [("n", "m", 3, 4, b"zz")]


def test_large_records_in_a_stream(tmp_path):
    """Files are walked a step at a time, records longer than a step too."""
    path = tmp_path / "a.mcap"
    path.write_bytes(records.write_mcap([("/a", k, bytes([k]) * (k * 40)) for k in range(60)]))
    with mcap.Ranges(str(path)) as file:
        got = [rec[22:] for op, _, rec in mcap.stream_records(file, 64) if op == mcap.MESSAGE]
    assert got == [bytes([k]) * (k * 40) for k in range(60)]
    with pytest.raises(ValueError, match="not an MCAP"):
        (tmp_path / "b.mcap").write_bytes(b"nothing of the kind")
        with mcap.Ranges(str(tmp_path / "b.mcap")) as file:
            list(mcap.stream_records(file))


def test_edges_of_overlapping_chunks(tmp_path):
    path = tmp_path / "a.mcap"
    rng = np.random.default_rng(1)
    times = rng.integers(0, 10_000, 400)
    with path.open("wb") as f:
        log = mcap.LogFile(f, "zstd", 400)
        ids = [log.channel(f"/{k}", "json") for k in range(3)]
        for t, k in zip(times.tolist(), rng.integers(0, 3, 400).tolist()):
            log.message(ids[k], t, b"{}")
        log.finish()
    rows, *_ = taken(reader(path, "channels"))
    slow, *_ = taken(reader(path))
    for c in rows:
        mine = [r["ts_ns"] for r in slow if r["topic"] == c["topic"]]
        assert (c["n_messages"], c["start_ns"], c["end_ns"]) == (len(mine), min(mine), max(mine))


def test_a_message_is_decoded_once(tmp_path, monkeypatch):
    path = tmp_path / "a.mcap"
    path.write_bytes(records.write_mcap([("/j", k, json.dumps({"position": [k, 1.25], "velocity": [k]}).encode()) for k in range(9)]))
    n = []
    monkeypatch.setattr(wire, "decode", lambda how, raw: (n.append(1), how(raw))[1])
    rows, *_ = taken(reader(path, "fields", parts=json.dumps({"/j": [["position", None], ["velocity", None], ["position", "i4"]]})))
    assert len(n) == 9 and [r["value"] for r in rows[:3]] == [[0.0, 1.25], [0.0], [0.0, 1.0]] and {r["part"] for r in rows} == {0, 1, 2}


def test_written_logs(spark, tmp_path):
    rows = [(f"/t{k % 3}", 10**9 + k, json.dumps({"data": k}).encode(), "json", "s", "jsonschema", b"{}") for k in range(300)]
    df = spark.createDataFrame(rows, "topic string, ts_ns long, data binary, encoding string, schema_name string, schema_encoding string, schema binary").repartition(3)
    (tmp_path / "cal.json").write_text("{}")
    out = str(tmp_path / "out")
    mcap.write(df, out, chunk_bytes=500, attachments=[{"name": "cal.json", "path": str(tmp_path / "cal.json")}])
    files = sorted(os.listdir(out))
    assert len(files) == 3 and all(f.endswith(".mcap") for f in files)
    got = mcap.read(spark, out, "fields").select("topic", "ts_ns", F.col("value")[0].alias("v")).collect()
    assert sorted((r["v"], r["topic"], r["ts_ns"]) for r in got) == [(float(k), f"/t{k % 3}", 10**9 + k) for k in range(300)]
    assert {(r["name"], r["media_type"], bytes(r["data"])) for r in mcap.read(spark, out, "attachments").collect()} == {("cal.json", "application/json", b"{}")}
    mcap.write(df.limit(5), out, "overwrite")
    assert mcap.read(spark, out).count() == 5
    mcap.write(df.limit(7).coalesce(1), out)
    assert mcap.read(spark, out).count() == 12
    with pytest.raises(Exception, match="topic"):
        mcap.write(df.drop("topic"), out)


def test_nothing_of_a_failed_write_is_read(spark, tmp_path):
    """A task that is being killed may still write to the job's hidden folder, which no reader looks into."""
    out = str(tmp_path / "out")
    df = spark.range(0, 40, 1, 4).select(F.lit("/a").alias("topic"), F.when(F.col("id") == 35, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("ts_ns"), F.lit(b"{}").alias("data"))
    with pytest.raises(Exception, match="stop"):
        mcap.write(df, out)
    assert not os.path.exists(out) or mcap.list_logs(out) == [] and all(f.startswith("_mcap-") for f in os.listdir(out))
    mcap.write(spark.range(30).select(F.lit("/a").alias("topic"), F.col("id").alias("ts_ns"), F.lit(b"{}").alias("data")), out)
    assert mcap.read(spark, out).count() == 30


def test_tasks_that_ran_twice_leave_one_file(tmp_path):
    import pyarrow as pa

    schema = StructType.fromDDL("topic string, ts_ns long, data binary")
    w = mcap.McapWriter({"path": str(tmp_path / "o")}, schema, False)
    batch = pa.RecordBatch.from_pydict({"topic": ["/a"], "ts_ns": [1], "data": [b"{}"]})
    w.write(iter([batch]))  # an attempt whose result is lost
    kept = w.write(iter([batch]))
    w.commit([kept, w.write(iter([]))])
    assert len(os.listdir(tmp_path / "o")) == 1
    assert len(taken(reader(tmp_path / "o"))[0]) == 1


def test_episodes_written_and_read_back(spark, tmp_path):
    rows = [(f"e{e}", k, k / 20.0, [float(k), e + 0.5] if k % 4 else None, [k * 2.0]) for e in range(5) for k in range(8)]
    frames = spark.createDataFrame(rows, "episode_id string, frame_index long, timestamp double, action array<double>, state array<double>").repartition(3)
    episodes = spark.createDataFrame([(f"e{e}", f"task {e}" if e else None) for e in range(5)], "episode_id string, language_instruction string")
    out = str(tmp_path / "set")
    messages.write_episodes(frames, episodes, out)
    got, said = datasets.open_dataset(spark, out)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((f"ep_{int(r[0][1:]):04d}", *r[1:]) for r in rows), key=key)
    assert dict(map(tuple, said.collect())) == {f"ep_{e:04d}": f"task {e}" if e else None for e in range(5)}
    topics = {r["topic"]: r["schema_name"] for r in mcap.read(spark, out, "channels").collect()}
    assert topics["/action/ep_0003"] == "sensor_msgs/JointState" and topics["/task/ep_0001"] == "std_msgs/String" and "/task/ep_0000" not in topics
    with pytest.raises(Exception, match="no time"):
        messages.write_episodes(frames.withColumn("timestamp", F.lit(None).cast("double")), None, str(tmp_path / "bad"))
    back = str(tmp_path / "back")
    datasets.convert(spark, out, back, "mcap")
    assert datasets.open_dataset(spark, back)[0].count() == 40


def test_fields_of_a_topic_with_types_and_shapes(spark, tmp_path):
    rows = [("/j", k * 10**7, json.dumps({"position": [k + 0.7, 2], "velocity": [k] * (1 if k == 3 else 2)}).encode()) for k in range(6)]
    (tmp_path / "a.mcap").write_bytes(records.write_mcap(rows))
    config = messages.load_config({"fields": {"observation.state": {"topic": "/j", "field": "position", "dtype": "int32"}, "action": {"topic": "/j", "field": "velocity", "target_shape": [2]}}, "sync": {"primary": "action"}, "attachments": [{"name": "a.urdf"}]})
    got = messages.read_episodes(spark, f"file://{tmp_path}/a.mcap", config)[0].orderBy("frame_index").collect()
    assert [r["state"] for r in got] == [[float(k), 2.0] for k in (0, 1, 2, 4, 5)] and [r["action"] for r in got] == [[float(k)] * 2 for k in (0, 1, 2, 4, 5)]
    assert config.attachments == [{"name": "a.urdf"}]
    for bad, place in (({"fields": {"a": {"topic": "/j", "dtype": "float99"}}}, "fields.a.dtype"), ({"fields": {"a": {"topic": "/j", "target_shape": ["x"]}}}, "fields.a.target_shape"), ({"attachments": [{}]}, "attachments")):
        with pytest.raises(ValueError, match=place):
            messages.load_config(bad)


def test_images_of_logs(spark, tmp_path):
    raw = b"\0\1\0\0" + struct.pack("<iII", 0, 0, 1) + b"\0\0\0\0" + struct.pack("<III", 2, 1, 6) + b"mono8\0" + b"\0\0" + struct.pack("<I", 1) + struct.pack("<I", 2) + b"\7\11"
    with (tmp_path / "a.mcap").open("wb") as f:
        log = mcap.LogFile(f)
        c = log.channel("/cam", "cdr", "sensor_msgs/msg/Image", "ros2msg", wire.ros_text("sensor_msgs/Image").encode())
        log.message(c, 5, raw)
        log.message(c, 6, raw[:20])
        log.finish()
    got = messages.read_images(spark, f"file://{tmp_path}", ["/cam"]).collect()
    assert [(r["ts_ns"], r["height"], r["width"], r["encoding"], r["format"], bytes(r["data"])) for r in got] == [(5, 2, 1, "mono8", "raw", b"\7\11")]
