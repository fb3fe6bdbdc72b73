import json

from pyspark.sql import functions as F

from tidewheel.operators.numbering import number_rows
from tidewheel.sources import lerobot, rlds

FRAMES = "episode_id string, frame_index long, action array<double>, state array<double>"


def test_masked_checksum():
    # CRC-32C of "123456789" is 0xE3069283 by its definition
    crc = 0xE3069283
    assert rlds.masked_crc32c(b"123456789") == ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(f"e{e:02d}", i, None if (e, i) == (3, 1) else [i + 0.5, -e * 1.0], None if e == 5 else [float(e)]) for e in range(23) for i in range(2 + e % 3)]
    frames = spark.createDataFrame(rows, FRAMES).repartition(3)
    texts = spark.createDataFrame([("e00", "lift")], "episode_id string, language_instruction string")
    done = rlds.write(frames, texts, root, "arm", 10.0).orderBy("shard").collect()
    assert [(r["shard"], r["n_episodes"]) for r in done] == [(0, 10), (1, 10), (2, 3)] and sum(r["n_frames"] for r in done) == len(rows)
    folder = tmp_path / "arm/1.0.0"
    assert sorted(p.name for p in folder.glob("*.tfrecord*")) == [f"arm-train.tfrecord-{k:05d}-of-00003" for k in range(3)]
    assert json.loads((folder / "dataset_info.json").read_text())["splits"][0]["shardLengths"] == ["10", "10", "3"]
    assert lerobot.detect_format(spark, f"{root}/arm/1.0.0") == "rlds"
    back = rlds.read_frames(spark, root, 10.0).withColumn("e", F.regexp_extract("path", r"-(\d{5})-of", 1).cast("int") * 10 + F.col("record")).orderBy("e", "frame_index").collect()
    want = [(int(e[1:]), i, a or [0.0, 0.0], s) for e, i, a, s in rows]
    assert [(r["e"], r["frame_index"], r["action"], r["state"]) for r in back] == want
    assert back[1]["timestamp"] == 0.1 and back[0]["reward"] == 0.0 and [r["language_instruction"] for r in back[:3]] == ["lift", "lift", ""]


def test_nothing_to_write(spark, tmp_path):
    empty = spark.createDataFrame([], FRAMES)
    assert rlds.write(empty, spark.createDataFrame([], "episode_id string, language_instruction string"), f"file://{tmp_path}").count() == 0


def test_state_keys_and_missing_parts():
    got = list(rlds.episode_steps({"steps/is_first": [1, 0], "steps/proprio": [1.0, 2.0], "steps/observation/robot_state": [9.0, 9.0]}, 10.0))
    assert got == [(0, 0.0, None, [1.0], 0.0, None), (1, 0.1, None, [2.0], 0.0, None)]
    assert list(rlds.episode_steps({"steps/action": [1.0]}, 10.0)) == []


def test_number_rows(spark):
    rows = spark.createDataFrame([(f"k{i:03d}", i % 4) for i in range(100)] + [(None, 9)], "k string, n long").repartition(7)
    got = number_rows(rows, "k", "i", F.col("n")).orderBy("k").collect()
    assert [(r["k"], r["i"], r["_base"]) for r in got] == [(f"k{i:03d}", i, sum(j % 4 for j in range(i))) for i in range(100)]
    assert number_rows(rows.limit(0), "k", "i").columns == ["k", "n", "i"]
