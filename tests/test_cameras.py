"""The stream's figures of each camera against those of the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import video
from tidewheel.streaming import cameras

KIND = "episode_id string, camera string, frame_index long, timestamp double, outcome string, sharpness double, brightness double, shadow_fraction double, highlight_fraction double, colourfulness double, frozen boolean, height int, width int"


def frames(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for e in ("e1", "e2"):
        for c in ("top", "wrist"):
            t = 0.0
            for i in range(120):
                t += float(rng.choice([1 / 30, 1 / 30, 1 / 30, 0.06, 0.3]))
                o = str(rng.choice(["decoded"] * 8 + ["missing", "decode_failure", "invalid", "stride"]))
                frozen = None if i == 0 else bool(rng.random() < 0.6)
                m = [None if rng.random() < 0.1 else float(x) for x in (rng.uniform(0, 300), rng.uniform(0, 90), rng.uniform(0, 0.4), rng.uniform(0, 0.4), rng.uniform(0, 60))]
                size = (240, 320) if i < 50 or c == "top" else (480, 640)
                rows.append((e, c, i, None if c == "wrist" and i % 31 == 7 else t, o, *m, frozen, *size))
    rows += [("e3", "only", i, None, "missing", *[None] * 8) for i in range(3)]
    return rows


def run(spark, tmp_path, parts, **settings):
    """Each part is a micro-batch; the last one is a frame of another episode, far ahead."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = KIND + ", event_time timestamp"
    src, name = f"{tmp_path}/in", f"cams_{abs(hash(str(tmp_path)))}"
    ahead = [("zz", "zz", 0, 0.0, "decoded", *[1.0] * 5, False, 1, 1, 10_000.0), ("zz", "zz", 1, 0.1, "decoded", *[1.0] * 5, False, 1, 1, 20_000.0)]
    for part in [*parts, ahead[:1], ahead[1:]]:
        df = spark.createDataFrame(part, KIND + ", at double").withColumn("event_time", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    query = cameras.camera_quality(stream, 30.0, **settings).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return {(r["episode_id"], r["camera"]): r.asDict() for r in spark.table(name).where("episode_id <> 'zz'").collect()}


def with_times(rows):
    return [(*r, 1000 + r[2] / 30.0) for r in rows]


def test_shuffled_micro_batches_equal_the_table(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = with_times(frames())
    rng = np.random.default_rng(1)
    # a frame comes up to two seconds out of order
    order = np.argsort([r[-1] + rng.uniform(0, 2) for r in rows])
    parts = [[rows[k] for k in some] for some in np.array_split(order, 5)]
    got = run(spark, tmp_path, parts, late_seconds=3.0, quiet_seconds=20.0)
    want = {(r["episode_id"], r["camera"]): r.asDict() for r in video.camera_quality(spark.createDataFrame(frames(), KIND), 30.0).collect()}
    assert set(got) == set(want)
    for key, r in want.items():
        for name, v in r.items():
            assert got[key][name] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v), (key, name)
        assert got[key]["n_late"] == 0
    assert got["e1", "wrist"]["resolution_changes"] == 1 and got["e1", "top"]["resolution_changes"] == 0


def test_late_and_repeated_frames_are_counted(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [r for r in with_times(frames()) if r[:2] == ("e1", "top")]
    late, rest = rows[10], rows[:10] + rows[11:]
    got = run(spark, tmp_path, [rest[:60], [rest[20]], rest[60:], [late]], late_seconds=0.5, quiet_seconds=20.0)
    want = video.camera_quality(spark.createDataFrame([r[:-1] for r in rest], KIND), 30.0).first().asDict()
    row = got["e1", "top"]
    assert row["n_late"] == 2 and row["expected_frames"] == 119
    assert all(row[n] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v) for n, v in want.items())


def test_figures_are_kept_small():
    f = cameras.Figures(None, 30.0)
    for i in range(1000):
        f.add(i, {"timestamp": i / 30, "outcome": "decoded", "frozen": i % 5 > 0, "height": 1, "width": 1} | dict.fromkeys(cameras.MEASURES, 1.0))
    again = cameras.Figures(f.values(), 30.0)
    assert again.row() == f.row() and again.row()["longest_frozen_run"] == 4 and len(f.values()) < 60
