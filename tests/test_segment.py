"""Signals by name, phases of segments without a range join, analyses that a filter needs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import curation, segment, video


def test_signals_by_name(spark):
    rows = [("a", 0, [1.0], None, None), ("a", 1, None, [2.0], [9.0]), ("a", 2, None, None, [8.0])]
    x = spark.createDataFrame(rows, "episode_id string, frame_index long, state array<double>, joint_positions array<double>, action array<double>")
    take = lambda name: [r["signal"] for r in segment.with_signal(x, name).orderBy("frame_index").collect()]
    assert take("observation.state") == take("state") == [[1.0], [2.0], None]
    assert take("qpos") == [None, [2.0], None] and take("action") == [None, [9.0], [8.0]]
    for bad in ("joint_velocities", "speed"):
        with pytest.raises(ValueError, match=bad):
            segment.with_signal(x, bad)


def test_phases_against_plain_loops(spark):
    rng = np.random.default_rng(0)
    rows, spans, want = [], [], {}
    for e in ("a", "b"):
        q, g = np.cumsum(rng.normal(0, 1, (90, 2)), 0), rng.random(90)
        rows += [(e, i, q[i].tolist(), float(g[i])) for i in range(90)]
        v = np.append(0, np.linalg.norm(np.diff(q, axis=0), axis=1))
        for k, (s, t) in enumerate(((0, 20), (20, 21), (30, 88))):  # one gap, one end left out
            spans.append((e, k, s, t))
            want[e, k] = (v[s:t].mean(), v[s:t].std())
    frames = spark.createDataFrame(rows, "episode_id string, frame_index long, state array<double>, grip double").repartition(3)
    segments = spark.createDataFrame(spans, "episode_id string, segment long, start long, end long")
    for gripper in (None, "grip"):
        got = segment.label_phases(frames, segments, gripper=gripper).collect()
        assert {(r["episode_id"], r["segment"]): pytest.approx((r["mean_speed"], r["speed_std"])) for r in got} == want
        assert all(r["label"] for r in got) and {(r["segment"], r["start"], r["end"]) for r in got} == {s[1:] for s in spans}


def test_a_filter_runs_only_what_it_needs(spark):
    episodes = spark.createDataFrame([("a",), ("b",), ("c",)], "episode_id string")
    ran = []

    def make(name, rows, schema):
        return lambda: (ran.append(name), spark.createDataFrame(rows, schema))[1]

    analyses = {"pixels": (("blurry_fraction",), make("pixels", [("a", 0.1), ("b", 0.9)], "episode_id string, blurry_fraction double")), "motion": (("mean_motion",), make("motion", [("a", 0.0)], "episode_id string, mean_motion double"))}
    kept = lambda rules, scores=None: {r["episode_id"] for r in curation.filter_with_analyses(episodes, scores, rules, analyses).where("kept").collect()}
    assert kept(curation.FilterRules(exclude=["c"])) == {"a", "b"} and ran == []
    assert kept(curation.FilterRules(video={"blurry_fraction": (None, 0.5)})) == {"a", "c"} and ran == ["pixels"]
    assert kept(curation.FilterRules(video={"mean_motion": (0.05, None), "blurry_fraction": (None, 0.5)})) == {"c"} and ran == ["pixels", "motion", "pixels"]


def test_changes_of_size(spark):
    sizes = [(1, 1), (1, 1), (2, 1), None, (2, 1), (1, 1)]
    rows = [("e", "c", i, i / 30, "missing" if s is None else "decoded", *(s or (9, 9))) for i, s in enumerate(sizes)]
    x = spark.createDataFrame(rows, "episode_id string, camera string, frame_index long, timestamp double, outcome string, height int, width int")
    for n in ("sharpness", "brightness", "shadow_fraction", "highlight_fraction", "colourfulness"):
        x = x.withColumn(n, F.lit(200.0))
    r = video.camera_quality(x.withColumn("frozen", F.lit(False)), 30.0).first()
    assert r["resolution_changes"] == 2 and "video_resolution_change" in r["flags"]
