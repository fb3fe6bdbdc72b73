import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import action_tokens, curation, inspect, sampling
from tidewheel.sources import lerobot

FRAMES = "episode_id string, frame_index long, timestamp double, state array<double>, action array<double>, reward double, is_last boolean"


def frames(spark, states, actions, times=None, name="e", rewards=None):
    n = len(states)
    rows = [(name, i, float(times[i]) if times is not None else i / 30, [float(v) for v in states[i]], [float(v) for v in actions[i]], None if rewards is None else rewards[i], i == n - 1) for i in range(n)]
    return spark.createDataFrame(rows, FRAMES)


@pytest.mark.parametrize(("step", "want"), [(1 / 30, 30.0), (1 / 29, 30.0), (0.1, 10.0), (0.2, 5.0), (1 / 100, 100.0)])
def test_frame_rate(spark, step, want):
    t = np.arange(40) * step
    t[20:] += 3  # a pause is no step
    assert inspect.frame_rate(frames(spark, np.zeros((40, 2)), np.zeros((40, 2)), t)).first()["fps"] == pytest.approx(want)
    back = frames(spark, np.zeros((5, 2)), np.zeros((5, 2)), -np.arange(5.0))
    assert inspect.frame_rate(back).first()["fps"] is None


def test_signals(spark):
    t = np.arange(60) / 30
    joints = np.stack([np.sin(t * k) * 2 for k in range(1, 7)], 1)
    open_ = (np.arange(60) // 20 % 2)[:, None].astype(float)
    arm = np.hstack([joints, open_])
    assert inspect.signals(frames(spark, arm, arm)) == inspect.Signals(6, "absolute", {"gripper": (6, 7)})
    wide = np.hstack([joints, joints, open_ * 0.9])
    assert inspect.signals(frames(spark, wide, wide * 0.001)).parts == {"gripper": (12, 13), "joint_positions": (0, 6), "joint_velocities": (6, 12)}
    assert inspect.signals(frames(spark, wide, wide * 0.001)).action_type == "delta"
    assert inspect.signals(frames(spark, joints * 0.1, np.random.default_rng(0).normal(0, 2, joints.shape))).action_type == "velocity"
    assert inspect.signals(frames(spark, arm[:4], arm[:4])) == inspect.Signals(None, "unknown", {})
    middle = np.hstack([joints[:, :2], (np.arange(60) > 30)[:, None] * 1.0, joints[:, :1] * 3])
    assert inspect.signals(frames(spark, middle, middle)).gripper == 2
    assert [inspect.camera_type(*x) for x in (("observation.images.Wrist", 3), ("top_view", 3), ("front", 3), ("cam", 1), ("cam", 3), ("side_depth", 3))] == ["wrist", "overhead", "front", "depth", "rgb", "side"]


def test_success_and_collected(spark):
    z = np.zeros((4, 2))
    x = frames(spark, z, z, name="won", rewards=[0.0, 0.0, 0.0, 1.0]).union(frames(spark, z, z, name="lost", rewards=[0.0, 0.0, 0.0, -1.0])).union(frames(spark, z, z, name="sum", rewards=[0.3, 0.3, 0.3, None])).union(frames(spark, z, z, name="none"))
    got = {r["episode_id"]: r["success"] for r in inspect.success(x).collect()}
    assert got == {"won": True, "lost": False, "sum": True, "none": None}
    said = spark.createDataFrame([("won", "go"), ("lost", " "), ("sum", None)], "episode_id string, language_instruction string")
    cams = spark.createDataFrame([("won", "a"), ("lost", "a"), ("sum", "a"), ("none", "b")], "episode_id string, name string")
    r = inspect.collected_stats(x, said, cams).first()
    assert (r["n_episodes"], r["n_frames"], r["language_coverage"], r["success_coverage"], r["reward_coverage"]) == (4, 16, 0.25, 0.75, 0.75)
    assert r["consistent_state"] and not r["consistent_cameras"]
    report = inspect.report(x, said)
    assert report["fps"] == 30.0 and report["missing"] == ["robot_type"] and report["sample_language"] == "go"
    half = x.withColumn("gripper_state", F.when(F.col("episode_id") != "won", 1.0)).withColumn("action_gripper", F.lit(0.5))
    assert {r[0]: r[1] for r in inspect.gripper_source(half).collect()}["won"] == "action_gripper"


def test_samples(spark):
    x = spark.createDataFrame([(f"e{k}", i) for k, n in enumerate((5, 100, 3)) for i in range(n)], "episode_id string, frame_index long")
    assert inspect.first_episodes(x, 2, 4).groupBy("episode_id").count().orderBy("episode_id").collect() == [("e0", 4), ("e1", 4)]
    for n, total in ((7, 100), (10, 5), (1, 3), (3, 3)):
        key = {100: "e1", 5: "e0", 3: "e2"}[total]
        got = sorted(r["frame_index"] for r in inspect.every(x, ["episode_id"], n, ["frame_index"]).where(F.col("episode_id") == key).collect())
        assert got == (list(range(total)) if n >= total else np.linspace(0, total - 1, n).astype(int).tolist())
    many = spark.createDataFrame([("e", i) for i in range(1000)], "episode_id string, frame_index long")
    stride = list(range(0, 1000, 10))
    want = [stride[i] for i in dict.fromkeys(np.linspace(0, 99, 32).round().astype(int).tolist())]
    assert sorted(r["frame_index"] for r in sampling.sampled_frames(many, 10.0).collect()) == want
    assert sampling.sampled_frames(many.limit(20), None).count() == 20
    v = np.arange(12.0).reshape(6, 2)
    assert sampling.pool(v).tolist() == v.mean(0).tolist() and sampling.pool(v, "first-mid-last").tolist() == pytest.approx(v[[0, 3, 5]].mean(0).tolist())
    with pytest.raises(ValueError):
        sampling.pool(v[:0])
    with pytest.raises(ValueError, match="no such model"):
        sampling.model("nothing")


def test_lint_codes(spark):
    cams = spark.createDataFrame([("a", "observation.images.cam", 640, 480), ("a", "wrist", 320, 240), ("b", "wrist", 640, 480)], "episode_id string, name string, width int, height int")
    everyone = spark.createDataFrame([("a", "go there"), ("b", None), ("c", "")], "episode_id string, language_instruction string")
    got = {(r["episode_id"], r["code"]) for r in curation.lint_cameras(cams, everyone).collect()}
    assert got == {("a", "camera.ambiguous_name"), ("a", "camera.low_resolution"), ("b", "camera.too_few_views"), ("c", "camera.none"), (None, "camera.inconsistent_keys")}
    x = frames(spark, np.zeros((4, 2)), np.zeros((4, 2)))
    assert [r["code"] for r in curation.lint_dataset(x, episodes=everyone).collect()] == ["task.partial_coverage"]
    assert [r["code"] for r in curation.lint_dataset(x, episodes=everyone.where("episode_id = 'b'")).collect()] == ["task.missing"]
    rules = curation.FilterRules(video={"min_sharpness": (1.0, None), "mean_motion": (None, None)})
    assert curation.analysis_needed(rules, {"pixels": ("min_sharpness",), "motion": ("mean_motion",)}) == {"pixels"}


def test_tokens_are_compared_and_written(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = frames(spark, rng.normal(0, 1, (50, 2)), rng.normal(0, 1, (50, 3)))
    rows = {r["strategy"]: r for r in action_tokens.compare(x, bins=64).collect()}
    assert sum(r["best"] for r in rows.values()) == 1 and min(rows.values(), key=lambda r: r["mae"])["best"]
    a = np.array([r["action"] for r in x.orderBy("frame_index").collect()])
    lo, hi = a.min(0), a.max(0)
    k = np.clip(np.floor((a - lo) / (hi - lo) * 64), 0, 63)
    e = lo + (k + 0.5) * (hi - lo) / 64 - a
    assert rows["uniform-bins"]["dim_rmse"] == pytest.approx(np.sqrt((e**2).mean(0)).tolist()) and rows["uniform-bins"]["mse"] == pytest.approx((e**2).mean())
    assert rows["uniform-bins"]["vocab_used"] == pytest.approx(len(np.unique(k)) / 64) and rows["uniform-bins"]["tokens_per_step"] == 3
    t = action_tokens.fit(x, "uniform-bins", bins=64)
    said = spark.createDataFrame([("e", "go")], "episode_id string, language_instruction string")
    for keep in (False, True):
        root = f"file://{tmp_path}/{keep}"
        lerobot.write_v3(action_tokens.with_tokens(x, t, keep_actions=keep), said, root, 30.0)
        back = spark.read.parquet(f"{root}/data")
        assert ("action" in back.columns) == keep and dict(back.dtypes)["action_tokens"] == "array<bigint>"
        assert [r["action_tokens"] for r in back.orderBy("frame_index").collect()] == k.astype(int).tolist()
        assert lerobot.info(spark, root)["features"]["action_tokens"]["dtype"] == "int64"
    assert lerobot.read_episodes(spark, root).first()["language_instruction"] == "go"
    with pytest.raises(ValueError):
        action_tokens.strategy("mulaw")(None)
    with pytest.raises(ValueError, match="no such strategy"):
        action_tokens.fit(x, "nothing")
