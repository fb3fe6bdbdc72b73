import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import action_tokens, curation, diagnostics, images, kernels, quality, segment, temporal
from tidewheel.operators.components import connected_components

FRAMES = "episode_id string, frame_index long, timestamp double, state array<double>, action array<double>"


def frames(spark, episodes, fps=30.0):
    rows = [(k, i, i / fps, [float(v) for v in s], [float(v) for v in a]) for k, (states, actions) in episodes.items() for i, (s, a) in enumerate(zip(states, actions))]
    return spark.createDataFrame(rows, FRAMES)


def one(df, **where):
    rows = [r for r in df.collect() if all(r[k] == v for k, v in where.items())]
    assert len(rows) == 1
    return rows[0]


SOURCE = [(0, [0.0]), (100, [100.0]), (200, [200.0]), (300, [300.0]), (400, [400.0])]


@pytest.mark.parametrize(
    ("method", "at", "value", "skew"),
    [("nearest", 150, 100.0, 50), ("nearest", -50, 0.0, 50), ("nearest", 900, 400.0, 500), ("hold", 250, 200.0, 50), ("hold", -50, 0.0, 50), ("hold", 200, 200.0, 0), ("interpolate", 150, 150.0, 50), ("interpolate", 500, 400.0, 100), ("interpolate", 0, 0.0, 0)],
)
def test_align(spark, method, at, value, skew):
    source = spark.createDataFrame([("a", t, v) for t, v in SOURCE], "k string, ts long, value array<double>")
    got = temporal.align(spark.createDataFrame([("a", at)], "k string, ts long"), source, ["k"], method=method).first()
    assert got["value"] == [value] and got["skew"] == skew


def test_align_without_source(spark):
    source = spark.createDataFrame([], "k string, ts long, value double")
    assert temporal.align(spark.createDataFrame([("a", 1)], "k string, ts long"), source, ["k"]).first()["value"] is None


@pytest.mark.parametrize("method", temporal.METHODS)
def test_align_in_stretches(spark, method):
    """A hot key cut into stretches of time gives what it gives whole."""
    rng = np.random.default_rng(0)
    near = spark.createDataFrame([(k, int(t), n) for k, m in (("a", 900), ("b", 50), ("c", 3)) for n, t in enumerate(rng.integers(-500, 20000, m))], "k string, ts long, x long")
    source = spark.createDataFrame([(k, int(t), float(t % 97)) for k, m in (("a", 200), ("b", 40)) for t in rng.choice(15000, m, replace=False)], "k string, ts long, value double")
    whole, cut = (sorted(map(str, temporal.align(near, source, ["k"], method=method, hot_rows=n).collect())) for n in (None, 60))
    assert whole == cut and len(whole) == 953


def test_align_is_linear(spark):
    import time

    def seconds(n):
        near = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 10 + 3).alias("ts"))
        source = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 10).alias("ts"), F.col("id").cast("double").alias("value"))
        began = time.perf_counter()
        assert temporal.align(near, source, ["k"]).where("skew = 3 and source_ts = ts - 3").count() == n
        return time.perf_counter() - began

    seconds(1000)
    short, long = seconds(100_000), seconds(200_000)
    assert long < 4 * max(short, 0.5)


def test_splits(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 100, 2_500_000_000, 2_500_000_100)], "k string, ts long")
    assert [r["episode"] for r in temporal.split_time_gap(rows, ["k"], "ts", 2_000_000_000).orderBy("ts").collect()] == [0, 0, 1, 1]
    even = spark.createDataFrame([("a", t) for t in (0, 2_000_000_000)], "k string, ts long")
    assert temporal.split_time_gap(even, ["k"], "ts", 2_000_000_000).agg(F.max("episode")).first()[0] == 0
    rows = spark.createDataFrame([("a", t) for t in (0, 100, 200, 300)], "k string, ts long")
    marks = spark.createDataFrame([("a", t) for t in (0, 110, 120, 150, 900)], "k string, ts long")
    assert [r["episode"] for r in temporal.split_marker(rows, marks, ["k"], "ts").orderBy("ts").collect()] == [0, 0, 1, 1]
    assert temporal.post_filter(rows, ["k"], ["ts"], 1, 4).count() == 0
    assert temporal.post_filter(rows, ["k"], ["ts"], 1, 3).count() == 3


def test_smooth_beats_jerky(spark):
    t, rng = np.arange(150) / 30, np.random.RandomState(42)
    smooth, jerky = np.stack([np.sin(t), np.cos(t)], 1), rng.randn(150, 2)
    x = frames(spark, {"smooth": (smooth * 0.8 + 0.1, smooth), "jerky": (jerky, jerky), "dead": (np.full((150, 2), 0.5), np.zeros((150, 2)))})
    got = {r["episode_id"]: r for r in quality.episode_metrics(x, 30.0).collect()}
    assert got["smooth"]["ldlj"] > got["jerky"]["ldlj"] and got["dead"]["ldlj"] is None
    assert got["dead"]["dead_fraction"] == 1.0 and "dead_actions" in got["dead"]["flags"] and "mostly_static" in got["dead"]["flags"]
    assert got["smooth"]["overall_score"] > got["jerky"]["overall_score"] and got["dead"]["overall_score"] is None
    v = np.gradient(np.gradient(np.gradient(smooth * 0.8 + 0.1, 1 / 30, axis=0), 1 / 30, axis=0), 1 / 30, axis=0)
    peak, span = np.linalg.norm(np.gradient(smooth * 0.8 + 0.1, 1 / 30, axis=0), axis=1).max(), 149 / 30
    assert got["smooth"]["ldlj"] == pytest.approx(-math.log(span**3 / peak**2 * (v**2).sum() / 30), rel=1e-9)


def flat(spark, name, t, q, actions=None):
    rows = [(name, i, None if x is None else float(x), None if s is None else [float(v) for v in s], None if a is None else [float(v) for v in a]) for i, (x, s, a) in enumerate(zip(t, q if q is not None else [None] * len(t), q if actions is None else actions))]
    return spark.createDataFrame(rows, FRAMES)


def test_scores_abstain(spark):
    """Broken, short and irregular episodes get flags and no score."""
    t = np.arange(121) / 30
    q = np.stack([1 + 0.2 * t + 0.01 * np.sin(3 * t), 2 + 0.1 * t], 1)
    cases = {"good": (t, q), "reverse": (np.where(np.arange(121) == 20, t[19] - 1, t), q), "duplicate": (np.where(np.arange(121) == 20, t[19], t), q)}
    cases |= {"nan": (np.where(np.arange(121) == 20, np.nan, t), q), "gap": (np.where(np.arange(121) >= 60, t + 30, t), q), "short": (t[:3], q[:3]), "slow": (t * 2, q)}
    cases |= {"jitter": (t + 0.012 * (np.arange(121) % 2), q), "still": (t, np.ones_like(q)), "untimed": ([None] * 121, q)}
    x = None
    for name, (times, states) in cases.items():
        one_ = flat(spark, name, times, states)
        x = one_ if x is None else x.union(one_)
    holes = flat(spark, "hole", t, [None if i == 50 else s for i, s in enumerate(q)], q)
    broken = flat(spark, "bad action", t, q, [np.array([np.inf, 1.0]) if i == 50 else s for i, s in enumerate(q)])
    x = x.union(holes).union(broken).union(flat(spark, "no state", t, None, q))
    got = {r["episode_id"]: r for r in quality.episode_metrics(x, 30.0, spectra=True).collect()}
    assert got["good"]["status"] == "scored" and got["good"]["overall_score"] > 5 and got["good"]["sparc"] is not None
    assert all(got[k]["overall_score"] is None and got[k]["ldlj"] is None for k in got if k not in ("good", "untimed", "no state", "slow", "still"))
    flags = {k: set(r["flags"]) for k, r in got.items()}
    assert flags["reverse"] == flags["duplicate"] == {"invalid_timestamps"} and flags["nan"] == {"nan_in_timestamps"} and flags["short"] == set()
    assert flags["hole"] == {"nan_in_states"} and flags["bad action"] == {"nan_in_actions"}
    assert "timestamp_gaps" in flags["gap"] and "timestamp_jitter" in flags["jitter"] and "sample_rate_mismatch" in flags["slow"]
    assert got["still"]["overall_score"] is None and got["still"]["status"] == "no motion to judge" and got["still"]["static_fraction"] == pytest.approx(1.0)
    assert got["untimed"]["overall_score"] is not None and got["untimed"]["jitter_ratio"] is None
    assert got["no state"]["static_fraction"] is None and got["no state"]["ldlj"] is None and got["no state"]["joint_path_length"] is None
    assert got["gap"]["dead_fraction"] is not None and got["reverse"]["dead_fraction"] is None


def test_saturation_needs_limits(spark):
    t = np.arange(121) / 30
    q = np.stack([1 + 0.2 * t, 2 + 0.1 * t], 1)
    x = flat(spark, "a", t, q)
    r = one(quality.episode_metrics(x, 30.0))
    assert r["overall_saturation"] is None and r["observed_range_edge_fraction"] > 0 and "saturated" not in r["flags"]
    r = one(quality.episode_metrics(x, 30.0, limits=((0, 1), (0, 2))))
    assert r["overall_saturation"] > 0.9 and "saturated" in r["flags"] and r["observed_range_edge_fraction"] is None


def test_pauses_must_last(spark):
    q = np.array([[0.05 * (i // 4)] for i in range(121)])  # never still for half a second
    x = frames(spark, {"a": (q, q)})
    assert one(diagnostics.static_fraction(x, 30.0))["static_fraction"] == 0.0
    assert one(diagnostics.static_fraction(x, 30.0, 0.05))["static_fraction"] > 0.5


def test_tracking_stall(spark):
    t = np.arange(121) / 30
    state = np.minimum(t, 1.0)[:, None]  # stops after a second while the command goes on
    x = flat(spark, "a", t, state, t[:, None])
    figures, events = diagnostics.tracking(x, 30.0, [(0, 0)])
    event = one(events)
    assert event["kind"] == "tracking_stall_candidate" and event["start_time"] == pytest.approx(1.0667, abs=0.05) and event["end_time"] == pytest.approx(4.0)
    assert one(figures)["stall_fraction"] == pytest.approx((event["end_time"] - event["start_time"]) / 4.0)
    lagged = flat(spark, "a", t, 0.2 * np.maximum(t - 0.2, 0)[:, None], 0.2 * t[:, None])
    figures, events = diagnostics.tracking(lagged, 30.0, [(0, 0)], 0.2)
    assert one(figures)["tracking_p95"] < 0.01 and events.count() == 0
    gap = np.where(np.arange(121) >= 60, t + 30, t)
    figures, events = diagnostics.tracking(flat(spark, "a", gap, np.full((121, 1), 2.0), np.zeros((121, 1))), 30.0, [(0, 0)], 0.2)
    assert all(e["end_time"] - e["start_time"] < 3 for e in events.collect())
    assert "tracking_stall_candidate" in one(quality.episode_metrics(x, 30.0, tracking_pairs=[(0, 0)]))["flags"]
    assert diagnostics.columns_of([-1, 0], 3, "x") == [2, 0]
    for wrong in ([3], [0, -3], [True]):
        with pytest.raises(ValueError):
            diagnostics.columns_of(wrong, 3, "x")


def test_episode_metrics_of_odd_frames(spark):
    rows = [("one", 0, 0.0, [1.0, 2.0], [1.0, 0.0]), ("none", 0, 0.0, None, None), ("empty", 0, 0.0, [], [])]
    rows += [("gaps", i, i / 10, None if i in (4, 9) else [float(i * i % 7)], None if i == 6 else [float(i % 5), 1.0]) for i in range(15)]
    x = spark.createDataFrame(rows, FRAMES)
    got = quality.episode_metrics(x, 10.0)
    assert {r["episode_id"]: (r["overall_score"], r["flags"]) for r in got.collect()} == {"one": (None, []), "none": (None, []), "empty": (None, []), "gaps": (None, ["nan_in_actions", "nan_in_states"])}
    whole = frames(spark, {"whole": (np.arange(30)[:, None] ** 2 % 7, np.stack([np.arange(30) % 5, np.ones(30)], 1))}, 10.0)
    r = one(quality.episode_metrics(whole, 10.0))
    for part in (quality.dead_actions(whole), quality.ldlj(whole, 10.0), quality.timestamp_regularity(whole, 10.0), quality.action_saturation(whole), quality.action_entropy(whole), diagnostics.static_fraction(whole, 10.0)):
        alone = one(part).asDict()
        assert all(r[n] == pytest.approx(v) for n, v in alone.items())
    kept = np.array([float(i * i % 7) for i in range(15) if i not in (4, 9)])
    v = np.gradient(kept, 0.1)
    j = np.gradient(np.gradient(v, 0.1), 0.1)
    want = -math.log(1.2**3 / np.abs(v).max() ** 2 * (j**2).sum() / 10)
    assert one(quality.ldlj(x, 10.0), episode_id="gaps")["ldlj"] == pytest.approx(want)
    unrun = quality.episode_metrics(x, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert unrun.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("fps", [10, 30, 50])
def test_pause(spark, fps):
    n = 6 * fps
    q = np.array([[1 + 0.2 * min(i / fps, 2.0), 2 + 0.1 * min(i / fps, 2.0)] for i in range(n + 1)])
    x = frames(spark, {"a": (q, q)}, fps)
    assert diagnostics.static_fraction(x, fps).first()["static_fraction"] == pytest.approx(4 / 6)
    event = one(diagnostics.proprio_events(x, fps), kind="motion_pause")
    assert (event["start_time"], event["end_time"]) == pytest.approx((2.0, 6.0))


def test_reversals_and_tracking(spark):
    t = np.arange(121) / 30
    q = np.abs((t % 2) - 1)[:, None]
    x = frames(spark, {"a": (q, q)})
    assert one(diagnostics.direction_reversals(x, 30.0), dim=0)["n_reversals"] == 3
    assert one(diagnostics.tracking_error(x))["tracking_p95"] < 1e-9


def test_kernels():
    t = np.arange(300) / 60
    x = np.stack([np.sin(t), np.cos(t)], 1)
    noisy = x + np.random.default_rng(0).normal(0, 0.05, x.shape)
    assert kernels.sparc(x, 1 / 60) > kernels.sparc(noisy, 1 / 60) and kernels.sparc(np.zeros((9, 2)), 0.1) is None
    low, mid, high = kernels.psd_bands(np.sin(2 * np.pi * 12 * t)[:, None], 60)
    assert high > 0.9 and low + mid + high == pytest.approx(1) and kernels.psd_bands(x, 16) is None
    steps = np.repeat([0.0, 5.0, -3.0], 40)[:, None] + np.random.default_rng(1).normal(0, 0.1, (120, 1))
    for model in ("l2", "rbf", "l1"):
        assert kernels.pelt(steps, 3.0, 10, model) == [40, 80, 120]
    assert set(kernels.pelt(steps, 20.0, 10, "normal")) >= {40, 80, 120}
    waves = np.concatenate([np.sin(np.arange(80) * 0.3), np.sin(np.arange(80) * 1.7)])[:, None]
    assert any(abs(e - 80) <= 5 for e in kernels.pelt(waves, 0.5, 10, "ar")[:-1])
    assert kernels.neighbour_variance(np.arange(20.0)[:, None], np.ones((20, 1))) == 0.0 and kernels.neighbour_variance(x[:5], x[:5]) is None


@pytest.mark.parametrize(("n", "held"), [(2, 9), (5, 1), (40, 10), (301, 100), (600, 2_000_000)])
def test_middle_distance(n, held):
    x = np.random.default_rng(n).normal(0, 1, (n, 3)).round(1)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(n, 1)]
    assert kernels.middle_distance(x, held) == pytest.approx(np.median(d), abs=1e-9)


@pytest.mark.parametrize("model", ["rbf", "normal", "ar"])
def test_costs_against_direct_sums(model):
    x = np.random.default_rng(5).normal(0, 1, (60, 2)).cumsum(0)
    cost = kernels.COSTS[model](x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    gram = np.exp(-np.clip(d / np.median(d[np.triu_indices(60, 1)]), 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    for b in (20, 37, 60):
        starts = np.array([0, 4, 9])
        for a, got in zip(starts, cost(starts, b)):
            part = x[a:b]
            if model == "rbf":
                want = (b - a) - gram[a:b, a:b].sum() / (b - a)
            elif model == "normal":
                want = np.linalg.slogdet(np.cov(part.T) + 1e-6 * np.eye(2))[1] * (b - a)
            else:
                lags = np.array([np.concatenate([x[max(i, 4) - 4], x[max(i, 4) - 3], x[max(i, 4) - 2], x[max(i, 4) - 1], [1.0]]) for i in range(a, b)])
                want = np.linalg.lstsq(lags, part, rcond=None)[1].sum()
            assert got == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_pelt_is_optimal():
    """Against all segmentations of a short series."""
    x = np.random.default_rng(3).normal(0, 1, (14, 1))
    cost = lambda a, b: ((x[a:b] - x[a:b].mean(0)) ** 2).sum()

    def best(n):
        return min((cost(a, n) + 1.0 + (best(a)[0] if a else -1.0), (*(best(a)[1] if a else ()), n)) for a in [0, *range(3, n - 2)] if n - a >= 3)

    assert tuple(kernels.pelt(x, 1.0, 3, "l2")) == best(14)[1]


def test_segments_and_phases(spark):
    q = np.cumsum(np.repeat([0.001, 0.1, 0.001], 40))[:, None]
    x = frames(spark, {"a": (q, q), "b": (q[:3], q[:3])})
    found = segment.segment_episodes(x, model="l2")
    assert [r["end"] for r in found.where("episode_id = 'b'").collect()] == [3]
    assert found.where("episode_id = 'a'").count() >= 3
    pieces = spark.createDataFrame([("a", 0, 0, 40), ("a", 1, 40, 80), ("a", 2, 80, 120)], "episode_id string, segment long, start long, end long")
    assert [r["label"] for r in segment.label_phases(x, pieces).orderBy("segment").collect()][1] in ("moving", "fine_manipulation")
    s = segment.segment_summary(spark.createDataFrame([(e, k) for e, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4)) for k in range(n)], "episode_id string, segment int")).first()
    assert s["median_segments"] == 3 and s["total_changepoints"] == 6


@pytest.mark.parametrize("name", action_tokens.STRATEGIES)
def test_tokens_round_trip(spark, name):
    x = spark.createDataFrame([([float(v), float(-v * v)],) for v in np.linspace(-2, 2, 200)], "action array<double>")
    few, many = (action_tokens.compare(x, (name,), bins=b).first()["mae"] for b in (8, 64))
    assert many < few
    t = action_tokens.fit(x, name)
    assert action_tokens.Tokenizer.load(t.save()) == t
    assert x.select(t.encode(F.col("action")).alias("k")).where("array_min(k) < 0 or array_max(k) > 255").count() == 0


def test_filter_and_lint(spark):
    e = spark.createDataFrame([("a", "Task.", 9), ("b", "Pick up the red cube gently now", 2), ("c", None, 9)], "episode_id string, language_instruction string, num_frames int")
    s = spark.createDataFrame([("a", 3.0, ["jerky"]), ("b", None, [])], "episode_id string, overall_score double, flags array<string>")
    got = {r["episode_id"]: r["reasons"] for r in curation.filter_episodes(e, s, curation.FilterRules(min_quality=5.0, exclude_flags=["jerky"])).collect()}
    assert got == {"a": ["low_quality", "flag:jerky"], "b": ["low_quality"], "c": []}
    assert {(r["episode_id"], r["code"]) for r in curation.lint_episodes(e).collect()} == {("a", "task.generic"), ("b", "episode.too_short"), ("c", "task.missing")}


def test_pooled_equals_direct(spark):
    x = spark.createDataFrame([(k, [float(v)]) for k, v in [("a", 1), ("a", 2), ("b", 10), ("b", 4), ("b", 7)]], "g string, v array<double>")
    got = curation.pooled_stats(curation.dimension_stats(x, "v", ["g"])).first()
    assert (got["mean"], got["std"]) == pytest.approx((4.8, np.std([1, 2, 10, 4, 7])))


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(400, 440)]
    root = list(range(500))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(map(tuple, connected_components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")).collect()))
    assert got == {k: find(k) for k in range(500) if find(k) != k}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_images(spark):
    rng = np.random.default_rng(0)
    x = images.as_uint8(rng.random((200, 300, 3)))
    assert max(x.shape) == 128 and images.sharpness(x) > images.sharpness(np.full_like(x, 90))
    assert images.frame_measures(x, x)["frozen"] and not images.frame_measures(x, 255 - x)["frozen"]
    assert images.keyframes(31) == list(range(0, 31, 2))
    with pytest.raises(ValueError):
        images.as_uint8(np.full((4, 4, 3), np.nan))
    picture = [rng.integers(0, 255, (64, 64, 3)).astype("u1") for _ in range(3)]
    rows = [(e, "top", k, images.perceptual_hash(picture[p])) for e, p in (("a", 0), ("b", 0), ("c", 1), ("d", 2)) for k in range(4)]
    got = {r["episode_id"]: r["representative"] for r in images.duplicate_clusters(spark.createDataFrame(rows, "episode_id string, camera string, keyframe int, hash long")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}
