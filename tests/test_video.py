from tidewheel.operators import video

SCHEMA = "episode_id string, camera string, frame_index long, timestamp double, outcome string, sharpness double, brightness double, shadow_fraction double, highlight_fraction double, colourfulness double, frozen boolean"


def _frame(cam, i, t, outcome="decoded", sharp=200.0, luma=90.0, frozen=False):
    ok = outcome == "decoded"
    return ("e", cam, i, t, outcome, *((sharp, luma, 0.0, 0.0, 5.0) if ok else (None,) * 5), (None if i == 0 else frozen) if ok else None)


def _cameras(spark, rows, fps=10.0):
    return {r["camera"]: r for r in video.camera_quality(spark.createDataFrame(rows, SCHEMA), fps).collect()}


def test_clean_camera_has_no_flag(spark):
    r = _cameras(spark, [_frame("top", i, i / 10) for i in range(20)])["top"]
    assert r["flags"] == [] and r["decode_coverage"] == 1 and r["longest_frozen_run"] == 0
    assert r["drop_fraction"] == 0 and abs(r["effective_fps"] - 10) < 1e-6


def test_frozen_run_is_timed_from_the_frame_it_repeats(spark):
    rows = [_frame("top", i, i / 10, frozen=5 <= i < 11) for i in range(40)]
    r = _cameras(spark, rows)["top"]
    assert r["longest_frozen_run"] == 6 and abs(r["max_frozen_s"] - 0.6) < 1e-9 and r["flags"] == ["frozen_frames"]
    assert _cameras(spark, [_frame("top", i, i / 10, frozen=5 <= i < 9) for i in range(40)])["top"]["flags"] == []


def test_gaps_and_drops(spark):
    times = [0.0, 0.1, 0.2, 0.6, 0.7]
    frames = spark.createDataFrame([_frame("top", i, t) for i, t in enumerate(times)], SCHEMA)
    gap = video.frame_gaps(frames, 10.0).collect()
    assert [(g["frame_index"], g["missing"], g["significant"]) for g in gap] == [(3, 3, True)]
    r = video.camera_quality(frames, 10.0).first()
    assert r["dropped_frames"] == 3 and abs(r["drop_fraction"] - 3 / 7) < 1e-9 and r["flags"] == ["video_frame_drops"]


def test_damaged_frames_null_times_and_rollup(spark):
    rows = [_frame("a", i, None, outcome="missing" if i in (2, 3, 6) else "decoded", sharp=50.0) for i in range(10)]
    rows += [_frame("b", i, (0.1 * i if i != 4 else 0.0), outcome="invalid" if i == 9 else "decoded", luma=20.0) for i in range(10)]
    frames = spark.createDataFrame(rows, SCHEMA)
    cams = _cameras(spark, rows)
    assert cams["a"]["flags"] == ["video_camera_missing", "blurry"] and cams["a"]["decode_coverage"] == 1
    assert cams["a"]["dropped_frames"] is None and cams["a"]["drop_fraction"] is None and cams["a"]["invalid_timestamps"] == 0
    assert "video_invalid_timestamps" in cams["b"]["flags"] and "under_exposed" in cams["b"]["flags"] and cams["b"]["drop_fraction"] is None
    found = sorted((r["kind"], r["camera"], r["start"], r["end"]) for r in video.integrity_events(frames).collect())
    assert found == [("invalid", "b", 9, 10), ("missing", "a", 2, 4), ("missing", "a", 6, 7)]
    e = video.episode_rollup(video.camera_quality(frames, 10.0)).first()
    assert e["cameras"] == 2 and e["min_sharpness"] == 50 and e["underexposed_fraction"] == 1 and "no_motion" not in e["flags"]
    assert {"blurry", "under_exposed", "video_invalid_pixels"} <= set(e["flags"])


def test_no_rows(spark):
    frames = spark.createDataFrame([], SCHEMA)
    assert video.episode_rollup(video.camera_quality(frames, 10.0)).count() == 0 == video.integrity_events(frames).count()
