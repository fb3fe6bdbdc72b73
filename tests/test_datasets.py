import pytest

from tidewheel.__main__ import parser, run
from tidewheel.sources import datasets, lerobot


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('d')}/a"
    rows = [(f"e{e}", i, i / 10, [i * 0.5, float(e)], [float(-i)]) for e in range(12) for i in range(6)]
    frames = spark.createDataFrame(rows, "episode_id string, frame_index long, timestamp double, state array<double>, action array<double>")
    lerobot.write_v3(frames, spark.createDataFrame([(f"e{e}", f"task {e % 2}") for e in range(12)], "episode_id string, language_instruction string"), root, 10.0)
    return root


def contents(spark, root):
    frames, episodes = datasets.open_dataset(spark, root, 10.0)
    said = {r["episode_id"]: r["language_instruction"] for r in episodes.collect()}
    found = {}
    for r in frames.collect():
        found.setdefault(r["episode_id"], []).append((r["frame_index"], round(r["timestamp"], 6), tuple(r["state"]), tuple(r["action"]), said[r["episode_id"]]))
    return [sorted(found[k]) for k in sorted(found)]


def test_convert_there_and_back(spark, source, tmp_path):
    a, b = f"file://{tmp_path}/rlds", f"file://{tmp_path}/back"
    datasets.convert(spark, source, a, "rlds", 10.0, "arm")
    there = f"{a}/arm/1.0.0"
    datasets.convert(spark, there, b, "lerobot-v3", 10.0)
    assert len(contents(spark, source)) == 12
    assert contents(spark, source) == contents(spark, there) == contents(spark, b)
    with pytest.raises(ValueError, match="must be one of"):
        datasets.convert(spark, source, a, "hdf5")


def test_commands(spark, source, tmp_path):
    def call(*words):
        return run(spark, parser().parse_args(list(words)))

    assert call("detect", source) == "lerobot-v3"
    stats = {(r["signal"], r["dim"]): (r["min"], r["max"], r["count"]) for r in call("stats", source).collect()}
    assert stats == {("state", 0): (0.0, 2.5, 72), ("state", 1): (0.0, 11.0, 72), ("action", 0): (-5.0, 0.0, 72)}
    assert call("quality", source, "--fps", "10").where("overall_score > 0").count() == 12
    call("init", f"file://{tmp_path}/c")
    assert call("query", f"file://{tmp_path}/c", "SELECT count(*) AS n FROM episodes").first()["n"] == 0
    with pytest.raises(SystemExit):
        parser().parse_args(["convert", "a", "b", "--to", "bag"])
