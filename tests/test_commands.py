import json

import numpy as np
import pytest

from tidewheel.__main__ import parser, run
from tidewheel.plans import report
from tidewheel.sources import lerobot


@pytest.fixture
def dataset(spark, tmp_path):
    t = np.arange(40) / 20
    rows = [(f"e{e}", i, float(t[i]), [float(np.sin(t[i] * (e + 1))), float(t[i])], [float(np.cos(t[i])), 0.5 * i]) for e in range(3) for i in range(40)]
    frames = spark.createDataFrame(rows, "episode_id string, frame_index long, timestamp double, state array<double>, action array<double>")
    said = spark.createDataFrame([("e0", "stir the pot until it boils"), ("e1", "task."), ("e2", None)], "episode_id string, language_instruction string")
    lerobot.write_v3(frames, said, f"file://{tmp_path}/d", 20.0, "franka")
    return f"file://{tmp_path}/d"


def test_commands_on_a_dataset(spark, dataset, tmp_path):
    go = lambda *words: run(spark, parser().parse_args(list(words)))
    seen = json.loads(go("inspect", dataset))
    assert seen["format"] == "lerobot-v3" and seen["fps"] == 20.0 and seen["n_episodes"] == 3 and seen["sample_language"] == "stir the pot until it boils"
    assert {r["code"] for r in go("lint", dataset).collect()} == {"task.generic", "task.too_short"}  # the writer names what has no task "default"
    assert go("segment", dataset, "--model", "l2").groupBy("episode_id").count().count() == 3
    assert go("compare-tokenizers", dataset).count() == 4
    go("tokenize", dataset, f"file://{tmp_path}/t", "--bins", "16")
    assert spark.read.parquet(f"{tmp_path}/t/data").columns.count("action_tokens") == 1 and json.loads((tmp_path / "t/meta/tokenizer.json").read_text())["name"] == "quantile-bins"
    go("init", f"file://{tmp_path}/c")
    assert json.loads(go("ingest", f"file://{tmp_path}/c", dataset))["registered"] == 3
    go("report", f"file://{tmp_path}/c", f"file://{tmp_path}/page.html")
    page = (tmp_path / "page.html").read_text()
    assert "3 episodes, 120 frames" in page and "stir the pot" in page
    (tmp_path / "r.json").write_text('[{"id": "a", "name": "A", "format": "rlds"}]')
    assert [r["id"] for r in go("datasets", f"file://{tmp_path}/r.json", "rlds").collect()] == ["a"]


def test_text_of_rows(spark):
    x = spark.createDataFrame([(1, "a,b", [1, 2]), (2, None, None)], "k long, t string, v array<int>")
    assert [json.loads(r) for r in report.as_text(x).split("\n")] == [{"k": 1, "t": "a,b", "v": [1, 2]}, {"k": 2, "t": None, "v": None}]
    assert report.as_text(x, "csv") == 'k,t,v\n1,"a,b","[1, 2]"\n2,,\n'
    assert report.as_text(x, "table", 1) == "k  t    v\n1  a,b  [1, 2]"
    with pytest.raises(ValueError):
        report.as_text(x, "pdf")
