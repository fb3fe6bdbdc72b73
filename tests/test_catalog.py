import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidewheel.plans.catalog import Catalog, Files

NOW = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def rows(spark):
    e = [(f"e{k}", f"h{k}", "u", "lerobot-v3", "franka", "pick", None, None, None, 100 + k, 6.6, 15.0, [("wrist", 320, 180, 15.0)], 7, 7, "b", NOW, {"s": str(k)}) for k in range(3)]
    from tidewheel.plans.schema import schema_of

    q = [(f"e{k}", "q-v2", s, [], NOW) for k, s in enumerate((8.0, 6.0, 7.0))]
    v = [(f"e{k}", "m@1", "episode", "cam0", "mean", 4, x, NOW) for k, x in enumerate(([1.0, 0.0, 0.0, 0.02], [1.0, 0.01, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]))]
    return {
        "episodes": spark.createDataFrame(e, schema_of("episodes")),
        "quality_scores": spark.createDataFrame(q, "episode_id string, scorer_version string, overall_score double, flags array<string>, computed_at timestamp"),
        "embeddings": spark.createDataFrame(v, "episode_id string, model_id string, level string, camera string, pooling string, dim int, vector array<float>, computed_at timestamp"),
    }


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog.init(spark, f"file://{tmp_path}/c")
    c.commit(rows(spark))
    return c


def test_init_and_versions(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    Catalog.init(spark, root)
    with pytest.raises(FileExistsError):
        Catalog.init(spark, root)
    Files(spark, root).write("catalog.json", json.dumps({"schema_version": 99}))
    with pytest.raises(ValueError, match="99"):
        Catalog(spark, root)


def test_only_committed_rows_count(spark, catalog, monkeypatch):
    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(catalog.files, "write", fail)
    with pytest.raises(OSError):
        catalog.commit({"episodes": rows(spark)["episodes"]})
    monkeypatch.undo()
    assert catalog.table("episodes").count() == 3 and len(catalog.orphans()) > 0


def test_schema_is_strict(spark, catalog):
    e = rows(spark)["episodes"]
    with pytest.raises(ValueError, match="unknown"):
        catalog.commit({"episodes": e.withColumn("more", F.lit(1))})
    with pytest.raises(ValueError, match="missing"):
        catalog.commit({"episodes": e.drop("fps")})
    with pytest.raises(Exception, match="must not be null"):
        catalog.commit({"episodes": e.withColumn("fps", F.lit(None).cast("float"))})


def test_edges_losers_and_curation(spark, catalog):
    assert catalog.compute_edges("m@1") == 1 and catalog.compute_edges("m@1") == 0
    losers = lambda p: [r[0] for r in catalog.dup_losers(0.97, p).collect()]
    assert losers("higher-quality") == ["e1"] and losers("longer") == ["e0"] and losers("first") == ["e1"]
    labels = {r["episode_id"]: r["label"] for r in catalog.curate("me", dedup=0.97).collect()}
    assert labels == {"e0": "approved", "e1": "rejected", "e2": "approved"}
    catalog.curate("me", where="overall_score >= 7.0", label="held")
    assert {r["episode_id"]: r["label"] for r in catalog.curation().collect()} == {"e0": "held", "e1": "rejected", "e2": "held"}
    assert catalog.table("curation_labels").count() == 5
    with pytest.raises(ValueError, match="no such"):
        catalog.curate("me", ids=["e9"])


def test_query_search_stats(spark, catalog):
    got = catalog.query("SELECT task, count(*) AS n, avg(overall_score) AS s FROM episodes JOIN v_latest_quality USING (episode_id) GROUP BY task").first()
    assert (got["n"], got["s"]) == (3, 7.0)
    with pytest.raises(ValueError):
        catalog.query("DROP TABLE episodes")
    assert [r["episode_id"] for r in catalog.search(query=[0, 0, 1, 0], top=1).collect()] == ["e2"]
    assert [r["episode_id"] for r in catalog.search(like="e0", top=2).collect()] == ["e0", "e1"]
    with pytest.raises(ValueError):
        catalog.search()
    assert catalog.stats().first()["median_score"] == 7.0


def test_newest_score_is_by_string(spark, catalog):
    more = spark.createDataFrame([("e0", "q-v10", 1.0, [], NOW)], "episode_id string, scorer_version string, overall_score double, flags array<string>, computed_at timestamp")
    catalog.commit({"quality_scores": more})
    assert catalog.latest_quality().where("episode_id = 'e0'").first()["scorer_version"] == "q-v2"


def test_ingest_once(spark, catalog):
    catalog.ingest(rows(spark)["episodes"])
    assert catalog.table("episodes").count() == 3


def test_ingest_of_a_dataset(spark, tmp_path):
    """Read, hashed, scored and registered once; a second run, copies and a run in parts add nothing."""
    import numpy as np

    from tidewheel.sources import lerobot

    t = np.arange(60) / 15
    rows = []
    for e, k in enumerate((1.0, 2.0, 1.0)):  # the third is a copy of the first
        q = np.stack([np.sin(t * k), np.cos(t * k)], 1)
        rows += [(f"e{e}", i, float(t[i]), q[i].tolist(), (q[i] * 0.9).tolist()) for i in range(60)]
    frames = spark.createDataFrame(rows, "episode_id string, frame_index long, timestamp double, state array<double>, action array<double>")
    said = spark.createDataFrame([(f"e{e}", "stir the pot") for e in range(3)], "episode_id string, language_instruction string")
    root = f"file://{tmp_path}/d"
    lerobot.write_v3(frames, said, root, 15.0, "franka")
    c = Catalog.init(spark, f"file://{tmp_path}/c")
    assert c.ingest_dataset(root, batches=2) == {"seen": 3, "registered": 2, "skipped": 1, "scored": 2}
    assert c.ingest_dataset(root)["registered"] == 0
    e = c.table("episodes").orderBy("episode_id").collect()
    assert {r["robot"] for r in e} == {"franka"} and all(r["fps"] == 15 and r["num_frames"] == 60 and r["duration_s"] == 4 and r["state_dim"] == 2 and r["language_instruction"] == "stir the pot" for r in e)
    assert {r["extra"]["source_episode_id"] for r in e} == {"episode_000000", "episode_000001"}
    q = c.latest_quality().collect()
    assert len(q) == 2 and all(r["overall_score"] > 0 and r["ldlj"] < 0 and r["overall_saturation"] is None and r["state_action_consistency"] is not None for r in q)
    assert c.studio().count() == 2 and c.label_counts().count() == 0


def test_losers_in_sql(spark, catalog):
    catalog.compute_edges("m@1")
    found = lambda policy, at=0.9: [r[0] for r in catalog.query(f"SELECT * FROM v_dup_losers({at}, '{policy}')").collect()]
    assert found("higher-quality") == ["e1"] and found("longer") == ["e0"] and found("longer", 1.1) == []


def test_embedding_skips_what_is_there(spark, catalog):
    images = spark.createDataFrame([(e, "top", i, [float(i), float(e[1])]) for e in ("e0", "n1", "n2") for i in range(40)], "episode_id string, camera string, frame_index long, image array<double>")
    make = lambda: lambda rows: [[sum(x), 1.0] for x in rows]
    assert catalog.embed(images, "sum@1", 10.0, make=make) == 3 and catalog.embed(images, "sum@1", 10.0, make=make) == 0
    row = catalog.table("embeddings").where("model_id = 'sum@1' and episode_id = 'n2'").first()
    assert row["num_frames_sampled"] == 4 and row["vector"] == [17.0, 1.0] and row["camera"] == "top"


def test_search_by_text_and_camera(spark, catalog):
    from tidewheel.operators import sampling

    sampling.MODELS.pop("m", None)
    sampling.register_model("m")(lambda: lambda texts: [[0.0, 0.0, float(len(t)), 0.0] for t in texts])
    assert [r["episode_id"] for r in catalog.search(text="cup", top=1).collect()] == ["e2"]
    assert catalog.search(text="cup", camera="cam9").count() == 0 and catalog.search(text="cup", camera="cam0").count() == 3
    sampling.MODELS.pop("m")
    with pytest.raises(ValueError, match="no such model"):
        catalog.search(text="cup")
    with pytest.raises(ValueError):
        catalog.search(text="cup", like="e0")
