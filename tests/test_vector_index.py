"""The index that a catalog keeps: added vectors meet old and new ones, and nothing else is read or compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_catalog import NOW
from tidewheel.functions import near, vectors
from tidewheel.plans import vector_index
from tidewheel.plans.catalog import Catalog
from tidewheel.plans.vector_index import VectorIndex

KIND = "episode_id string, model_id string, level string, camera string, pooling string, dim int, vector array<float>, computed_at timestamp"


def made(spark, x, first=0, model="m@1", cameras=2):
    return spark.createDataFrame([(f"e{first + k:05}", model, "episode", f"c{k % cameras}", "mean", len(v), [float(a) for a in v], NOW) for k, v in enumerate(x)], KIND)


def clustered(rng, n, dim, scale=1.0):
    heads = near.unit_rows(np.random.default_rng(99).normal(0, 1, (40, dim)))
    return (near.unit_rows(heads[rng.integers(0, 40, n)] + rng.normal(0, 0.03, (n, dim))) * scale).astype("f4")


def edges(catalog):
    return {(r["episode_a"], r["episode_b"]): r["similarity"] for r in catalog.table("dedup_edges").collect()}


@pytest.mark.parametrize(("metric", "threshold"), [("dot", 0.97), ("cosine", 0.9)])
def test_runs_in_parts_equal_one_over_all(spark, tmp_path, monkeypatch, metric, threshold):
    monkeypatch.setattr(near, "LIST_ROWS", 8)
    monkeypatch.setattr(near, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    parts = [clustered(rng, n, 16) * (rng.choice([0.5, 1, 1, 3], (n, 1)) if metric == "dot" else 1) for n in (160, 50, 30)]
    step = Catalog.init(spark, f"file://{tmp_path}/a")
    at, added = 0, []
    for x in parts:
        step.commit({"embeddings": made(spark, x, at)})
        at += len(x)
        added.append(step.compute_edges("m@1", threshold, metric))
        assert step.compute_edges("m@1", threshold, metric) == 0
    whole = Catalog.init(spark, f"file://{tmp_path}/b")
    whole.commit({"embeddings": made(spark, np.concatenate(parts), 0)})
    # cameras follow from places, and all parts begin at even ones
    assert whole.compute_edges("m@1", threshold, metric) == sum(added) and all(a > 10 for a in added)
    one, other = edges(step), edges(whole)
    assert set(one) == set(other) and all(one[k] == pytest.approx(v, rel=1e-6) for k, v in other.items())


def test_only_probed_lists_are_read_and_old_pairs_left_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near, "LIST_ROWS", 8)
    monkeypatch.setattr(near, "GROUP_LISTS", 4)
    rng = np.random.default_rng(4)
    c = Catalog.init(spark, f"file://{tmp_path}/a")
    c.commit({"embeddings": made(spark, clustered(rng, 400, 24), cameras=1)})
    c.compute_edges("m@1", 0.97, "cosine")
    index = VectorIndex(c, "m@1", 24, "cosine")
    fitted = index.load()
    fitted.limit(0.97)
    fitted.one_sided = True
    new = clustered(rng, 2, 24)
    rows = vectors.usable(made(spark, new, 900, cameras=1), "episode_id", "vector", ["camera"]).withColumn("band", F.lit(0))
    some = index.probed(fitted, rows)
    assert some.count() < 0.3 * 400 and len(some.select("group").distinct().collect()) < len(fitted.groups)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "group#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    seen = []
    search = near.search
    monkeypatch.setattr(near, "search", lambda v, *a, **k: (seen.append((v.count(), k["known"].count())), search(v, *a, **k))[1])
    c.commit({"embeddings": made(spark, new, 900, cameras=1)})
    assert c.compute_edges("m@1", 0.97, "cosine") > 0
    assert seen[0][0] == 2 and seen[0][1] < 120
    x = np.concatenate([clustered(np.random.default_rng(4), 400, 24), new]).astype("f8")
    u = near.unit_rows(x)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.97, 1))
    assert len(edges(c)) == len(i)


def test_a_run_that_stops_is_done_again(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    c = Catalog.init(spark, f"file://{tmp_path}/a")
    c.commit({"embeddings": made(spark, clustered(rng, 80, 8))})
    monkeypatch.setattr(VectorIndex, "save", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        c.compute_edges("m@1", 0.97, "cosine")
    monkeypatch.undo()
    n = len(edges(c))
    assert c.compute_edges("m@1", 0.97, "cosine") == 0 and len(edges(c)) == n > 0


def test_lower_thresholds_and_growth_go_over_all(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    c = Catalog.init(spark, f"file://{tmp_path}/a")
    c.commit({"embeddings": made(spark, clustered(rng, 60, 8))})
    c.compute_edges("m@1", 0.999, "cosine")
    few = len(edges(c))
    assert c.compute_edges("m@1", 0.9, "cosine") > 0 and len(edges(c)) > few
    first = VectorIndex(c, "m@1", 8, "cosine").state["fitted"]
    monkeypatch.setattr(vector_index, "REFIT", 1.5)
    c.commit({"embeddings": made(spark, clustered(rng, 60, 8), 60)})
    c.compute_edges("m@1", 0.95, "cosine")
    state = VectorIndex(c, "m@1", 8, "cosine").state
    assert state["fitted"] != first and state["rows"] == 120 and len(state["tables"]) == 1


def test_odd_vectors_and_lengths(spark, tmp_path):
    c = Catalog.init(spark, f"file://{tmp_path}/a")
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 0.0]), ("d", []), ("e", [1.0, 0.0, 0.0]), ("f", [1.0, 0.0, 0.0]), ("g", [float("nan"), 1.0]), ("h", [0.0, 1.0])]
    c.commit({"embeddings": spark.createDataFrame([(e, "m@1", "episode", None, "mean", len(v), v, NOW) for e, v in rows], KIND)})
    assert c.compute_edges("m@1", 0.97) == 3 and set(edges(c)) == {("a", "b"), ("e", "f"), ("g", "h")}
    assert c.compute_edges("m@1", 2.0) == 0 and c.compute_edges("other") == 0
    with pytest.raises(ValueError):
        c.compute_edges("m@1", 0.0)
