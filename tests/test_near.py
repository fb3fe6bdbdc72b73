import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel import session
from tidewheel.functions import near, vectors


@pytest.mark.parametrize(("metric", "threshold"), [("dot", 0.97), ("dot", 3.0), ("cosine", 0.9), ("cosine", 0.2)])
def test_similar_pairs_against_brute_force(spark, monkeypatch, metric, threshold):
    monkeypatch.setattr(near, "LIST_ROWS", 16)
    monkeypatch.setattr(near, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.5, (300, 8))
    x[150:] = x[rng.integers(0, 150, 150)] + rng.normal(0, 0.1, (150, 8))
    camera = ["ab"[k % 2] for k in range(300)]
    rows = [(f"e{k:03}", camera[k], [float(v) for v in r]) for k, r in enumerate(x)]
    odd = [("n0", "a", None), ("n1", "a", []), ("n2", "a", [0.0] * 8), ("n3", "a", [1.0, 2.0]), (None, "a", rows[0][2]), ("n4", "a", [float("inf")] * 8)]
    got = vectors.similar_pairs(spark.createDataFrame(rows + odd, "id string, camera string, v array<double>"), threshold, "id", "v", ["camera"], metric)
    u = x if metric == "dot" else near.unit_rows(x)
    s = u @ u.T
    want = {(rows[i][0], rows[j][0]): s[i, j] for i in range(300) for j in range(i + 1, 300) if camera[i] == camera[j] and s[i, j] >= threshold}
    found = {(r[0], r[1]): r[2] for r in got.collect()}
    assert set(found) == set(want) and len(want) > 5
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_similar_pairs_takes_the_highest_over_blocks(spark):
    rows = [("a", "x", [1.0, 0.0]), ("b", "x", [1.0, 0.1]), ("a", "y", [0.0, 1.0]), ("b", "y", [0.0, 1.0]), ("c", "y", [float("nan"), 1.0])]
    got = {tuple(r) for r in vectors.similar_pairs(spark.createDataFrame(rows, "id string, camera string, v array<float>"), 0.9, "id", "v", ["camera"], "cosine").collect()}
    assert got == {("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0)}
    with pytest.raises(ValueError):
        vectors.similar_pairs(spark.createDataFrame(rows, "id string, camera string, v array<float>"), 0.0, "id", "v")


def test_scratch_tables_go(spark):
    with session.scratch(spark):
        _, gone = session.written(spark.range(3), "gone")
        kept, stays = session.written(spark.range(4), "stays", keep=True)
    assert kept.count() == 4
    exists = lambda p: os.path.exists(re.sub("^file:/*", "/", p))
    assert exists(stays) and not exists(gone)


def brute(x, camera, threshold):
    s = x @ x.T
    return {(f"e{i:03}", f"e{j:03}"): s[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if camera[i] == camera[j] and s[i, j] >= threshold}


@pytest.mark.parametrize("threshold", [0.5, 20.0])
def test_dot_products_of_unlike_lengths(spark, monkeypatch, threshold):
    """Lengths over three orders of magnitude."""
    monkeypatch.setattr(near, "LIST_ROWS", 16)
    monkeypatch.setattr(near, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(6)
    x = near.unit_rows(rng.normal(0, 1, (300, 6))) * 10 ** rng.uniform(-1.5, 1.5, (300, 1))
    camera = ["ab"[k % 2] for k in range(300)]
    df = spark.createDataFrame([(f"e{k:03}", camera[k], [float(v) for v in r]) for k, r in enumerate(x)], "id string, camera string, v array<double>")
    got = {(r[0], r[1]): r[2] for r in vectors.similar_pairs(df, threshold, "id", "v", ["camera"], "dot").collect()}
    want = brute(x, camera, threshold)
    assert set(got) == set(want) and len(want) > 50
    assert all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_one_long_vector_opens_no_other_band(spark):
    rng = np.random.default_rng(7)
    x = near.unit_rows(rng.normal(0, 1, (4000, 32)))
    df = spark.createDataFrame([(float(n),) for n in [*np.linalg.norm(x, axis=1).tolist(), 5.0]], "norm double")
    tops = vectors.band_tops(df, 0.97)
    limits = vectors.band_thresholds(tops, 0.97)
    assert len(tops) == 2 and tops[1] == 5.0 and limits[0, 0] == pytest.approx(0.97) and limits[0, 1] == pytest.approx(0.194)
    index = near.Index(x, len(x), limits, share=1.0)
    inside = index.place(x, index.reaches[0, 0])[1].mean()
    assert inside < 0.7 * index.place(x, index.reaches[0, 1])[1].mean()
    assert inside == near.Index(x, len(x), 0.97 - 1e-9, share=1.0).place(x)[1].mean()


def test_bands():
    limits = vectors.band_thresholds([0.1, 1.0, 10.0], 0.97)
    assert limits[0, 0] > 1 and limits[0, 1] > 1 and limits[0, 2] < 1 and limits[2, 2] < 0.01


def _vectors(spark, seed, n, parts=2, dim=16, bands=1, known=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + rng.normal(size=(5, dim))[rng.integers(0, 5, n)]
    rows = [(int(k % parts), k, [float(v) for v in x[k]], k % bands, k < known) for k in range(n)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame(rows, "part long, rep long, vec array<double>, band int, known boolean"), rows, unit


@pytest.mark.parametrize("rows_a_block", [9, 16_384])
def test_all_products_against_brute_force(spark, monkeypatch, rows_a_block):
    """Cells of one block and of two; each pair of bands has a cosine of its own, one has none; known vectors make no pair."""
    monkeypatch.setattr(near.blocks, "block_rows", lambda *a: rows_a_block)
    limits = np.array([[2.0, 0.5, 0.2], [0.5, 0.7, 0.3], [0.2, 0.3, 0.9]])
    df, rows, unit = _vectors(spark, 1, 120, bands=3, known=40)
    got = [(r["a"], r["b"], r["cosine"]) for r in near.all_products(df.repartition(3), 16, limits).collect()]
    want = {(a, b): float(unit[a] @ unit[b]) for a in range(120) for b in range(a + 1, 120) if a % 2 == b % 2 and b >= 40 and unit[a] @ unit[b] >= limits[a % 3, b % 3]}
    assert len(got) == len(want) and {(a, b): pytest.approx(c) for a, b, c in got} == want


def test_wide_searches_take_products(spark, monkeypatch):
    """A low cosine would send each vector to most lists; a high one is left to the index, and one long vector changes nothing."""
    df, _, unit = _vectors(spark, 2, 600, parts=1, dim=64)
    assert near.dense(df, 64, 0.35) and not near.dense(df, 64, 0.999)
    one_long = df.withColumn("band", F.when(F.col("rep") == 7, 1).otherwise(0))
    assert not near.dense(one_long, 64, np.array([[0.999, 0.2], [0.2, 0.04]]))
    called, inner = [], near.all_products
    monkeypatch.setattr(near, "all_products", lambda *a: called.append(1) or inner(*a))
    e = df.select(F.col("rep").alias("episode_id"), F.col("vec").alias("vector"))
    got = vectors.similar_pairs(e, 0.35, metric="cosine").collect()
    s = unit @ unit.T
    assert called and {(r["episode_a"], r["episode_b"]) for r in got} == {(a, b) for a in range(600) for b in range(a + 1, 600) if s[a, b] >= 0.35}
