"""Episodes in stretches against the plain form, with runs, gaps and edges wherever a stretch may end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import FRAMES, flat
from tidewheel.operators import diagnostics, quality, stretches


def episodes(spark):
    rng = np.random.default_rng(0)
    n = 400
    dt = np.full(n, 1 / 30)
    dt[[50, 133, 250]] = 0.7
    t = np.cumsum(dt)
    q = np.cumsum(rng.normal(0, 0.02, (n, 2)), 0)
    for a, b in ((5, 70), (90, 92), (100, 260), (300, 399)):  # rests, two longer than a stretch
        q[a:b] = q[a]
    act = np.repeat(rng.normal(0, 1, (n // 8, 2)), 8, axis=0)
    act[120:220] = 0.25
    grip = np.sign(np.sin(np.arange(n) / 9))[:, None]
    x = flat(spark, "mixed", t, np.concatenate([q, grip], 1), act)
    steady = np.arange(n) / 30
    for name, tt, s in (("steady", steady, np.stack([np.sin(steady), np.cos(steady), np.sign(np.sin(steady * 7))], 1)), ("untimed", [None] * n, np.concatenate([q, grip], 1)), ("short", steady[:3], np.ones((3, 3))), ("odd", steady[:60], np.ones((60, 3)))):
        x = x.union(flat(spark, name, tt, s, None if len(s) < 400 else act))
    gaps = flat(spark, "sparse", steady, np.concatenate([q, grip], 1), act).withColumn("frame_index", F.col("frame_index") * 37 + F.when(F.col("frame_index") > 200, 100_000).otherwise(0))
    return x.union(gaps)


@pytest.mark.parametrize("rows", [16, 37, 100, 1000])
def test_metrics_equal_the_plain_form(spark, rows):
    x = episodes(spark)
    grip = [F.element_at("state", 3)]
    plain = {r["episode_id"]: r.asDict() for r in quality.episode_metrics(x, 30.0, grip).collect()}
    got = {r["episode_id"]: r.asDict() for r in quality.episode_metrics(x, 30.0, grip, stretch_rows=rows).collect()}
    assert set(got) == set(plain)
    for e, want in plain.items():
        for name, v in want.items():
            assert got[e][name] == (pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(v, float) else v), (e, name)
    assert plain["mixed"]["static_fraction"] > 0.3 and plain["steady"]["status"] == "scored"
    with pytest.raises(ValueError, match="episode at a time"):
        quality.episode_metrics(x, 30.0, spectra=True, stretch_rows=rows)


@pytest.mark.parametrize("rows", [16, 41, 1000])
def test_events_equal_the_plain_form(spark, rows):
    x = episodes(spark)
    take = lambda df: sorted((r["episode_id"], r["kind"], r["start"], r["end"], r["start_time"], r["end_time"]) for r in df.collect())
    plain = take(diagnostics.proprio_events(x.where("episode_id <> 'untimed'"), 30.0))
    assert take(diagnostics.proprio_events(x.where("episode_id <> 'untimed'"), 30.0, stretch_rows=rows)) == plain
    assert {k for _, k, *_ in plain} == {"timestamp_gap", "held_command", "motion_pause"} and len(plain) > 8


def test_a_long_episode_has_many_tasks(spark):
    n = 40_000
    x = spark.range(n).select(F.lit("one").alias("episode_id"), F.col("id").alias("frame_index"), (F.col("id") / 30).alias("timestamp"), F.array(F.sin(F.col("id") / 50)).alias("action"), F.array(F.sin(F.col("id") / 40), F.floor(F.col("id") / 3000).cast("double")).alias("state")).select(*[f.split()[0] for f in FRAMES.split(", ")])
    placed = stretches.place(x, 5000)
    per = {r["_stretch"]: r["count"] for r in placed.groupBy("_stretch").count().collect()}
    assert sorted(per) == list(range(8)) and max(per.values()) <= 6250 and sum(per.values()) == n
    wide = stretches.halo(placed, 3, 3)
    assert wide.where("not _own").count() == 8 * 6 and wide.where("_own").count() == n
    plain, got = (quality.episode_metrics(x, 30.0, stretch_rows=r).first().asDict() for r in (None, 5000))
    assert all(got[k] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v) for k, v in plain.items())
    with pytest.raises(ValueError, match="16 rows"):
        stretches.place(x, 3)
