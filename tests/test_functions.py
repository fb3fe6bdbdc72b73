"""What SQL calls by name: events by a table function, smoothness by an aggregate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_catalog import catalog, rows  # noqa: F401
from tests.test_stretches import episodes
from tidewheel.operators import diagnostics, kernels
from tidewheel.plans import functions

SQL = "SELECT * FROM quality_events(TABLE(some_frames) PARTITION BY episode_id ORDER BY (frame_index), fps => 30.0{more})"
take = lambda df: sorted((r["episode_id"], r["kind"], r["start"], r["end"], r["start_time"], r["end_time"]) for r in df.collect())


@pytest.mark.parametrize(("more", "least"), [("", 0.5), (", min_seconds => 0.1", 0.1)])
def test_events_equal_the_windows(spark, more, least):
    functions.register(spark)
    x = episodes(spark).where("episode_id <> 'untimed'")
    bad = x.where("episode_id = 'mixed'").withColumn("episode_id", F.lit("bad")).withColumns({"state": F.when(F.col("frame_index") % 40 == 3, F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0))).when(F.col("frame_index") % 40 == 9, F.lit(None)).otherwise(F.col("state")), "action": F.when(F.col("frame_index") % 50 == 7, F.lit(None)).when(F.col("frame_index") == 130, F.array(F.lit(0.25))).otherwise(F.col("action"))})
    every = x.union(bad).repartition(3)
    every.createOrReplaceTempView("some_frames")
    want = take(diagnostics.proprio_events(every, 30.0, least))
    assert take(spark.sql(SQL.format(more=more))) == want and len(want) > 10


def test_arguments_are_checked(spark):
    functions.register(spark)
    spark.range(3).createOrReplaceTempView("some_frames")
    with pytest.raises(Exception, match="no columns"):
        spark.sql("SELECT * FROM quality_events(TABLE(some_frames) PARTITION BY id ORDER BY (id), fps => 30.0)").collect()
    episodes(spark).createOrReplaceTempView("some_frames")
    with pytest.raises(Exception, match="above 0"):
        spark.sql(SQL.format(more="").replace("30.0", "0.0")).collect()


def test_smoothness_as_an_aggregate(spark):
    functions.register(spark)
    x = episodes(spark).where("episode_id in ('steady', 'odd')").repartition(3)
    x.createOrReplaceTempView("some_frames")
    got = {r["episode_id"]: r["s"] for r in spark.sql("SELECT episode_id, sparc(state, frame_index, 30.0D) AS s FROM some_frames GROUP BY episode_id").collect()}
    states = np.array([r["state"] for r in x.where("episode_id = 'steady'").orderBy("frame_index").collect()])
    assert got["steady"] == pytest.approx(kernels.sparc(states, 1 / 30)) and got["odd"] is None


def test_catalogs_offer_them(spark, catalog):  # noqa: F811
    episodes(spark).createOrReplaceTempView("some_frames")
    got = catalog.query("SELECT e.task, count(*) AS n FROM episodes e CROSS JOIN (" + SQL.format(more="") + ") q GROUP BY e.task").first()
    assert got["n"] > 10
