import pytest
from pyspark.sql import functions as F

from tidewheel.plans.catalog import Catalog
from tidewheel.streaming import incremental


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_sessions_agree_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", t) for t in (0, 1, 3, 6, 7, 100)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = incremental.sessions(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "k")
    _drain(stream.writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    assert sorted(r["n_frames"] for r in spark.table("sess").collect()) == [2, 3]


def test_ingest_stream_is_idempotent(spark, tmp_path):
    from tests.test_catalog import rows

    root = f"file://{tmp_path}/c"
    Catalog.init(spark, root)
    e = rows(spark)["episodes"]
    e.write.parquet(f"{tmp_path}/in")
    e.withColumn("episode_id", F.concat("episode_id", F.lit("x"))).write.mode("append").parquet(f"{tmp_path}/in")
    for k in range(2):  # the second run has lost its checkpoint
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        _drain(incremental.ingest_stream(stream, root, f"{tmp_path}/cp{k}").start())
    assert Catalog(spark, root).table("episodes").count() == 3


def test_frame_figures(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = spark.createDataFrame([("a", float(t), float(x)) for t, x in ((0, 0), (1, 2), (3, 1))] + [("b", 0.0, 5.0)], "episode_id string, timestamp double, x double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = incremental.frame_figures(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _drain(stream.writeStream.outputMode("update").format("memory").queryName("figs").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    got = {r["episode_id"]: (r["n_frames"], r["path"], r["longest_gap"]) for r in spark.table("figs").collect()}
    assert got == {"a": (3, 3.0, 2.0), "b": (1, 0.0, 0.0)}
