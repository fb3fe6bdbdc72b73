"""Relational queries on rows that the standard tables do not hold."""

import contextlib
import datetime

import duckdb

import __spark_entry__ as entry


@contextlib.contextmanager
def spilling(spark, rows):
    """Sorts spill after so many rows, as those of large tables do."""
    conf, key = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(key, str(rows))
    try:
        yield
    finally:
        conf.remove(key)


def both(spark, folder, name, table):
    got = sorted(map(tuple, entry.queries()[name](spark, folder).collect()), key=str)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return got, sorted(c.execute(entry.oracle_sql()[name]).fetchall(), key=str)


def test_first_event_of_spilled_users(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, None if k % 50 == 0 else at + datetime.timedelta(seconds=k * 7919 % 3000 // 2), None if k % 61 == 0 else k % 40) for k in range(4000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    with spilling(spark, 30):
        got, want = both(spark, str(tmp_path), "lateral_view", "events")
    assert len(got) == 40 and got == want


def test_ranks_without_a_task_of_one_status(spark, tmp_path):
    """Nulls, ties and a status of fewer rows than quarters; no window is over a status alone."""
    at = datetime.datetime(1995, 1, 1)
    rows = [(k, None if k % 97 == 0 else "FOP"[k % 3] if k > 3 else "X", None if k % 83 == 0 else at + datetime.timedelta(days=k * 31 % 50), None if k % 71 == 0 else float(k * 17 % 120)) for k in range(1, 1000)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_totalprice double").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    got, want = both(spark, str(tmp_path), "window_ranks", "orders")
    assert len(got) == 999 and got == want
    plan = entry.queries()["window_ranks"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "ntile" not in plan and "rank(" not in plan
