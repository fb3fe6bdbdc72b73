"""Long episodes in stretches: windows that look a few frames back and ahead, and runs, without a task that holds a whole episode.

Frames are dealt by order to stretches of a bounded number of rows. The edges of a
stretch are copied to its neighbours, so a window that looks no further than the halo is
right for a stretch's own rows; what a run knows of the frames before travels as one row
a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.session import materialize

#: Frames that a stretch holds, give or take a quarter.
ROWS = 100_000


def place(frames: DataFrame, rows: int = ROWS, key: str = "episode_id", order: str = "frame_index") -> DataFrame:
    """Adds ``_stretch``, from 0 in order, ``_pos``, the frame's number in its episode, and ``_long``, whether there are several.

    ``order`` is a whole number, different for each frame of an episode. Rows are counted by
    ranges of it, so only a row for each range is put in order; episodes in one stretch
    are not joined with anything.
    """
    if rows < 16:
        raise ValueError("a stretch must hold 16 rows or more")
    part = F.floor(F.col(order) / F.lit(rows // 4))
    counts = materialize(frames.groupBy(F.col(key).alias("_id"), part.alias("_part")).agg(F.count("*").alias("n")), "stretches")
    w = Window.partitionBy("_id").orderBy("_part")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(Window.partitionBy("_id"))
    dealt = counts.withColumns({"_all": whole, "_sofar": before}).where(F.col("_all") > rows).withColumn("_s", F.floor(F.col("_sofar") / rows).cast("int"))
    dealt = dealt.withColumn("_before", F.min("_sofar").over(Window.partitionBy("_id", "_s"))).select("_id", "_part", "_s", "_before")
    x = frames.withColumn("_part", part)
    x = x.join(dealt, x[key].eqNullSafe(dealt["_id"]) & (x["_part"] == dealt["_part"]), "left").select(*frames.columns, F.coalesce("_s", F.lit(0)).alias("_stretch"), F.coalesce("_before", F.lit(0)).alias("_before"), F.col("_s").isNotNull().alias("_long"))
    rank = F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(order)) - 1
    return x.withColumn("_pos", (F.col("_before") + rank).cast("long")).drop("_before")


def halo(placed: DataFrame, before: int, after: int, key: str = "episode_id", order: str = "frame_index") -> DataFrame:
    """Copies a stretch's first ``after`` rows to the one before it and its last ``before`` rows to the one behind it.

    ``key`` becomes a pair ``id, stretch``, so that windows by key are windows by stretch;
    ``_own`` is false for copies.
    """
    w = Window.partitionBy(key, "_stretch").orderBy(order)
    up = F.row_number().over(w)
    down = F.count("*").over(Window.partitionBy(key, "_stretch")) - up + 1
    s = F.col("_stretch")
    to = lambda n, own: F.struct(n.cast("int").alias("stretch"), F.lit(own).alias("own"))
    copies = F.array(to(s, True), F.when(F.col("_long") & (F.col("_up") <= after), to(s - 1, False)), F.when(F.col("_long") & (F.col("_down") <= before), to(s + 1, False)))
    x = placed.withColumns({"_up": up, "_down": down}).withColumn("_to", F.explode(F.array_compact(copies)))
    kept = [c for c in placed.columns if c not in (key, "_stretch")]
    return x.select(F.struct(F.col(key).alias("id"), F.col("_to.stretch").alias("stretch")).alias(key), *kept, F.col("_to.own").alias("_own"))


def carried(x: DataFrame, value: Column, key: str = "episode_id", order: str = "frame_index") -> DataFrame:
    """``key`` and ``_carry``: the last non-null ``value`` among the own rows of all stretches before."""
    last = x.where("_own").withColumn("_v", value).where("_v is not null").groupBy(key).agg(F.max_by("_v", order).alias("_v"))
    every = x.where("_own").select(key).distinct()
    w = Window.partitionBy("_i").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    out = every.join(last, key, "left").withColumns({"_i": F.col(f"{key}.id"), "_n": F.col(f"{key}.stretch")})
    return out.select(key, F.last("_v", ignorenulls=True).over(w).alias("_carry"))


def long_runs(x: DataFrame, flag: Column, ts: str = "timestamp", min_seconds: float = 0.5, key: str = "episode_id", order: str = "frame_index") -> DataFrame:
    """``temporal.min_duration_events`` over stretches with a halo of one row before.

    Runs are found inside stretches; those that end at an edge and go on behind it are put
    together, one row for each edge that they touch.
    """
    w = Window.partitionBy(key).orderBy(order)
    timed = x.withColumns({"_t0": F.lag(ts).over(w), "_on": F.coalesce(flag, F.lit(False))}).where("_own")
    edges = timed.groupBy(key).agg(F.min("_pos").alias("_first"), F.max("_pos").alias("_last"))
    on = timed.where("_on").withColumn("_island", F.col("_pos") - F.row_number().over(w))
    pieces = on.groupBy(key, "_island").agg(F.min("_pos").alias("_a"), F.max("_pos").alias("_b"), F.min("_t0").alias("start_time"), F.max(ts).alias("end_time")).join(edges, key)
    pieces = pieces.select(F.col(f"{key}.id").alias(key), "_a", "_b", "start_time", "end_time", (F.col("_a") == F.col("_first")).alias("_opens"), (F.col("_b") == F.col("_last")).alias("_ends"))
    by = Window.partitionBy(key).orderBy("_a")
    touching = pieces.where("_opens or _ends")
    goes_on = F.col("_opens") & F.coalesce(F.lag("_ends").over(by) & (F.lag("_b").over(by) + 1 == F.col("_a")), F.lit(False))
    groups = touching.withColumn("_new", (~goes_on).cast("int")).withColumn("_g", F.sum("_new").over(by))
    joined = groups.groupBy(key, "_g").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("_g")
    events = pieces.where("not (_opens or _ends)").drop("_opens", "_ends").unionByName(joined)
    out = events.select(key, (F.col("_a") - 1).alias("start"), (F.col("_b") + 1).alias("end"), "start_time", "end_time")
    return out.where(F.col("end_time") - F.col("start_time") + 1e-9 >= min_seconds)
