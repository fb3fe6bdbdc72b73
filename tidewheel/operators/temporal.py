"""As-of alignment of multi-rate streams, and splitting of streams into episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METHODS = ("nearest", "hold", "interpolate")


def align(primary: DataFrame, source: DataFrame, key: list[str], ts: str = "ts", value: str = "value", method: str = "nearest", hot_rows: int | None = None) -> DataFrame:
    """Give each primary row the source value of its time: ``value, source_ts, skew``.

    - ``nearest``: closest source time, the earlier on a tie, clamped at both ends.
    - ``hold``: the last value at or before; before the first, the first (skew positive).
    - ``interpolate``: linear between the neighbours for numbers and arrays of numbers,
      the end values outside; skew is the lesser distance to a neighbour. Other types
      fall back to nearest.

    Source and primary rows are one stream per key: one shuffle on the key, one sort in
    either direction and running frames only, so the work is linear in the rows of a key.
    ``hot_rows``: a key of more rows is cut into stretches of time of about so many, each
    sorted by itself (see ``_stretches``). Source rows of null time are left out; a key
    without source rows gives null. Of source rows at one time any may count.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    kind = source.schema[value].dataType.simpleString()
    numeric = kind in ("double", "float", "int", "bigint", "smallint") or kind in ("array<double>", "array<float>")
    hit = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    rest = [c for c in primary.columns if c not in (*key, ts)]
    left = primary.select(*key, ts, F.lit(1).alias("_k"), F.struct(*rest).alias("_row") if rest else F.lit(None).alias("_row"), F.lit(None).cast(f"struct<t:{source.schema[ts].dataType.simpleString()},v:{kind}>").alias("_hit"))
    right = source.where(F.col(ts).isNotNull()).select(*key, ts, F.lit(0).alias("_k"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), hit.alias("_hit"))
    both = left.union(right)
    parts = [*key]
    if hot_rows is not None:
        both, parts = _stretches(both, key, ts, hot_rows), [*key, "_part"]
    running = (Window.unboundedPreceding, 0)
    forth = Window.partitionBy(*parts).orderBy(F.col(ts).asc(), F.col("_k").asc()).rowsBetween(*running)
    back = Window.partitionBy(*parts).orderBy(F.col(ts).desc(), F.col("_k").desc()).rowsBetween(*running)
    joined = both.withColumn("_a", F.last("_hit", ignorenulls=True).over(forth)).withColumn("_b", F.last("_hit", ignorenulls=True).over(back)).where("_k = 1")
    if hot_rows is not None:
        joined = _with_ends(joined, both, key)
    t, a, b = F.col(ts), F.col("_a"), F.col("_b")
    before, after = t - a["t"], b["t"] - t
    nearest = F.when(a.isNull(), b).when(b.isNull(), a).when(before <= after, a).otherwise(b)
    if method == "hold":
        chosen = F.coalesce(a, b)
        out = chosen["v"], chosen["t"]
    elif method == "nearest" or not numeric:
        out = nearest["v"], nearest["t"]
    else:
        share = F.when((b["t"] - a["t"]) > 0, before / (b["t"] - a["t"])).otherwise(F.lit(0.0))
        mix = (lambda x, y: (F.lit(1.0) - share) * x + share * y) if not kind.startswith("array") else None
        between = mix(a["v"], b["v"]) if mix else F.zip_with(a["v"], b["v"], lambda x, y: (F.lit(1.0) - share) * x + share * y)
        plain = F.col("_a.v").cast(between_type(kind)), F.col("_b.v").cast(between_type(kind))
        out = F.when(a.isNull(), plain[1]).when(b.isNull() | (a["t"] == t), plain[0]).otherwise(between), nearest["t"]
    kept = [F.col(f"_row.{c}").alias(c) for c in rest]
    return joined.select(*key, ts, *kept, out[0].alias("value"), out[1].alias("source_ts"), F.abs(t - out[1]).alias("skew"))


def _stretches(both: DataFrame, key: list[str], ts: str, hot_rows: int) -> DataFrame:
    """Adds ``_part``: the stretch of time that a row of a key of over ``hot_rows`` rows lies in, else 0.

    The counts and ends of the hot keys are one more read; there are at most rows /
    ``hot_rows`` of them. Stretches are equal in time, so ``hot_rows`` is a mean.
    """
    ends = both.groupBy(*key).agg(F.count("*").alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi")).where(F.col("_n") > hot_rows)
    wide = ends.select(*key, F.col("_lo").cast("double").alias("_lo"), F.try_divide(F.col("_hi").cast("double") - F.col("_lo").cast("double"), F.ceil(F.col("_n") / hot_rows).cast("double")).alias("_wide"))
    part = F.when(F.col("_wide") > 0, F.floor((F.col(ts).cast("double") - F.col("_lo")) / F.col("_wide")))
    return both.join(wide, key, "left").withColumn("_part", F.coalesce(part, F.lit(0)).cast("long")).drop("_lo", "_wide")


def _with_ends(joined: DataFrame, both: DataFrame, key: list[str]) -> DataFrame:
    """Where a stretch has no source row before or after a primary row, that of the nearest stretch that has one."""
    of_part = both.where("_k = 0").groupBy(*key, "_part").agg(F.min_by("_hit", F.col("_hit.t")).alias("_first"), F.max_by("_hit", F.col("_hit.t")).alias("_last"))
    # a row for each stretch, so a key's stretches are few
    stretches = joined.select(*key, "_part").distinct().join(of_part, [*key, "_part"], "full")
    w = Window.partitionBy(*key)
    ends = stretches.select(
        *key,
        "_part",
        F.last("_last", ignorenulls=True).over(w.orderBy(F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", ignorenulls=True).over(w.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    return joined.join(ends, [*key, "_part"], "left").withColumns({"_a": F.coalesce("_a", "_before"), "_b": F.coalesce("_b", "_after")})


def between_type(kind: str) -> str:
    return "array<double>" if kind.startswith("array") else "double"


def drop_skewed(aligned: DataFrame, max_skew: float) -> DataFrame:
    """Rows over ``max_skew`` are marked; those over ten times as much are dropped."""
    return aligned.where(F.col("skew") <= 10 * max_skew).withColumn("skewed", F.col("skew") > max_skew)


def primary_topic(messages: DataFrame, configured: str | None = None, topic: str = "topic") -> DataFrame:
    """The configured topic, else the one with most messages (first by name on a tie)."""
    counts = messages.groupBy(topic).agg(F.count("*").alias("n_messages"))
    if configured is not None:
        return counts.where(F.col(topic) == configured)
    return counts.orderBy(F.desc("n_messages"), topic).limit(1)


def split_time_gap(df: DataFrame, key: list[str], ts: str, gap, order: list[str] | None = None) -> DataFrame:
    """Number episodes from 0; a step longer than ``gap`` begins a new one."""
    w = Window.partitionBy(*key).orderBy(ts, *(order or []))
    cut = F.when(F.col(ts) - F.lag(ts).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_cut", cut).withColumn("episode", F.sum("_cut").over(w)).drop("_cut")


def split_marker(df: DataFrame, markers: DataFrame, key: list[str], ts: str, order: list[str] | None = None) -> DataFrame:
    """Number episodes from 0; the first row at or after each marker begins a new one.

    Several markers before one row are one cut; cuts before the first row or after the
    last are none.
    """
    rows = df.select(*key, F.struct(*(c for c in df.columns if c not in key)).alias("_row"), F.col(ts).alias("_t"), F.lit(1).alias("_k"))
    marks = markers.select(*key, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(ts).alias("_t"), F.lit(0).alias("_k"))
    extra = [F.col(f"_row.{c}") for c in order or []]
    w = Window.partitionBy(*key).orderBy("_t", "_k", *extra)
    both = rows.union(marks).withColumn("_marks", F.sum(1 - F.col("_k")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_k = 1")
    first = F.row_number().over(w) == 1
    cut = F.when(~first & (F.col("_marks") > F.lag("_marks").over(w)), 1).otherwise(0)
    out = both.withColumn("_cut", cut).withColumn("episode", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*key, "_row.*", "episode")


def post_filter(df: DataFrame, key: list[str], order: list[str], drop_first: int = 0, min_length: int = 1) -> DataFrame:
    """Drop the first rows of each episode, then episodes of fewer than ``min_length`` rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    left = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > drop_first).drop("_n")
    return left.withColumn("_len", F.count("*").over(Window.partitionBy(*key))).where(F.col("_len") >= min_length).drop("_len")


def runs(df: DataFrame, key: list[str], index: str, flag: Column) -> DataFrame:
    """Maximal runs of neighbouring rows where ``flag`` holds: ``start`` and exclusive ``end`` positions."""
    w = Window.partitionBy(*key).orderBy(index)
    numbered = df.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_on", F.coalesce(flag, F.lit(False)))
    on = numbered.where("_on").withColumn("_island", F.col("_pos") - F.row_number().over(w))
    return on.groupBy(*key, "_island").agg(F.min("_pos").cast("long").alias("start"), (F.max("_pos") + 1).cast("long").alias("end")).drop("_island")


def min_duration_events(df: DataFrame, key: list[str], index: str, ts: str, flag: Column, min_seconds: float = 0.5) -> DataFrame:
    """Runs of flagged transitions (each ends at its row) as events over all samples they touch.

    An event has ``start``, exclusive ``end`` positions and the times of its first and
    last sample, and is kept if those lie ``min_seconds`` or more apart.
    """
    w = Window.partitionBy(*key).orderBy(index)
    timed = df.withColumns({"_t0": F.lag(ts).over(w), "_pos": F.row_number().over(w) - 1, "_on": F.coalesce(flag, F.lit(False))})
    on = timed.where("_on").withColumn("_island", F.col("_pos") - F.row_number().over(w))
    events = on.groupBy(*key, "_island").agg(
        (F.min("_pos") - 1).cast("long").alias("start"), (F.max("_pos") + 1).cast("long").alias("end"), F.min("_t0").alias("start_time"), F.max(ts).alias("end_time")
    )
    return events.where(F.col("end_time") - F.col("start_time") + 1e-9 >= min_seconds).drop("_island")
