"""Numbers and running sums over a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.session import materialize


def number_rows(df: DataFrame, key: str, index: str, weight: Column | None = None, base: str = "_base") -> DataFrame:
    """Number the rows from 0 in ascending order of ``key``; ``base`` is the sum of ``weight`` over the rows before.

    Keys are distinct and not null (rows of a null key are left out). The rows are dealt
    by ranges of the key and written, so their places are fixed; only a count and a sum
    per range reach the driver. An empty table stays empty.
    """
    kept = df.where(F.col(key).isNotNull()).withColumn("_w", (F.lit(0) if weight is None else weight).cast("long"))
    placed = materialize(kept.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "numbered")
    totals = placed.groupBy("_p").agg(F.min(key).alias("_k"), F.count("*").alias("n"), F.sum("_w").alias("w")).orderBy("_k").collect()
    bases, rows, sums = [], 0, 0
    for r in totals:
        bases.append((r["_p"], rows, sums))
        rows, sums = rows + r["n"], sums + r["w"]
    before = df.sparkSession.createDataFrame(bases, "_p int, _rows long, _sums long")
    w = Window.partitionBy("_p").orderBy(key)
    local = placed.withColumns({"_i": F.row_number().over(w) - 1, "_s": F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")})
    out = local.join(F.broadcast(before), "_p").withColumns({index: F.col("_rows") + F.col("_i"), base: F.col("_sums") + F.col("_s")})
    dropped = ["_p", "_w", "_i", "_s", "_rows", "_sums"] + ([base] if weight is None else [])
    return out.drop(*dropped)


def places(df: DataFrame, part: str, order: list[Column], weight: Column | None = None) -> DataFrame:
    """Adds ``_before`` and ``_all``, the sums of ``weight`` (1 if not given) over the rows before and over all of a ``part``, and ``_row``, the rows before.

    The rows are dealt by ranges of part and order and written, so a part, however large, is
    several tasks' work; only sums per range and part go through windows. Rows that ``order``
    leaves open stand in any order. A null part is a part.
    """
    placed = materialize(df.repartitionByRange(F.col(part), *order).withColumns({"_w": (F.lit(1) if weight is None else weight).cast("long"), "_p": F.spark_partition_id()}), "placed")
    totals = placed.groupBy(F.col(part).alias("_part"), F.col("_p").alias("_q")).agg(F.sum("_w").alias("_s"), F.count("*").alias("_c"))
    whole = Window.partitionBy("_part")
    earlier = whole.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    ranges = totals.select("_part", "_q", F.coalesce(F.sum("_s").over(earlier), none).alias("_s0"), F.coalesce(F.sum("_c").over(earlier), none).alias("_c0"), F.sum("_s").over(whole).alias("_all"))
    w = Window.partitionBy("_p", part).orderBy(*order)
    local = placed.withColumns({"_i": F.row_number().over(w) - 1, "_t": F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")})
    out = local.join(F.broadcast(ranges), (F.col("_p") == F.col("_q")) & F.col(part).eqNullSafe(F.col("_part")))  # ranges and parts, added
    return out.withColumns({"_row": F.col("_c0") + F.col("_i"), "_before": F.col("_s0") + F.col("_t")}).drop("_w", "_p", "_q", "_part", "_i", "_t", "_s0", "_c0")
