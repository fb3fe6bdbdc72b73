"""Vector arithmetic as JVM-side higher-order functions, and search with it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.functions import near
from tidewheel.session import materialize


def _double(x: Column) -> Column:
    return F.transform(x, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    return F.try_divide(dot(a, b), length(a) * length(b))


def search(vectors: DataFrame, query: list[float], top: int = 10, id_col: str = "episode_id", vec: str = "vector", per: str | None = "camera") -> DataFrame:
    """The ``top`` ids by cosine to a query vector, the best of each id's vectors; ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(id_col, *([per] if per else []), cosine(F.col(vec), q).alias("score")).where("score is not null")
    best = F.max_by(F.struct("score", *([per] if per else [])), "score")
    return scored.groupBy(id_col).agg(best.alias("b")).select(id_col, "b.*").orderBy(F.desc("score"), id_col).limit(top)


#: Bands of length that vectors are dealt to for dot products, at most.
BANDS = 24


def band_tops(norms: DataFrame, threshold: float, most: int = BANDS) -> list[float]:
    """The greatest length in each band of a column ``norm``, shortest band first.

    A band is about half an octave wide, or wider if there would be more than ``most``.
    Vectors too short for a product of ``threshold`` even with the longest count for the
    lowest band.
    """
    longest = norms.agg(F.max("norm")).first()[0]
    if longest is None:
        return []
    low = threshold / longest
    octaves = max(0.5, math.log2(max(longest / low, 1.0)) / (most - 1))
    # bands end a little above powers of two, so that vectors of length one are in one band
    k = F.greatest(F.floor(F.log2(F.greatest(F.col("norm"), F.lit(low)) / F.lit(1.01)) / F.lit(octaves)), F.floor(F.log2(F.lit(low / 1.01)) / F.lit(octaves)))
    return [r["top"] for r in norms.groupBy(k.alias("k")).agg(F.max("norm").alias("top")).orderBy("k").collect()]  # a row for each band


def band_of(norm: Column, tops: list[float]) -> Column:
    """The first band whose top a length does not pass."""
    out = F.lit(len(tops) - 1)
    for k in range(len(tops) - 2, -1, -1):
        out = F.when(norm <= F.lit(tops[k]), k).otherwise(out)
    return out.cast("int")


def band_thresholds(tops: list[float], threshold: float) -> np.ndarray:
    """The least cosine that gives a product of ``threshold``, for each pair of bands; above 1 where none does."""
    return threshold / np.outer(tops, tops) - 1e-9


def usable(vectors: DataFrame, id_col: str, vec: str, block: list[str]) -> DataFrame:
    """Vectors that can be in a pair: ``_id``, the block's columns as ``_k0``..., ``part``, ``vec``, ``dim`` and ``norm``."""
    x = _double(F.col(vec))
    by = F.xxhash64(*(block or [F.lit(0)]))
    rows = vectors.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_k{n}") for n, c in enumerate(block)), by.alias("part"), x.alias("vec"))
    return rows.where("_id is not null and size(vec) > 0 and exists(vec, v -> v <> 0) and forall(vec, v -> abs(v) < double('inf'))").withColumns({"dim": F.size("vec"), "norm": length(F.col("vec"))})


def scored_pairs(found: DataFrame, rows: DataFrame, keys: list[str], threshold: float, metric: str) -> DataFrame:
    """Pairs of ids from pairs ``a, b, cosine`` of ``rep``: those at the threshold, the highest over blocks."""
    side = lambda n: rows.select(F.col("rep").alias(n), F.col("_id").alias(f"_{n}"), F.col("norm").alias(f"_n{n}"), F.struct(F.lit(0), *keys).alias(f"_k{n}"))
    both = found.join(side("a"), "a").join(side("b"), "b").where("_ka <=> _kb and _a <> _b")
    value = F.col("cosine") if metric == "cosine" else F.col("cosine") * F.col("_na") * F.col("_nb")
    scored = both.select(F.least("_a", "_b").alias("episode_a"), F.greatest("_a", "_b").alias("episode_b"), value.alias("similarity")).where(F.col("similarity") >= threshold)
    if rows.select("_id").distinct().count() == rows.count():
        return scored  # each pair is there once
    return scored.groupBy("episode_a", "episode_b").agg(F.max("similarity").alias("similarity"))


def check_metric(threshold: float, metric: str) -> None:
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    if metric not in ("dot", "cosine"):
        raise ValueError("metric must be dot or cosine")


def similar_pairs(vectors: DataFrame, threshold: float = 0.97, id_col: str = "episode_id", vec: str = "vector", block: list[str] | None = None, metric: str = "dot") -> DataFrame:
    """Pairs ``episode_a < episode_b`` of similarity at ``threshold`` or above, the highest over blocks.

    Vectors meet within a block (camera and model) through the index of ``near``, with
    margins that miss no pair; where these are so wide that most lists would be probed, the
    products of all pairs are taken, block by block. For dot products vectors are dealt to bands of length: a
    product of t between vectors no longer than m and n is a cosine of t / (m n) or more,
    so each pair of bands is searched for a cosine of its own, and bands too short for
    each other not at all. One long vector widens only the search of its own band. The
    product itself decides. The threshold must be above 0. Nulls and NaN in a vector count as 0;
    a null or empty vector, one of zeros and one with an infinite number are in no pair;
    vectors of different length never meet.
    """
    check_metric(threshold, metric)
    rows = usable(vectors, id_col, vec, block or [])
    rows = materialize(rows.withColumns({"rep": F.monotonically_increasing_id(), "mult": F.lit(1).cast("long")}), "vectors")
    found = None
    for (dim,) in rows.select("dim").distinct().collect():  # one row per length of vector
        some = rows.where(F.col("dim") == dim)
        limits: float | np.ndarray = threshold - 1e-9
        if metric == "dot":
            tops = band_tops(some, threshold)
            limits = band_thresholds(tops, threshold)
            if (limits > 1 + 1e-9).all():
                continue
            some = some.withColumn("band", band_of(F.col("norm"), tops))
        elif threshold > 1 + 1e-9:
            continue
        if near.dense(some, dim, limits):
            one = near.all_products(some, dim, limits)
        else:
            one = near.search(some, dim, limits, near.Pairs, near.Pairs.schema, share=1.0)
        found = one if found is None else found.unionByName(one)
    kind = vectors.schema[id_col].dataType.simpleString()
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"episode_a {kind}, episode_b {kind}, similarity double")
    return scored_pairs(found, rows, [f"_k{n}" for n in range(len(block or []))], threshold, metric)


def mean_vector(vectors: DataFrame, key: list[str], vec: str = "vector") -> DataFrame:
    x = vectors.select(*key, F.posexplode(vec).alias("d", "x")).groupBy(*key, "d").agg(F.avg("x").alias("x"))
    return x.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(vec))


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
