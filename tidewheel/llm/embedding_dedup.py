"""Embedding near-duplicates by product quantisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import near
from tidewheel.llm.common import min_labels
from tidewheel.operators.components import connected_components
from tidewheel.session import materialize


class Links:
    """Turns a block's pairs into link counts and connecting edges, never all pairs.

    Rows ``a, n`` count links of ``a``; rows ``a, b`` are edges that connect what is linked.
    """

    schema = "a long, b long, n long"

    def __init__(self, rep: np.ndarray, mult: np.ndarray):
        self.rep, self.mult = rep, mult
        self.counts, self.labels = np.zeros(len(rep), "i8"), np.arange(len(rep))
        self.first: dict[int, int] = {}

    @staticmethod
    def batch(a, n, x, y):
        zeros = np.zeros(len(x), "i8")
        edge = np.arange(len(a) + len(x)) >= len(a)
        return pa.RecordBatch.from_pydict({"a": np.concatenate([a, x]), "b": pa.array(np.concatenate([np.zeros(len(a), "i8"), y]), mask=~edge), "n": np.concatenate([n, zeros])})

    def add(self, rep, mult, a, b, cos):
        self.counts += np.bincount(b, mult[a], minlength=len(self.rep)).astype("i8")
        who, at = np.unique(a, return_inverse=True)
        mine = np.bincount(at, self.mult[b], minlength=len(who)).astype("i8")
        # the query joins one held vector, and what it is linked to joins that one
        order = np.argsort(at, kind="stable")
        star = b[order][np.searchsorted(at[order], np.arange(len(who)))]
        min_labels(self.labels, star[at], b)
        yield self.batch(rep[who], mine, rep[who], self.rep[star])

    def finish(self):
        some, moved = np.flatnonzero(self.counts), np.flatnonzero(self.labels != np.arange(len(self.rep)))
        yield self.batch(self.rep[some], self.counts[some], self.rep[moved], self.rep[self.labels[moved]])


def near_vectors(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", threshold: float = 0.9, share: float | None = None) -> DataFrame:
    """Vectors linked by cosine of ``threshold`` or more, in double precision.

    Equal vectors are one class, so copies are compared once. Classes are assigned to
    coarse lists and coded; each probes the lists that can hold a partner (see
    ``near.Index``; ``share`` 1 proves that none is missed, the default leaves out what
    only a pair in an unlikely direction would need), table look-ups drop what is out of
    reach, and the rest is compared exactly. Groups of lists larger than
    ``near.BLOCK_ROWS`` are split. Links inside a block become counts and connecting
    edges, never all pairs.

    Null and empty vectors, those of zero length and those with null or non-finite
    components link with nothing; vectors of different length never link. A row
    without an id has ``n_links`` 0 and no component, and counts for nobody. Rows of
    equal id are one node of the components. Returns ``vec_id, n_links, component_id,
    kept``; a vector that links with nothing is its own component.
    """
    x = F.col("vec")
    good = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).alias("vec"))
    # nan < inf is false for no value: nan is the largest, so it is not below
    valid = rows.where(good)
    classes = materialize(valid.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("dim", F.size("vec")), "vectors")
    found = None
    for (dim,) in classes.select("dim").distinct().collect():  # one row per length of vector
        some = classes.where(F.col("dim") == dim).select(F.lit(0).cast("long").alias("part"), "rep", "mult", "vec")
        one = near.search(some, dim, threshold, Links, Links.schema, share)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = materialize(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    part = connected_components(found.where("b is not null"))
    tags = (
        classes.select("rep", "mult")
        .join(counts, "rep", "left")
        .join(part, F.col("rep") == F.col("node"), "left")
        .select("rep", "mult", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    # only vectors that come more than once have to be looked up again
    copies = valid.join(classes.where("mult > 1").select("vec", "rep"), "vec").select("vec_id", "rep").join(tags, "rep")
    singles = tags.where("mult = 1").withColumn("vec_id", F.col("rep"))
    out = singles.select("vec_id", "n_links", "component_id").unionByName(copies.select("vec_id", "n_links", "component_id"))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
