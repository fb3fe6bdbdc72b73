"""An index of a catalog's vectors that stays: lists, codes and vectors as tables, and searches of what is new.

``_index/<model>/<version>`` holds ``lists`` and ``books`` (bounded), and a table of
vectors with their list and codes, laid out by group of lists, to which each run adds.
``state.json`` says which commits are covered, at which threshold, and which tables count, so
a run that stops halfway leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import near, vectors
from tidewheel.session import materialize

#: An index is fitted anew when it holds so many times the vectors that it was fitted on.
REFIT = 4
_STORED = "part long, rep long, own int, norm double, codes binary, off double, vec array<double>, _id string, camera string"


class VectorIndex:
    """The index of one model's vectors of one dimension."""

    def __init__(self, catalog, model_id: str, dim: int, metric: str):
        self.catalog, self.spark, self.files, self.dim, self.metric = catalog, catalog.spark, catalog.files, dim, metric
        self.folder = f"_index/{hashlib.sha1(model_id.encode()).hexdigest()[:16]}-{dim}-{metric}"
        name = f"{self.folder}/state.json"
        self.state = json.loads(self.files.read(name)) if self.files.exists(name) else None

    def _path(self, name: str) -> str:
        return f"{self.catalog.root}/{name}"

    # --- the tables

    def load(self) -> near.Index:
        """The fitted lists and codebooks."""
        at = self.state["fitted"]
        index = near.Index.__new__(near.Index)
        lists = self.spark.read.parquet(self._path(f"{at}/lists")).orderBy("list").collect()  # near.MOST_LISTS rows at most
        books = self.spark.read.parquet(self._path(f"{at}/books")).orderBy("space", "code").collect()  # near.SUBSPACES times near.CODES rows at most
        index.dim, index.share, index.one_sided = self.dim, 1.0, False
        index.lists = np.array([r["centre"] for r in lists])
        index.group_of = np.array([r["group"] for r in lists])
        index.groups = [np.flatnonzero(index.group_of == g) for g in range(self.state["groups"])]
        index.spans = [tuple(s) for s in self.state["spans"]]
        index.books = [np.array([r["centre"] for r in books if r["space"] == m]) for m in range(len(index.spans))]
        return index

    def _store_fitted(self, index: near.Index) -> str:
        at = f"{self.folder}/fitted-{uuid.uuid4().hex[:12]}"
        lists = [(k, int(g), [float(v) for v in c]) for k, (g, c) in enumerate(zip(index.group_of, index.lists, strict=True))]
        books = [(m, k, [float(v) for v in c]) for m, book in enumerate(index.books) for k, c in enumerate(book)]
        self.spark.createDataFrame(lists, "list int, `group` int, centre array<double>").write.parquet(self._path(f"{at}/lists"))
        self.spark.createDataFrame(books, "space int, code int, centre array<double>").write.parquet(self._path(f"{at}/books"))
        return at

    def _store_vectors(self, index: near.Index, rows: DataFrame) -> str:
        """Write vectors with list and codes, files by group and rows by list."""
        at, dim = f"{self.folder}/vectors-{uuid.uuid4().hex[:12]}", self.dim
        shared = self.spark.sparkContext.broadcast(index)  # bounded, see near

        def encode(batches):
            for batch in batches:
                x = near.unit_rows(near.matrix(batch.column("vec"), dim))
                # probes are not needed, so nothing is probed
                own = np.concatenate([np.argmax(x[k : k + near.PLACE_ROWS] @ shared.value.lists.T, axis=1) for k in range(0, len(x), near.PLACE_ROWS)])
                codes, off = shared.value.encode(x, own)
                columns = {n: batch.column(n) for n in ("part", "rep", "norm", "vec", "_id", "camera")}
                yield pa.RecordBatch.from_pydict(columns | {"own": own.astype("i4"), "codes": [c.tobytes() for c in codes], "off": off, "group": shared.value.group_of[own].astype("i4")})

        kinds = "part long, rep long, norm double, vec array<double>, _id string, camera string, own int, codes binary, off double, `group` int"
        placed = rows.select("part", "rep", "norm", "vec", "_id", "camera").mapInArrow(encode, kinds)
        placed.repartition("group").sortWithinPartitions("group", "own").write.partitionBy("group").parquet(self._path(at))
        return at

    def stored(self) -> DataFrame:
        """All indexed vectors; the column ``group`` is a folder, so a filter on it leaves files out."""
        paths = [self._path(t) for t in self.state["tables"]]
        parts = [self.spark.read.schema(f"{_STORED}, `group` int").parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def probed(self, index: near.Index, rows: DataFrame) -> DataFrame:
        """The indexed vectors of the lists that some rows (with ``band``) probe; no other group's files are read."""
        shared, dim = self.spark.sparkContext.broadcast(index), self.dim

        def lists(batches):
            met = np.zeros(len(shared.value.lists), bool)
            for batch in batches:
                x, bands = near.unit_rows(near.matrix(batch.column("vec"), dim)), batch.column("band").to_numpy()
                reach = shared.value.reaches.max(axis=1)[bands]
                for k in range(0, len(x), near.PLACE_ROWS):
                    met |= shared.value.place(x[k : k + near.PLACE_ROWS], reach[k : k + near.PLACE_ROWS])[1].any(axis=0)
            yield pa.RecordBatch.from_pydict({"own": np.flatnonzero(met).astype("i4")})

        wanted = [r[0] for r in rows.select("vec", "band").mapInArrow(lists, "own int").distinct().collect()]  # near.MOST_LISTS at most
        groups = sorted({int(index.group_of[k]) for k in wanted})
        return self.stored().where(F.col("group").isin(groups) & F.col("own").isin(wanted))

    # --- a run

    def update(self, rows: DataFrame, total: int, head: int, threshold: float) -> tuple[DataFrame | None, dict]:
        """Pairs that the given rows make, with each other and with what is indexed, and the state to save once they are kept.

        ``rows`` are ``vectors.usable`` rows with ``camera``. A lower threshold than before, or
        ``REFIT`` times the rows, needs all rows; the caller gives them by ``needs_all``.
        """
        fresh = self.needs_all(threshold, total)
        base = 0 if fresh else self.state["next"]
        rows = materialize(rows.withColumns({"rep": F.monotonically_increasing_id() + base, "mult": F.lit(1).cast("long"), "_k0": F.col("camera")}), "vectors")
        limits, tops = threshold - 1e-9, []
        if self.metric == "dot":
            norms = rows.select("norm") if fresh else rows.select("norm").unionByName(self.stored().select("norm"))
            tops = vectors.band_tops(norms, threshold)
            limits = vectors.band_thresholds(tops, threshold)
        band = vectors.band_of(F.col("norm"), tops) if tops else F.lit(0)
        rows_ = rows.withColumn("band", band)
        index = near.fit(rows, self.dim, limits, share=1.0) if fresh else self.load()
        index.limit(limits)
        known = None
        if not fresh:
            index.one_sided = True
            known = materialize(self.probed(index, rows_).withColumns({"band": band, "mult": F.lit(1).cast("long"), "_k0": F.col("camera")}), "probed")
        found = None
        if (np.atleast_2d(limits) <= 1 + 1e-9).any():
            if near.dense(rows_, self.dim, limits, None if fresh else index):
                of = lambda x, old: x.select("part", "rep", "vec", "band", F.lit(old).alias("known"))
                found = near.all_products(of(rows_, False) if known is None else of(rows_, False).unionByName(of(known, True)), self.dim, limits)
            else:
                found = near.search(rows_, self.dim, limits, near.Pairs, near.Pairs.schema, index=index, known=known)
        both = rows.select("rep", "_id", "norm", "_k0")
        pairs = None
        if found is not None:
            pairs = vectors.scored_pairs(found, both if known is None else both.unionByName(known.select("rep", "_id", "norm", "_k0")), ["_k0"], threshold, self.metric)
        index.one_sided = False
        table = self._store_vectors(index, rows)
        last = rows.agg(F.max("rep")).first()[0]
        kept = {} if fresh else self.state
        state = {
            "fitted": self._store_fitted(index) if fresh else kept["fitted"], "fitted_rows": total if fresh else kept["fitted_rows"], "groups": len(index.groups), "spans": index.spans, "tables": [*([] if fresh else kept["tables"]), table],
            "rows": total, "next": last + 1, "head": head, "threshold": threshold if fresh else kept["threshold"],
        }
        return pairs, state

    def needs_all(self, threshold: float, total: int) -> bool:
        return self.state is None or threshold < self.state["threshold"] or total >= REFIT * self.state["fitted_rows"]

    def save(self, state: dict) -> None:
        self.files.write(f"{self.folder}/state.json", json.dumps(state))
        self.state = state
