"""A quality classifier on random-indexing word vectors."""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_rows, pieces
from tidewheel.session import small_batches

#: Words are hashed to so many rows of so many dimensions: the model's size is fixed.
BUCKETS, DIM = 1 << 15, 48
BLOCK = 128
REACH = 2
#: Labelled documents that the network is fitted on at most, drawn by a hash of their id.
FIT_DOCS = 8000
HIDDEN = 32
REMEMBERED = 200_000
#: Stands beside each part in capitals.
_CAPITALS = zlib.crc32(b"\0capitals") % BUCKETS
_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


@functools.cache
def index_vectors(seed: int = 5) -> np.ndarray:
    """Sparse ternary random vectors, one per bucket, and zeros for the gap between documents."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + 1, DIM), "f4")
    for _ in range(2):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += 1
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] -= 1
    return out


class _Words(dict):
    """Word to the buckets of its parts, as bytes."""

    def __missing__(self, word: str) -> bytes:
        found = []
        for x in (word,) if word.isalpha() else _PARTS.findall(word):
            found.append(zlib.crc32(x.lower().encode()) % BUCKETS)
            if len(x) > 1 and x.isupper():
                found.append(_CAPITALS)
        made = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = made
        return made


_WORDS = _Words()


def buckets_of(text: str | None) -> np.ndarray:
    return np.frombuffer(b"".join(map(_WORDS.__getitem__, (text or "").split())), "<u4")


def _contexts(docs: list[np.ndarray], sums: np.ndarray) -> None:
    """Add to each bucket the index vectors of its neighbours."""
    gap = np.full(REACH, BUCKETS, "u4")
    ids = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    vectors = index_vectors()
    for at in range(0, len(ids) - 2 * REACH, 1 << 17):
        part = ids[at : at + (1 << 17) + 2 * REACH]
        seen = vectors[part]
        n = len(part) - 2 * REACH
        around = sum(seen[k : k + n] for k in range(2 * REACH + 1) if k != REACH)
        middle = part[REACH : REACH + n]
        order = np.argsort(middle, kind="stable")
        found, first = np.unique(middle[order], return_index=True)
        sums[found] += np.add.reduceat(around[order], first).astype("i8")


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all buckets over the whole corpus, each of length one.

    Every task sums its own documents; the sums, whole numbers, meet by blocks of
    buckets in tasks that add them as they come. The driver gets the fixed-size table.
    """

    def local(batches):
        sums = np.zeros((BUCKETS + 1, DIM), "i8")
        for rows in pieces(batches):
            _contexts([buckets_of(x) for x in rows.column(0).to_pylist()], sums)
        blocks = sums[:BUCKETS].astype("i4").reshape(-1, BLOCK * DIM)
        some = np.flatnonzero(blocks.any(axis=1))
        for k in range(0, len(some), 64):
            yield pa.RecordBatch.from_pydict({"block": some[k : k + 64].astype("i4"), "sums": [blocks[b].tobytes() for b in some[k : k + 64]]})

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(b, np.zeros(BLOCK * DIM, "i8"))
                sums[b] += np.frombuffer(raw, "i4")
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "block int, sums binary"
    small_batches(docs.sparkSession)
    width = min(BUCKETS // BLOCK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = docs.select(text).mapInArrow(local, schema).repartition(width, "block").mapInArrow(total, schema)
    vectors = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for block, raw in found.collect():  # BUCKETS / BLOCK rows
        vectors[block] = np.frombuffer(raw, "i8")
    vectors = vectors.reshape(BUCKETS, DIM)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype("f4")


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """A document as the mean and spread of its word vectors, the mean over distinct words, and how varied it is."""
    ids = buckets_of(text)
    if not len(ids):
        return np.zeros(3 * DIM + 2, "f4")
    found, n = np.unique(ids, return_counts=True)
    x, share = vectors[found], (n / len(ids)).astype("f4")
    mean = share @ x
    return np.concatenate([mean, np.sqrt(np.maximum(share @ (x * x) - mean * mean, 0)), x.mean(axis=0), [len(found) / len(ids), np.log1p(len(ids)) / 10]]).astype("f4")


class Network:
    """Two layers, trained by Adam; a temperature, fitted on documents set aside, calibrates its logits."""

    def __init__(self, seed: int = 3, epochs: int = 40):
        self.seed, self.epochs, self.temperature, self.constant = seed, epochs, 1.0, None

    def fit(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Network:
        if len(y) < 20 or len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        train = np.flatnonzero(~aside) if 0 < (~aside).sum() and len(np.unique(y[~aside])) > 1 else np.arange(len(y))
        x, weight = (x - self.mean) / self.scale, np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(self.epochs):
            order = rng.permutation(train)
            for at in range(0, len(order), 128):
                b, t = order[at : at + 128], t + 1
                h = np.tanh(x[b] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[b]) * weight[b] / len(b)
                back = np.outer(d, self.p[2]) * (1 - h * h)
                grads = [x[b].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        held = np.flatnonzero(aside)
        if len(held) >= 20:
            z, target = self._logits(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, z / c) - target * z / c) for c in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", fit_docs: int = FIT_DOCS, threshold: float = 0.7) -> DataFrame:
    """Score every whole text for quality.

    Word vectors are gathered from all documents; the network learns from at most
    ``fit_docs`` labelled ones whose crc32(id as text) mod 4 is not 2, a fifth of which
    set the temperature. Only the text is an input of a score. A text without words is
    a vector of zeros and scored like any other; without labels of both kinds every
    score is the share of label 1 (0.5 without any). Null labels teach nothing. Every row
    gives one row: ids may be null (never held out) or repeated (a label teaches with
    each of its rows), equal texts have equal scores. Whole texts count, however long; a
    task holds a few of them at a time. An empty table gives an empty table, and other
    columns take no part, whatever their names.

    Returns ``doc_id, held_out, score, predicted`` (1 if score >= ``threshold``).
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text))  # BUCKETS x DIM, whatever the corpus
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    width = 3 * DIM + 2

    def vectorise(rows):
        x = np.stack([pooled(t, vectors.value) for t in rows.column("text").to_pylist()])
        return {"doc_id": rows.column("doc_id"), "y": rows.column("y"), "x": pa.FixedSizeListArray.from_arrays(x.ravel(), width).cast(pa.list_(pa.float32()))}

    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(~held_out() & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(fit_docs)
    # fit_docs rows at most on either side
    taught = map_rows(source.join(F.broadcast(drawn), "doc_id"), vectorise, "doc_id long, y int, x array<float>").orderBy("doc_id", "y").limit(2 * fit_docs).toArrow()
    ids, y = taught.column("doc_id").to_numpy(), taught.column("y").to_numpy().astype("f8")
    x = np.asarray(taught.column("x").combine_chunks().flatten(), "f8").reshape(-1, width)
    net = spark.sparkContext.broadcast(Network().fit(x, y, (ids * 2654435761 >> 7) % 5 == 0))

    def score(rows):
        s = net.value.score(np.stack([pooled(t, vectors.value) for t in rows.column("text").to_pylist()]).astype("f8"))
        return {"doc_id": rows.column("doc_id"), "score": s}

    out = map_rows(source, score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
