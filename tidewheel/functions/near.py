"""Near vectors by product quantisation: coarse inverted lists, residual codes, table look-ups, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import blocks
from tidewheel.session import materialize

#: The index is fitted on so many vectors and values at most, drawn by a hash; all are indexed.
FIT_ROWS, FIT_VALUES = 65_536, 1 << 23
SUBSPACES = 8
CODES = 256
#: Vectors of a list on average, and lists at most.
LIST_ROWS, MOST_LISTS = 64, 4096
#: Neighbouring lists that are searched together, so that a query travels once for all of them.
GROUP_LISTS = 32
#: Vectors that a task holds; larger groups are several blocks.
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
PLACE_ROWS = 512
#: Pairs whose table look-ups are summed at a time.
PAIRS = 1 << 21
#: Vectors that tell whether lists are worth it, and the share of lists probed above which products of all pairs cost less.
TRIED, DENSE = 4096, 1 / 8
#: Numbers that a block of vectors holds at most, and products made at a time.
BLOCK_VALUES, TILE_ROWS = 1 << 21, 64
#: Standard deviations of a direction's cosine that the probes allow for (see ``Index``).
DEVIATIONS = 3.3


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - 0.5 * (centres**2).sum(1), axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        centres[found] = np.add.reduceat(x[order], first, axis=0) / np.diff([*first, len(x)])[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim).astype("f8")


class Index:
    """Coarse unit centroids in groups, and codebooks for what remains after the nearest one.

    Vector x probes every list c whose centroid is less similar to it than its own
    list's by at most ``share * reach / 2 * |c - own|``. With ``share`` 1 no pair within
    ``reach`` (Euclidean, of unit vectors) is ever missed: were y in list c not probed by
    x, and x in its list not probed by y, the two margins would add up to more than
    ``|x - y| * |c - own|``, against Cauchy-Schwarz. A pair is missed with a lesser share
    only if the cosine between x - y and c - own is above it. Of a direction without
    preference that cosine has the deviation 1 / sqrt(dimensions), so by default the
    share is ``DEVIATIONS`` of these, and 1 for eleven dimensions or fewer.

    ``threshold`` may be a square table: vectors come in bands, and a pair of bands has a
    cosine of its own, above 1 where no pair is wanted. Where only one side queries
    (``one_sided``), its margin is twice as wide, which proves the same.
    """

    def __init__(self, sample: np.ndarray, rows: int, threshold: float | np.ndarray, seed: int = 11, share: float | None = None):
        rng = np.random.default_rng(seed)
        self.dim, self.one_sided = sample.shape[1], False
        self.limit(threshold)
        self.share = min(1.0, DEVIATIONS / math.sqrt(self.dim)) if share is None else share
        k = min(-(-len(sample) // 8), max(1, min(MOST_LISTS, rows // LIST_ROWS)))
        self.lists = kmeans(sample, k, 8, rng, unit=True)
        n_groups = -(-k // GROUP_LISTS)
        heads = kmeans(self.lists, n_groups, 6, rng, unit=True)
        self.group_of = np.argmax(self.lists @ heads.T, axis=1)
        self.groups = [np.flatnonzero(self.group_of == g) for g in range(n_groups)]
        self.spans = [(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))]
        few = sample[: 64 * CODES]
        rest = few - self.lists[np.argmax(few @ self.lists.T, axis=1)]
        self.books = [kmeans(rest[:, a:b], min(CODES, len(few)), 5, rng) for a, b in self.spans]

    def limit(self, threshold: float | np.ndarray) -> None:
        """Look for other cosines from now on."""
        self.thresholds = np.atleast_2d(np.asarray(threshold, "f8"))
        self.reaches = np.where(self.thresholds > 1 + 1e-9, -1.0, np.sqrt(np.maximum(0.0, 2 - 2 * self.thresholds)) + 1e-6)
        self.threshold, self.reach = float(self.thresholds.min()), float(self.reaches.max())

    def place(self, x: np.ndarray, reach: float | np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors: own list, and the lists to probe (own included); ``reach`` may differ by vector, and below 0 probes nothing."""
        own, probes = np.zeros(len(x), "i8"), np.zeros((len(x), len(self.lists)), bool)
        reach = np.broadcast_to(self.reach if reach is None else reach, len(x))
        for at in range(0, len(x), PLACE_ROWS):
            s = slice(at, at + PLACE_ROWS)
            sim = x[s] @ self.lists.T
            own[s] = np.argmax(sim, axis=1)
            probes[s] = self._probed(sim, sim[np.arange(len(sim)), own[s]], own[s], self.lists, reach[s])
        return own, probes

    def probed(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray, reach: float | None = None) -> np.ndarray:
        """Which of some lists are probed by vectors whose own list is known."""
        some = self.lists[lists]
        return self._probed(x @ some.T, np.einsum("ij,ij->i", x, self.lists[own]), own, some, np.broadcast_to(self.reach if reach is None else reach, len(x)))

    def _probed(self, sim: np.ndarray, top: np.ndarray, own: np.ndarray, some: np.ndarray, reach: np.ndarray) -> np.ndarray:
        gap = np.sqrt(np.maximum(0, 2 - 2 * self.lists[own] @ some.T))
        margin = self.share * (1.0 if self.one_sided else 0.5) * reach
        return (sim >= top[:, None] - margin[:, None] * gap - 1e-6) & (reach >= 0)[:, None]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of what remains after the own centroid, and how far they are off."""
        rest = x - self.lists[own]
        codes, off = np.zeros((len(x), len(self.spans)), "u1"), np.zeros(len(x))
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            codes[:, m] = np.argmax(rest[:, a:b] @ book.T - 0.5 * (book**2).sum(1), axis=1)
            off += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(off)

    def near(self, x: np.ndarray, own: int, codes: np.ndarray, off: np.ndarray, reach: float | None = None) -> np.ndarray:
        """Which (query, coded vector of list ``own``) pairs can be within reach.

        The asymmetric distance, a sum of table look-ups, is that to the vector the codes
        stand for; it is off by ``off`` at most, so nothing within reach is lost.
        """
        rest = (x - self.lists[own]).astype("f4")
        total = np.zeros((len(x), len(codes)), "f4")
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            part = rest[:, a:b]
            look_up = (part**2).sum(1)[:, None] - 2 * part @ book.T.astype("f4") + (book**2).sum(1).astype("f4")
            total += np.take(look_up, codes[:, m], axis=1)
        return total <= (((self.reach if reach is None else reach) + off + 1e-3) ** 2).astype("f4")


class Block:
    """Vectors of one group of lists and one band that a task holds, and the pairs that queries make with them.

    ``known`` marks held vectors that do not query themselves; ``codes`` and ``off`` are made
    where they are not given.
    """

    def __init__(self, index: Index, rep: np.ndarray, own: np.ndarray, x: np.ndarray, band: int = 0, known: np.ndarray | None = None, codes: np.ndarray | None = None, off: np.ndarray | None = None):
        self.index, self.band = index, band
        order = np.argsort(own, kind="stable")
        self.order, self.rep, self.x, self.own = order, rep[order], x[order], own[order]
        self.known = np.zeros(len(rep), bool) if known is None else known[order]
        self.codes, self.off = index.encode(self.x, self.own) if codes is None else (codes[order], off[order])
        self.probes: dict[int, np.ndarray] = {}
        self.lists, first = np.unique(self.own, return_index=True)
        self.bounds = [*first.tolist(), len(rep)]

    def pairs(self, rep: np.ndarray, own: np.ndarray, x: np.ndarray, bands: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries and of held vectors (in the order given) within the threshold, and their cosines."""
        if bands is None or len(self.index.thresholds) == 1:
            yield from self._pairs(np.arange(len(rep)), rep, own, x, 0)
            return
        for band in np.unique(bands).tolist():
            q = np.flatnonzero(bands == band)
            if self.index.reaches[band, self.band] >= 0:
                yield from self._pairs(q, rep[q], own[q], x[q], band)

    def _pairs(self, place: np.ndarray, rep: np.ndarray, own: np.ndarray, x: np.ndarray, band: int):
        reach, threshold = self.index.reaches[band, self.band], self.index.thresholds[band, self.band]
        both_query = not self.index.one_sided
        if both_query and band not in self.probes:
            self.probes[band] = self.index.place(self.x, reach)[1]
        probed = self.index.probed(x, own, self.lists, reach)
        for k, c in enumerate(self.lists.tolist()):
            q = np.flatnonzero(probed[:, k])
            if not len(q):
                continue
            step = max(64, PAIRS // len(q))
            for at in range(self.bounds[k], self.bounds[k + 1], step):
                part = slice(at, min(at + step, self.bounds[k + 1]))
                maybe = self.index.near(x[q], c, self.codes[part], self.off[part], reach) & (rep[q][:, None] != self.rep[part][None, :])
                if both_query:
                    # a pair that both sides probe is found on the side of the smaller query
                    maybe &= ~self.probes[band][part][:, own[q]].T | (rep[q][:, None] < self.rep[part][None, :])
                else:
                    maybe &= self.known[part][None, :] | (rep[q][:, None] < self.rep[part][None, :])
                i, j = np.nonzero(maybe)
                for s in range(0, len(i), 65536):
                    a, b = q[i[s : s + 65536]], at + j[s : s + 65536]
                    cos = np.einsum("ij,ij->i", x[a], self.x[b])
                    hit = cos >= threshold
                    if hit.any():
                        yield place[a[hit]], self.order[b[hit]], cos[hit]


def fit(vectors: DataFrame, dim: int, threshold: float | np.ndarray, share: float | None = None) -> Index:
    """An index for these vectors, from a bounded sample of them."""
    rows = vectors.count()
    size = max(1, min(FIT_ROWS, FIT_VALUES // dim, 24 * max(LIST_ROWS, rows // LIST_ROWS)))
    drawn = vectors.orderBy(F.xxhash64("vec"), "rep").limit(size).select("vec").toArrow()
    return Index(unit_rows(matrix(drawn.column("vec").combine_chunks(), dim)), rows, threshold, share=share)


def dense(vectors: DataFrame, dim: int, threshold: float | np.ndarray, index: Index | None = None) -> bool:
    """Whether an index that misses no pair would probe so many lists that products of all pairs cost less.

    An index that is there, or a small one of a bounded sample, tells: what each pair of bands probes, against those that
    can have a pair at all. Both ways give the same pairs.
    """
    size = max(64, min(TRIED, FIT_VALUES // dim))
    banded = vectors if "band" in vectors.columns else vectors.withColumn("band", F.lit(0))
    drawn = banded.orderBy(F.xxhash64("vec"), "rep").limit(size).select("vec", "band").toArrow()
    if not drawn.num_rows:
        return False
    x, bands = unit_rows(matrix(drawn.column("vec").combine_chunks(), dim)), drawn.column("band").to_numpy()
    index = Index(x, len(x), threshold, share=1.0) if index is None else index
    share = np.bincount(bands, minlength=len(index.reaches)) / len(bands)
    probed = wanted = 0.0
    for i, j in zip(*np.nonzero(index.reaches >= 0), strict=True):
        some = x[:512][bands[:512] == i]
        if len(some):
            wanted += share[i] * share[j]
            probed += share[i] * share[j] * float(index.place(some, index.reaches[i, j])[1].mean())
    return probed > DENSE * wanted


def all_products(vectors: DataFrame, dim: int, threshold: float | np.ndarray) -> DataFrame:
    """Pairs ``a, b, cosine`` of ``search`` from the products of all vectors of a part, block by block.

    ``vectors``: ``part, rep, vec``, and ``band`` and ``known`` (boolean; two known vectors make no
    pair) where they are of more than one kind. A task holds two blocks.
    """
    spark = vectors.sparkSession
    limits = np.atleast_2d(np.asarray(threshold, "f8"))
    n = len(limits)
    for name, value in (("band", F.lit(0)), ("known", F.lit(False))):
        if name not in vectors.columns:
            vectors = vectors.withColumn(name, value)
    meets = np.tile(limits <= 1 + 1e-9, (2, 2))
    meets[n:, n:] = False
    rows = vectors.select("part", "rep", "vec", (F.col("band") + F.col("known").cast("int") * n).cast("int").alias("kind"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(part: int, first: pa.RecordBatch, second: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        sides = []
        for side in (first,) if second is None else (first, second):
            sides.append((side.column("rep").to_numpy(), side.column("kind")[0].as_py() % n, unit_rows(matrix(side.column("vec"), dim))))
        (rep, band, x), (other, other_band, y) = sides[0], sides[-1]
        least, y = limits[band, other_band], np.ascontiguousarray(y.T)
        for at in range(0, len(rep), TILE_ROWS):
            # of one block, only what comes after
            after = at if second is None else 0
            cos = x[at : at + TILE_ROWS] @ y[:, after:]
            i, j = np.divmod(np.flatnonzero(cos >= least), cos.shape[1])
            if second is None:
                i, j = (v[i < j] for v in (i, j))
            if len(i):
                a, b = rep[at + i], other[after + j]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": cos[i, j]})

    size = blocks.block_rows(rows.count(), width, max(1, min(blocks.MOST_ROWS, BLOCK_VALUES // dim)))
    return blocks.cells(blocks.deal(rows, "part", size, "kind", meets), "part", width, work, Pairs.schema)


def search(vectors: DataFrame, dim: int, threshold: float | np.ndarray, collector, schema: str, share: float | None = None, index: Index | None = None, known: DataFrame | None = None) -> DataFrame:
    """Let every vector query the index of all, and collect the pairs block by block.

    ``vectors`` has ``part`` (long: only vectors of one part meet), ``rep`` (long,
    distinct within a part), ``vec`` (``dim`` numbers, none null, finite, not all zero)
    and ``mult`` (long, carried along). Codes are made where the vectors arrive; a vector
    travels once to its own group of lists and once, as a query, to each group in which it
    probes a list. ``collector(block, mult)`` makes an object with ``add(rep, mult, a, b,
    cos)`` and ``finish()``, both generators of Arrow batches of ``schema``.

    With a table of thresholds, ``band`` (int) says which row and column of it a vector has;
    it queries the groups of every band that it can have a pair with, if anything is there.
    ``known`` (with ``own``, ``codes`` and ``off`` besides, made by ``index``) are vectors
    that are found but do not query: pairs among them are left out.
    """
    spark = vectors.sparkSession
    if index is None:
        index = fit(vectors, dim, threshold, share)
    index.limit(threshold)
    index.one_sided = known is not None
    shared = spark.sparkContext.broadcast(index)  # MOST_LISTS centroids and CODES codes a subspace at most
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bands = len(index.thresholds)
    if n_bands == 1:
        vectors = vectors.withColumn("band", F.lit(0))
        known = known if known is None else known.withColumn("band", F.lit(0))

    def place(batches):
        for batch in batches:
            own = shared.value.place(unit_rows(matrix(batch.column("vec"), dim)))[0]
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "group": shared.value.group_of[own].astype("i4"), "band": batch.column("band")})

    placed = vectors.select("part", "band", "vec").mapInArrow(place, "part long, group int, band int")
    if known is not None:
        group_of = F.array(*(F.lit(int(g)) for g in index.group_of))
        placed = placed.unionByName(known.select("part", F.element_at(group_of, F.col("own") + 1).alias("group"), "band"))
    placed = placed.groupBy("part", "group", "band").count()
    if n_bands > 1 or known is not None:
        placed = materialize(placed, "placed")
    # of groups larger than a block, so rows / BLOCK_ROWS at most
    blocks = {(p, g, b): -(-n // BLOCK_ROWS) for p, g, b, n in placed.where(F.col("count") > BLOCK_ROWS).collect()}
    there = np.ones((len(index.groups), n_bands), bool)
    if n_bands > 1:
        there[:] = False
        for g, b in placed.select("group", "band").distinct().collect():  # groups times bands at most
            there[g, b] = True

    def deal(batches):
        found = shared.value
        groups = np.zeros((len(found.lists), len(found.groups)), "f4")
        groups[np.arange(len(found.lists)), found.group_of] = 1
        for batch in batches:
            for at in range(0, batch.num_rows, PLACE_ROWS):
                rows_ = batch.slice(at, PLACE_ROWS)
                x = unit_rows(matrix(rows_.column("vec"), dim))
                rep, part, band = (rows_.column(n).to_numpy() for n in ("rep", "part", "band"))
                asks = []
                for to in range(n_bands):
                    own, probes = found.place(x, found.reaches[band, to] if n_bands > 1 else None)
                    reached = probes.astype("f4") @ groups
                    if n_bands > 1:
                        reached *= there[:, to]
                    who, where = np.nonzero(reached)
                    asks.append((who, where, np.full(len(who), to, "i4")))
                who, where, into = (np.concatenate(c) for c in zip(*asks, strict=True))
                mine = found.group_of[own]
                times = np.ones(len(who), "i8")
                block = np.zeros(len(own), "i8")
                if blocks:
                    times = np.array([blocks.get(k, 1) for k in zip(part[who].tolist(), where.tolist(), into.tolist())], "i8")
                    n_own = np.array([blocks.get(k, 1) for k in zip(part.tolist(), mine.tolist(), band.tolist())], "u8")
                    block = _block_of(rep, n_own)
                who, where, into = np.repeat(who, times), np.repeat(where, times), np.repeat(into, times)
                number = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                kind = np.concatenate([np.zeros(len(own), "i4"), np.ones(len(who), "i4")])
                who, where, number, into = np.concatenate([np.arange(len(own)), who]), np.concatenate([mine, where]), np.concatenate([block, number]), np.concatenate([band.astype("i4"), into])
                for s in range(0, len(who), 4096):
                    e = slice(s, s + 4096)
                    take = pa.array(who[e])
                    yield pa.RecordBatch.from_pydict(
                        {"part": rows_.column("part").take(take), "group": where[e].astype("i4"), "into": into[e], "block": number[e].astype("i4"), "kind": kind[e], "rep": rows_.column("rep").take(take), "mult": rows_.column("mult").take(take), "own": own[who[e]].astype("i4"), "band": band[who[e]].astype("i4"), "vec": rows_.column("vec").take(take)}
                    )

    def settle(batches):
        for batch in batches:
            own, rep = batch.column("own").to_numpy(), batch.column("rep").to_numpy()
            group = shared.value.group_of[own]
            block = np.zeros(len(own), "i8")
            if blocks:
                block = _block_of(rep, np.array([blocks.get(k, 1) for k in zip(batch.column("part").to_pylist(), group.tolist(), batch.column("band").to_pylist())], "u8"))
            yield pa.RecordBatch.from_pydict(
                {"part": batch.column("part"), "group": group.astype("i4"), "into": batch.column("band"), "block": block.astype("i4"), "kind": np.zeros(len(own), "i4"), "rep": rep, "mult": batch.column("mult"), "own": own.astype("i4"), "band": batch.column("band"), "vec": batch.column("vec"), "codes": batch.column("codes"), "off": batch.column("off")}
            )

    def meet(batches):
        key, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy() for n in ("part", "group", "into", "block", "kind")]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(cols[0])], strict=True):
                here = tuple(int(c[s]) for c in cols[:4])
                if here != key:
                    if held:
                        yield from held.finish()
                    key, parts, held = here, [], None
                some = batch.slice(s, e - s)
                rep, mult, own, band, x = some.column("rep").to_numpy(), some.column("mult").to_numpy(), some.column("own").to_numpy(), some.column("band").to_numpy(), unit_rows(matrix(some.column("vec"), dim))
                if cols[4][s] == 0:
                    parts.append((rep, mult, own, x, *_codes(shared.value, some, own, x)))
                    continue
                if held is None and parts:
                    rep_, mult_, own_, x_, known_, codes_, off_ = (np.concatenate([p[k] for p in parts]) for k in range(7))
                    held, block, parts = collector(rep_, mult_), Block(shared.value, rep_, own_, x_, key[2], known_, codes_, off_), []
                if held is None:
                    continue
                for at in range(0, len(rep), QUERY_ROWS):
                    q = slice(at, at + QUERY_ROWS)
                    for a, b, cos in block.pairs(rep[q], own[q], x[q], band[q]):
                        yield from held.add(rep[q], mult[q], a, b, cos)
        if held:
            yield from held.finish()

    kind = vectors.schema["vec"].dataType.simpleString()
    columns = f"part long, group int, into int, block int, kind int, rep long, mult long, own int, band int, vec {kind}"
    dealt = vectors.select("part", "rep", "mult", "band", "vec").mapInArrow(deal, columns)
    if known is not None:
        dealt = dealt.withColumns({"codes": F.lit(None).cast("binary"), "off": F.lit(None).cast("double")}).unionByName(known.select("part", "rep", "mult", "band", F.col("vec").cast(kind).alias("vec"), "own", "codes", "off").mapInArrow(settle, columns + ", codes binary, off double"))
    by = ["part", "group", "into", "block"]
    return dealt.repartition(width, *by).sortWithinPartitions(*by, "kind", "rep").mapInArrow(meet, schema)


def _block_of(rep: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (((rep.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % n).astype("i8")


def _codes(index: Index, rows: pa.RecordBatch, own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are known ones, and all rows' codes, those that come with a row or else new ones."""
    known, n = np.zeros(len(own), bool), len(index.spans)
    if "codes" in rows.schema.names:
        known = ~np.asarray(rows.column("codes").is_null())
    codes, off = np.zeros((len(own), n), "u1"), np.zeros(len(own))
    if not known.all():
        codes[~known], off[~known] = index.encode(x[~known], own[~known])
    if known.any():
        codes[known] = np.frombuffer(b"".join(c for c in rows.column("codes").to_pylist() if c is not None), "u1").reshape(-1, n)
        off[known] = rows.column("off").to_numpy(zero_copy_only=False)[known]
    return known, codes, off


class Pairs:
    """Collects the pairs themselves: ``a < b`` and their cosine."""

    schema = "a long, b long, cosine double"

    def __init__(self, rep: np.ndarray, mult: np.ndarray):
        self.rep = rep

    def add(self, rep, mult, a, b, cos):
        x, y = rep[a], self.rep[b]
        yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": cos})

    def finish(self):
        return iter(())
