"""Near signatures of 64-bit hashes under any radius: a multi-index over substrings, whole signatures compared in its lists, or in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import blocks
from tidewheel.session import materialize

#: A list with more signatures than this is dealt out in pairs of blocks.
LONG_LIST = 20_000
#: Pairs that are compared at a time.
PAIRS = 1 << 20
#: Pairs whose packed bits are compared at a time, so that they stay in a core's cache.
TILE = 1 << 16
#: Lists that would compare more than this share of all pairs are not made; all are compared in blocks.
DENSE = 1 / 16


def substrings(radius: int) -> list[tuple[int, int]]:
    """Start and width of the substrings such that hashes within ``radius`` bits have one that differs in one bit at most.

    Were two bits or more apart in each of ``radius // 2 + 1`` substrings, that would be more
    than the radius in all.
    """
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(64), min(64, radius // 2 + 1))])
    return [(int(a), int(b - a)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _cut(hashes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    start, width = span
    mask = np.uint64((1 << width) - 1)
    return (hashes >> np.uint64(start)) & mask


def _distances(h: np.ndarray, m: np.ndarray, other: np.ndarray, other_m: np.ndarray) -> np.ndarray:
    """Mean share of differing bits over the hashes that both have; above 1 where they share none."""
    bits, shared = np.zeros((len(h), len(other)), "i4"), np.zeros((len(h), len(other)), "i4")
    for k in range(h.shape[1]):
        both = m[:, k, None] & other_m[None, :, k]
        bits += np.where(both, np.bitwise_count(h[:, k, None] ^ other[None, :, k]), 0)
        shared += both
    return np.where(shared > 0, bits / (64.0 * np.maximum(shared, 1)), 2.0)


def _first_meeting(x: np.ndarray, both: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For pairs' differing bits by hash: the first (hash, substring) place where they meet."""
    out = np.full(len(x), 1 << 30)
    for k in reversed(range(x.shape[1])):
        for q in reversed(range(len(spans))):
            out[both[:, k] & (np.bitwise_count(_cut(x[:, k], spans[q])) <= 1)] = k * len(spans) + q
    return out


def _matrix(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten()
    return flat.fill_null(0).to_numpy().astype("i8").view("u8").reshape(-1, n), ~np.asarray(flat.is_null()).reshape(-1, n)


def _packed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits that are not the same in all rows of both, in as few words as hold them."""
    every = np.concatenate([x, y])
    vary = np.bitwise_or.reduce(every, axis=0) ^ np.bitwise_and.reduce(every, axis=0)
    columns = np.flatnonzero(np.unpackbits(vary.view("u1")))
    bits = np.packbits(np.unpackbits(np.ascontiguousarray(every).view("u1"), axis=1)[:, columns], axis=1)
    words = np.zeros((len(every), max(8, -(-bits.shape[1] // 8) * 8)), "u1")
    words[:, : bits.shape[1]] = bits
    words = words.view("u8")
    return words[: len(x)], words[len(x) :]


def block_pairs(rows: DataFrame, n_hashes: int, most: float, size: int) -> DataFrame:
    """Pairs of ``camera_pairs`` by comparing all: each pair once, in a task that holds two blocks."""
    reached = np.flatnonzero(np.arange(64 * n_hashes + 1) / (64.0 * n_hashes) <= most)[-1]

    def work(cam: int, first: pa.RecordBatch, second: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        rep, (h, m) = first.column("rep").to_numpy(), _matrix(first.column("hashes"), n_hashes)
        other, (oh, om) = (rep, (h, m)) if second is None else (second.column("rep").to_numpy(), _matrix(second.column("hashes"), n_hashes))
        whole = bool(m.all() and om.all())
        x, y = _packed(h, oh) if whole else (h, oh)
        words = np.ascontiguousarray(y.T)
        kind = "u1" if x.shape[1] < 4 else "i4"
        step = max(1, TILE // len(other))
        for at in range(0, len(rep), step):
            q = slice(at, at + step)
            # of one block, only what comes after
            after = at if second is None else 0
            if whole:
                bits = np.bitwise_count(x[q, 0, None] ^ words[0][None, after:]).astype(kind, copy=False)
                for k in range(1, x.shape[1]):
                    bits += np.bitwise_count(x[q, k, None] ^ words[k][None, after:])
                i, j = np.divmod(np.flatnonzero(bits <= reached), len(other) - after)
                d = bits[i, j] / (64.0 * n_hashes)
            else:
                far = _distances(h[q], m[q], oh[after:], om[after:])
                i, j = np.nonzero(far <= most)
                d = far[i, j]
            if second is None:
                i, j, d = (v[i < j] for v in (i, j, d))
            if len(i):
                a, b = rep[q][i], other[after + j]
                yield pa.RecordBatch.from_pydict({"cam": np.full(len(i), cam), "a": np.minimum(a, b), "b": np.maximum(a, b), "distance": d})

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.deal(rows.select("cam", "rep", "hashes"), "cam", size)
    return blocks.cells(dealt, "cam", width, work, "cam long, a long, b long, distance double")


def camera_pairs(rows: DataFrame, n_hashes: int, most: float, long_list: int | None = None, dense: float | None = None) -> DataFrame:
    """Pairs ``a < b`` of ``rep`` with the same ``cam`` whose ``hashes`` are within ``most``, and their ``distance``; each once.

    ``rows``: ``cam`` (long), ``rep`` (long, distinct within a cam) and ``hashes``, an array of
    ``n_hashes`` 64-bit numbers or nulls. The mean is at most ``most`` only if one hash is
    within that radius, so signatures meet on substrings of single hashes, and whole
    signatures decide. Each goes to its own list for each substring, and asks there and
    where one bit differs. A pair is given by the first list in which it meets.

    Where substrings tell little apart (bits that never vary, a wide radius on few bits),
    their lists hold most pairs, many times over. The lists are counted first, and if they
    would compare more than the share ``dense`` of all pairs, pairs are compared once
    each in blocks instead, by the bits that vary.
    """
    spark = rows.sparkSession
    long_list, dense = long_list or LONG_LIST, DENSE if dense is None else dense
    spans = substrings(int(64 * most + 1e-9))
    by = ["cam", "place", "value"]
    # lists are counted on their own members only
    cut = [F.struct(F.lit(k * len(spans) + q).alias("place"), F.shiftrightunsigned(F.col("hashes")[k], start).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)).alias("value")) for k in range(n_hashes) for q, (start, width) in enumerate(spans)]
    members = rows.select("cam", F.explode(F.array(*cut)).alias("s")).select("cam", "s.*").where("value is not null") if cut else rows.select("cam", F.lit(0).alias("place"), F.lit(0).cast("long").alias("value")).limit(0)
    lists = materialize(members.groupBy(*by).count(), "lists")
    n = F.col("count").cast("double")
    compared = lists.agg(F.sum(n * n)).first()[0] or 0.0
    total, every = rows.groupBy("cam").count().agg(F.sum("count"), F.sum(n * n)).first()
    if compared > dense * (every or 0.0):
        return block_pairs(rows, n_hashes, most, blocks.block_rows(total, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, there = _matrix(batch.column("hashes"), n_hashes)
            for k in range(n_hashes):
                some = np.flatnonzero(there[:, k])
                if not len(some):
                    continue
                for q, (start, width) in enumerate(spans):
                    own = _cut(hashes[some, k], (start, width))
                    asked = own[:, None] ^ np.append(np.uint64(0), np.uint64(1) << np.arange(width, dtype="u8"))
                    value = np.concatenate([own, asked.ravel()])
                    who = np.concatenate([some, np.repeat(some, width + 1)])
                    kind = np.concatenate([np.zeros(len(some), "i4"), np.ones(len(some) * (width + 1), "i4")])
                    for s in range(0, len(who), 8192):
                        e = slice(s, s + 8192)
                        take = pa.array(who[e])
                        yield pa.RecordBatch.from_pydict({"cam": batch.column("cam").take(take), "place": np.full(len(who[e]), k * len(spans) + q, "i4"), "value": value[e].view("i8"), "kind": kind[e], "rep": batch.column("rep").take(take), "hashes": batch.column("hashes").take(take)})

    posted = rows.select("cam", "rep", "hashes").mapInArrow(post, "cam long, place int, value long, kind int, rep long, hashes array<long>")
    long_ = materialize(lists.where(F.col("count") > long_list), "long-lists")
    dealt = posted.withColumn("cell", F.lit(0).cast("long"))
    if not long_.isEmpty():
        n = F.coalesce(F.ceil(F.col("count") / long_list).cast("int"), F.lit(1))
        block = F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")
        each = posted.join(long_, by, "left").withColumn("n", n).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        cell = F.when(F.col("kind") == 0, F.col("block") * F.col("n") + F.col("other")).otherwise(F.col("other") * F.col("n") + F.col("block"))
        dealt = each.select(*by, "kind", "rep", "hashes", cell.cast("long").alias("cell"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in (*by, "cell", "kind")]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(cols[0])], strict=True):
                here = tuple(int(c[s]) for c in cols[:4])
                if here != key:
                    key, parts, held = here, [], None
                some = batch.slice(s, e - s)
                rep, (h, m) = some.column("rep").to_numpy(), _matrix(some.column("hashes"), n_hashes)
                if cols[4][s] == 0:
                    parts.append((rep, h, m))
                    continue
                if held is None and parts:
                    held = tuple(np.concatenate([p[k] for p in parts]) for k in range(3))
                if held is None:
                    continue
                step = max(1, PAIRS // len(held[0]))
                for at in range(0, len(rep), step):
                    q = slice(at, at + step)
                    d = _distances(h[q], m[q], held[1], held[2])
                    i, j = np.nonzero((d <= most) & (rep[q][:, None] < held[0][None, :]))
                    if len(i):
                        first = _first_meeting(h[q][i] ^ held[1][j], m[q][i] & held[2][j], spans) == key[1]
                        i, j = i[first], j[first]
                        yield pa.RecordBatch.from_pydict({"cam": np.full(len(i), key[0]), "a": rep[q][i], "b": held[0][j], "distance": d[i, j]})

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(width, *by, "cell").sortWithinPartitions(*by, "cell", "kind").mapInArrow(meet, "cam long, a long, b long, distance double")


def classes(signatures: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Episodes of equal signatures as one class: members ``episode_id, rep``, rows of classes by camera, and hashes a row has.

    ``rep`` is a number of the class. A camera or hash is null like any other value; rows of
    one episode, camera and keyframe count as the least hash.
    """
    one = signatures.groupBy("episode_id", "camera", "keyframe").agg(F.min("hash").alias("hash")).where("hash is not null and keyframe >= 0")
    last = one.agg(F.max("keyframe")).first()[0]
    n = 0 if last is None else int(last) + 1
    by_frame = F.map_from_entries(F.collect_list(F.struct(F.col("keyframe").cast("int").alias("keyframe"), F.col("hash").cast("long").alias("hash"))))
    rows = one.groupBy("episode_id", "camera").agg(by_frame.alias("m"))
    hashes = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda k: F.element_at("m", k))
    rows = rows.select("episode_id", F.xxhash64(F.coalesce("camera", F.lit("")), F.col("camera").isNull()).alias("cam"), hashes.alias("hashes"))
    whole = F.array_sort(F.collect_list(F.struct("cam", "hashes")))
    mine = rows.groupBy("episode_id").agg(whole.alias("signature"))
    numbered = materialize(mine.groupBy("signature").agg(F.min("episode_id").alias("first")).withColumn("rep", F.monotonically_increasing_id()), "signatures")
    members = materialize(mine.join(numbered, "signature").select("episode_id", "rep", "first"), "members")
    return members, numbered.select("rep", F.explode("signature").alias("s")).select("rep", "s.cam", "s.hashes"), n


def class_pairs(rows: DataFrame, n_hashes: int, most: float, long_list: int | None = None) -> DataFrame:
    """Pairs of classes within ``most`` on every camera that both have: ``a, b, distance``, the largest."""
    found = camera_pairs(rows, n_hashes, most, long_list)
    if rows.select("cam").distinct().limit(2).count() < 2:
        return found.select("a", "b", "distance")  # each pair is there once
    found = found.groupBy("a", "b").agg(F.max("distance").alias("distance"), F.count("*").alias("n"))
    cams = rows.groupBy("rep").agg(F.collect_set("cam").alias("cams"))
    side = lambda n: cams.select(F.col("rep").alias(n), F.col("cams").alias(f"c{n}"))
    return found.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("ca", "cb")) == F.col("n")).select("a", "b", "distance")
