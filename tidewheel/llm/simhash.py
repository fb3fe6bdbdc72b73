"""SimHash near-duplicates through an inverted index of positional bytes."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_rows, min_labels
from tidewheel.operators.components import connected_components
from tidewheel.session import materialize

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: A posting list longer than this is dealt out in pairs of blocks.
LONG_LIST = 20_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ONES, _LOW = np.uint64(0x0101010101010101), [np.uint64(x) for x in (1, 2, 4)]


def blocks_of_four() -> list[tuple[int, ...]]:
    """Fourteen sets of four of the eight byte positions such that any five positions hold one whole.

    Two fingerprints within three bits differ in three bytes at most, so they share
    five positional bytes or more and meet in the posting list of one of these sets.
    The sets are the affine planes of three-dimensional space over two elements: four
    positions whose numbers have exclusive-or zero.
    """
    return [s for s in itertools.combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text; zero where it has no word.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; all three-word shingles
    count, repeats included, and a shorter text is one shingle. A bit is set if it is
    set in over half of the shingles' XXH64 values.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, n, digest = [0, *ends], len(words) - SHINGLE + 1, xxhash.xxh64_intdigest
    values = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], ends[SHINGLE - 1 :], strict=True)], "<u8")
    counts = np.zeros(64, "i8")
    for at in range(0, n, 4096):
        counts += np.unpackbits(values[at : at + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` is the fingerprint as a signed 64-bit number."""

    def run(rows):
        fp = np.array([fingerprint(x) for x in rows.column("text").to_pylist()], "u8")
        return {"doc_id": rows.column("doc_id"), "fp": pa.array(fp.view("i8"))}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def close(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which pairs of fingerprints are within ``distance`` bits.

    Count filter: tally the positional bytes that a pair shares and keep the pair if
    they are eight less ``distance`` or more; then count the differing bits of those.
    """
    x = a ^ b
    y = x | (x >> _LOW[2])
    y |= y >> _LOW[1]
    y |= y >> _LOW[0]
    shared = 8 - np.bitwise_count(y & _ONES)
    found = shared >= 8 - distance
    found[found] = np.bitwise_count(x[found]) <= distance
    return found


def _list_edges(fp: np.ndarray, rep: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect a posting list's linked members, at most one for each.

    ``split``: only pairs of one of the first so many with one of the others.
    """
    order = np.arange(len(rep)) if split else np.argsort(rep, kind="stable")
    fp, rep = fp[order], rep[order]
    labels = np.arange(len(fp))
    for at in range(0, split or len(fp), 256):
        rows = slice(at, min(at + 256, split or len(fp)))
        others = slice(split, None) if split else slice(at, None)
        i, j = np.nonzero(close(fp[rows, None], fp[None, others]))
        i, j = i + at, j + (split or at)
        min_labels(labels, i[i != j], j[i != j])
    moved = np.flatnonzero(labels != np.arange(len(fp)))
    return rep[moved], rep[labels[moved]]


def _walk(batches):
    """Posting lists come sorted; emits the edges of each. A list may span batches."""
    held: list[tuple[np.ndarray, ...]] = []

    def edges(cols: tuple[np.ndarray, ...]):
        key, pair, side, fp, rep = cols
        new = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(key)]])
        length = np.diff(bounds)
        a, b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        two = bounds[:-1][(length == 2)]
        if len(two):
            hit = two[close(fp[two], fp[two + 1]) & ((side[two] != side[two + 1]) | (side[two] == 0))]
            a.append(rep[hit])
            b.append(rep[hit + 1])
        for s, n in zip(bounds[:-1][length > 2], length[length > 2], strict=True):
            rows = slice(s, s + n)
            split = int((side[rows] == 1).sum()) if side[s] else None
            if split is None or 0 < split < n:
                x, y = _list_edges(fp[rows], rep[rows], split)
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = tuple(batch.column(n).to_numpy() for n in ("key", "pair", "side", "fp", "rep"))
        cols = (*cols[:3], cols[3].view("u8"), cols[4])
        key, pair = cols[0], cols[1]
        last = int(np.flatnonzero((key != key[-1]) | (pair != pair[-1]))[-1]) + 1 if ((key != key[-1]) | (pair != pair[-1])).any() else 0
        if last or (held and (held[0][0][0] != key[-1] or held[0][1][0] != pair[-1])):
            yield edges(tuple(np.concatenate([*(h[k] for h in held), c[:last]]) for k, c in enumerate(cols)))
            held = []
        held.append(tuple(c[last:] for c in cols))
    if held:
        yield edges(tuple(np.concatenate([h[k] for h in held]) for k in range(5)))


def links(classes: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints within the distance, from rows ``fp, rep``.

    Every fingerprint goes to fourteen posting lists of four positional bytes. Lists
    longer than ``long_list`` are cut into blocks, and each pair of blocks is a list of
    its own, so every pair of a list is compared whatever its length. A list gives
    one edge for each member at most.
    """
    byte = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))

    def key(k: int, positions: tuple[int, ...]):
        out = F.lit(k).cast("long")
        for p in positions:
            out = F.shiftleft(out, 8).bitwiseOR(byte(p))
        return out

    posted = classes.where("rep is not null").select("fp", "rep", F.explode(F.array(*(key(k, s) for k, s in enumerate(blocks_of_four())))).alias("key"))
    long_ = materialize(posted.groupBy("key").count().where(F.col("count") > long_list), "long-lists")
    if long_.isEmpty():
        dealt = posted.select("key", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"), "fp", "rep")
    else:
        n = F.ceil(F.col("count") / long_list).cast("int")
        mine = posted.join(long_, "key", "left").withColumn("n", F.coalesce(n, F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), "n").cast("int"))
        other = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
        dealt = other.select("key", (low * F.col("n") + high).cast("long").alias("pair"), side.alias("side"), "fp", "rep")
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(width, "key", "pair").sortWithinPartitions("key", "pair", "side").mapInArrow(_walk, "a long, b long")


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprint and component of every document.

    Returns ``doc_id, fingerprint`` (16 hex digits) ``, component_id`` (the smallest id
    reachable by links, itself included). Documents of one fingerprint are one class,
    compared once. Null and wordless texts have fingerprint zero and link like any
    other. A row without an id takes no part: its component is that of its fingerprint
    if another row has an id, else null. Rows of equal id are one node. Whole texts count,
    however long; an empty table gives an empty table, and other columns take no part, whatever their
    names.
    """
    made = materialize(fingerprints(docs, text, id_col), "fingerprints")
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = connected_components(links(classes))
    labelled = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return made.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
