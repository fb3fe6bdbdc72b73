"""Packing documents into token sequences as a cutting-stock problem."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.llm.bpe import load, tokenizer_path
from tidewheel.llm.common import pieces, salts
from tidewheel.session import materialize, small_batches

#: Lengths are planned in classes of this many tokens, rounded up.
GRAIN = 8


def price(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value: knapsack dynamic programming over ``room`` units."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for c, fits in enumerate(np.searchsorted(sizes, np.arange(1, room + 1), "right").tolist(), 1):
        best[c], take[c] = best[c - 1], -1
        if fits:
            got = value[:fits] + best[c - sizes[:fits]]
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], take[c] = got[k], k
    pattern, c = np.zeros(len(sizes), "i8"), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[room]), pattern


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 4000, gap: float = 5e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that every size is covered exactly.

    Column generation: the linear program over patterns is kept as a basis and its
    inverse; ``price`` gives the entering column. It ends when no column improves, when
    the dual bound shows it within ``gap`` of the optimum, or after ``rounds`` columns.
    The values are rounded down and what is left is packed largest first.
    """
    used = demand > 0
    sizes, demand = sizes[used], demand[used].astype("f8")
    if not len(sizes):
        return []
    basis = np.diag(room // sizes).astype("f8")
    inverse, x = np.diag(1.0 / np.diag(basis)), demand / np.diag(basis)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        worth, column = price(dual, sizes, room)
        if worth <= 1 + 1e-9 or x.sum() <= (demand @ dual) / worth * (1 + gap) + 1e-9:
            break
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        k = int(np.argmin(ratio))
        x -= ratio[k] * step
        x[k] = ratio[k]
        np.maximum(x, 0, out=x)
        basis[:, k] = column
        inverse[k] /= step[k]
        others = np.arange(len(x)) != k
        inverse[others] -= np.outer(step[others], inverse[k])
    whole = np.floor(x + 1e-7).astype("i8")
    left = demand.astype("i8") - basis.astype("i8") @ whole
    for k in np.flatnonzero(whole > 0)[::-1]:  # rounding may have counted one too many
        while whole[k] and (left < 0).any() and (basis[:, k][left < 0] > 0).any():
            whole[k] -= 1
            left += basis[:, k].astype("i8")
    out = [(basis[:, k].astype("i8"), int(whole[k])) for k in np.flatnonzero(whole)]
    while left.any():
        one, space = np.zeros(len(sizes), "i8"), room
        for k in np.flatnonzero(left)[::-1]:
            n = min(left[k], space // sizes[k])
            one[k] += n
            space -= n * sizes[k]
        repeat = int(min(left[k] // one[k] for k in np.flatnonzero(one)))
        left -= repeat * one
        out.append((one, repeat))
    spread = []
    for one, n in out:
        full = np.zeros(len(used), "i8")
        full[used] = one
        spread.append((full, n))
    return spread


def _slots(found: list[tuple[np.ndarray, int]], n_classes: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By class: the rank at which each pattern's slots begin, how many it has in a sequence, and its first sequence."""
    table: dict[int, list[tuple[int, int, int]]] = {c: [] for c in range(n_classes)}
    ranks, sequence = [0] * n_classes, 0
    for one, n in found:
        for c in np.flatnonzero(one):
            table[c].append((ranks[c], int(one[c]), sequence))
            ranks[c] += int(one[c]) * n
        sequence += n
    return {c: tuple(np.array(x, "i8") for x in zip(*rows, strict=True)) for c, rows in table.items() if rows}


def cut(docs: DataFrame, tokenizer: str | None = None, text: str = "text", id_col: str = "doc_id", limit: int = 2048, end_id: int = 1) -> DataFrame:
    """Encode whole texts and cut each into pieces of ``limit`` ids and one rest.

    Returns ``doc_id, row, start, length, ids_crc32, doc_tokens``; ``row`` tells rows
    of equal id apart. The end id is a document's last. Null texts hold it alone.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for rows in pieces(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens")}
            for doc, raw in zip(rows.column("doc_id").to_pylist(), load(path).encode_all([x or "" for x in rows.column("text").to_pylist()]), strict=True):
                raw += end
                n = len(raw) // 4
                for s in range(0, n, limit):
                    part = raw[4 * s : 4 * (s + limit)]
                    for k, v in zip(out, (doc, row, s, len(part) // 4, zlib.crc32(part), n), strict=True):
                        out[k].append(v)
                row += 1
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, grain: int = GRAIN, **columns) -> DataFrame:
    """Pack whole documents into sequences of at most ``limit`` tokens.

    Every document is cut into pieces of ``limit`` tokens and one rest, so only
    documents longer than a sequence are cut. The driver sees the histogram of rests
    in at most ``limit / grain`` classes, finds patterns for it and ranks decide which
    document fills which slot: rests of a class are ranked by document id within salted
    groups, whose bases are prefix sums, so no class meets in one task.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Rows of equal id, or without one, are packed as documents of their
    own; a null or empty text is its end token alone. A very long text is encoded whole, by one task,
    and gives a piece for each ``limit`` tokens. Other columns take no part,
    whatever their names; empty tables give no row.
    """
    pieces_ = materialize(cut(docs, tokenizer, limit=limit, **columns).withColumn("class", F.ceil(F.col("length") / grain).cast("int") - 1), "pieces")
    room = limit // grain
    counts = dict(pieces_.groupBy("class").count().collect())  # one row per class
    demand = np.array([counts.get(c, 0) for c in range(room)], "i8")
    table = _slots(patterns(np.arange(1, room + 1), demand, room), room)

    salted = pieces_.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(salts(pieces_, int(demand.sum())))))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("class", "salt").agg(F.count("*").alias("n")).select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("class", "salt").orderBy("doc_id", "row", "start")
    ranked = salted.join(bases, ["class", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)

    def place(batches):
        for batch in batches:
            kinds, ranks = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(kinds), "i8"), np.zeros(len(kinds), "i8")
            for c in np.unique(kinds):
                rows = np.flatnonzero(kinds == c)
                first, each, base = table[int(c)]
                k = np.searchsorted(first, ranks[rows], "right") - 1
                sequence[rows], slot[rows] = base[k] + (ranks[rows] - first[k]) // each[k], (ranks[rows] - first[k]) % each[k]
            keep = {n: batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class")}
            yield pa.RecordBatch.from_pydict(keep | {"sequence_id": sequence, "slot": slot})

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank").mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, sequence_id long, slot long"
    )
    along = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
