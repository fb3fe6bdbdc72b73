"""All pairs of rows, dealt out: each two rows of a part meet in exactly one cell, whose rows a task can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import materialize

#: Rows of a block at most (about), and at least where more cells would keep more tasks busy.
MOST_ROWS, LEAST_ROWS = 16_384, 256


def block_rows(total: int, width: int, most: int = MOST_ROWS) -> int:
    """Rows of a block such that one part of all rows makes two cells a task, or ``most``."""
    return max(min(LEAST_ROWS, most), min(most, int(total / (4 * width) ** 0.5) + 1))


def deal(rows: DataFrame, part: str, size: int, kind: str | None = None, meets: np.ndarray | None = None) -> DataFrame:
    """Each row once for every cell of its own block with another block of its part: ``lo`` and ``hi``, the cell's blocks, and ``side`` (0 in ``lo``).

    ``rep`` deals a part's rows to blocks of about ``size``. Rows may be of a ``kind`` (int), and
    ``meets`` says which kinds do. A row travels as often as its part has blocks that it meets.
    """
    rows = rows.withColumn("_kind", F.lit(0) if kind is None else F.col(kind))
    blocks = materialize(rows.groupBy(part, "_kind").agg(F.ceil(F.count("*") / size).cast("int").alias("_n")), "blocks")
    own = rows.join(blocks, [part, "_kind"]).withColumn("_me", F.col("_kind").cast("long") * (1 << 32) + F.pmod(F.xxhash64("rep"), F.col("_n").cast("long"))).drop("_n")
    there = own.join(blocks.select(part, F.col("_kind").alias("_other"), F.col("_n").alias("_m")), part)
    if meets is not None:
        wanted = F.array(*(F.array(*(F.lit(bool(v)) for v in line)) for line in meets))
        there = there.where(wanted[F.col("_kind")][F.col("_other")])
    met = there.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).withColumn("_it", F.col("_other").cast("long") * (1 << 32) + F.col("_b"))
    cell = {"lo": F.least("_me", "_it"), "hi": F.greatest("_me", "_it"), "side": (F.col("_me") > F.col("_it")).cast("int")}
    return met.withColumns(cell).drop("_kind", "_other", "_m", "_me", "_it", "_b")


def cells(dealt: DataFrame, part: str, width: int, work, schema: str) -> DataFrame:
    """What ``work(part, first, second)`` yields for each cell; ``second`` is None in a cell of one block, and no side is empty."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def done():
            held = [pa.Table.from_batches(s).combine_chunks().to_batches() if s else None for s in sides]
            if held[0] and (held[1] or key[1] == key[2]):
                yield from work(key[0], held[0][0], held[1][0] if held[1] else None)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in (part, "lo", "hi", "side")]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(cols[0])], strict=True):
                here = tuple(int(c[s]) for c in cols[:3])
                if here != key:
                    if key is not None:
                        yield from done()
                    key, sides = here, ([], [])
                sides[int(cols[3][s])].append(batch.slice(s, e - s))
        if key is not None:
            yield from done()

    by = [part, "lo", "hi"]
    return dealt.repartition(width, *by).sortWithinPartitions(*by, "side").mapInArrow(meet, schema)
