"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import small_batches

#: Words are maximal runs of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python worker unpacks at a time; a batch's texts are never all unpacked at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to slices of Arrow rows; it returns the output's columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches):
        for part in pieces(batches):
            out = fn(part)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) for f, x in zip(arrow, (out[n] for n in arrow.names), strict=True)], schema=arrow
            )

    return df.mapInArrow(run, schema)


def positional(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """The columns named by position, so that none clashes with an operator's own.

    Returns the renamed rows, the new name of an old one, and the way back.
    """
    names = docs.columns
    new = [f"_c{k}" for k in range(len(names))]
    return docs.toDF(*new), lambda n: new[names.index(n)], lambda df: df.select(*new).toDF(*names)


def salts(df: DataFrame, rows: int, target: int = 20_000) -> int:
    """Into how many salted groups ``rows`` rows go, so that none outgrows a task."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * width, -(-rows // target))


def min_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the pairs ``a, b`` into ``labels``, which maps each node to the least of its set."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, np.concatenate([a, b, la, lb]), np.concatenate([low, low, low, low]))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped
    return labels


def digest_spans(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order.get(x[0], 99), x[2])))


def hash_order(*cols: str):
    return F.xxhash64(*cols)
