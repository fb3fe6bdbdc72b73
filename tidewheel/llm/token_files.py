"""Token ids as flat binary files with 64-bit document offsets."""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.bpe import load, tokenizer_path
from tidewheel.llm.common import pieces
from tidewheel.session import new_path, small_batches

#: Pre-tokens that a worker remembers: it holds no other state, so there is room for more than elsewhere.
REMEMBERED = 200_000
#: Stands for a null document id in the files.
NO_ID = -(2**63)


def _open(uri: str):
    """File system and path of a location that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Shard:
    """Writes a partition's three files under names of its own and moves them into place when whole."""

    def __init__(self, folder: str, part: int, dtype: str):
        self.fs, root = _open(folder)
        self.fs.create_dir(root)
        self.final = {k: f"{root}/{part:06d}.{k}" for k in ("tok", "off", "doc")}
        self.temp = {k: f"{p}.{uuid.uuid4().hex}" for k, p in self.final.items()}
        self.out = {k: self.fs.open_output_stream(p) for k, p in self.temp.items()}
        self.dtype, self.tokens, self.docs = dtype, 0, 0
        self.out["off"].write(np.zeros(1, "<i8").tobytes())

    def add(self, ids: list[int | None], arrays: list[np.ndarray]) -> None:
        if arrays:
            self.out["tok"].write(np.concatenate(arrays).astype(self.dtype).tobytes())
            ends = self.tokens + np.cumsum([len(x) for x in arrays])
            self.out["off"].write(ends.astype("<i8").tobytes())
            self.out["doc"].write(np.array([NO_ID if x is None else x for x in ids], "<i8").tobytes())
            self.tokens, self.docs = int(ends[-1]), self.docs + len(arrays)

    def close(self) -> None:
        for k, f in self.out.items():
            f.close()
            self.fs.move(self.temp[k], self.final[k])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, text: str = "text", id_col: str = "doc_id", end_id: int = 1) -> dict:
    """Encode whole texts and write their ids in ascending document order.

    ``folder`` must be one that driver and executors share. Rows are dealt by ranges
    of the id (ties by a hash of the text), so partition k holds documents before
    those of partition k + 1; null ids come first. Partition k writes

    - ``k.tok``: its ids, flat, unsigned 16-bit where the vocabulary fits, else 32-bit,
    - ``k.off``: where each document begins and the last ends, 64-bit, from its own 0,
    - ``k.doc``: the document ids, 64-bit.

    Files are moved into place when whole, so a repeated task only replaces equal
    files. The bases, prefix sums of the partitions' counts, go to ``index.json``
    last; a folder without it is not finished. Null texts are empty and hold the
    end id alone. Returns the index.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    top = max([end_id, *vocabulary["model"]["vocab"].values(), *(x["id"] for x in vocabulary["added_tokens"])])
    dtype = "<u2" if top < 2**16 else "<u4"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), None
        for rows in pieces(batches):
            shard = shard or _Shard(folder, part, dtype)
            encoded = load(path, REMEMBERED).encode_all([x or "" for x in rows.column("text").to_pylist()])
            shard.add(rows.column("doc_id").to_pylist(), [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)) for x in encoded])
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [shard.docs], "tokens": [shard.tokens]})

    placed = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(width, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    # one row for each partition
    parts = sorted(map(tuple, placed.mapInArrow(write, "part long, docs long, tokens long").collect()))
    base, listed = 0, []
    for part, n_docs, tokens in parts:
        listed.append({"part": part, "docs": n_docs, "tokens": tokens, "base": base})
        base += tokens
    index = {"dtype": dtype, "tokens": base, "end_id": end_id, "parts": listed}
    fs, root = _open(folder)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def read_index(folder: str) -> dict:
    fs, root = _open(folder)
    with fs.open_input_stream(f"{root}/index.json") as f:
        return json.loads(f.read())


def _mapped(folder: str, part: int, kind: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a file system, else read."""
    from pyarrow import fs as pafs

    fs, root = _open(folder)
    path = f"{root}/{part:06d}.{kind}"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it; the checksum is over the ids
    as little-endian unsigned 32-bit integers, whatever their width in the files.
    """
    index = read_index(folder)
    dtype = index["dtype"]

    def read(batches):
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                tok, off, doc = (_mapped(folder, part, k, t) for k, t in (("tok", dtype), ("off", "<i8"), ("doc", "<i8")))
                for at in range(0, len(doc), 4096):
                    ends = off[at : at + 4097]
                    crc = [zlib.crc32(tok[s:e].astype("<u4").tobytes()) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                    ids = np.asarray(doc[at : at + 4096])
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=ids == NO_ID), "start": base + np.asarray(ends[:-1]), "n_tokens": np.diff(ends), "ids_crc32": np.array(crc, "i8")})

    rows = [(x["part"], x["base"]) for x in index["parts"]]
    parts = spark.createDataFrame(rows, "part int, base long").repartition(max(1, len(rows)), "part")
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_roundtrip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read them back.

    Rows of one id are documents of their own, in the order of a hash of their texts;
    those without an id come first. A very long text is encoded whole, by one task. An empty table gives an empty table;
    other columns take no part, whatever their names.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    write_token_files(docs, folder, tokenizer)
    return read_token_files(spark, folder)
