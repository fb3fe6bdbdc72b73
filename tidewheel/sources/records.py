"""Containers that Spark has no reader for: TFRecord examples, and MCAP messages through their own data source.

TFRecord files come through ``binaryFile``, so any store that Spark reads will do; each
file is parsed in one task.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewheel.sources import mcap


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, kind, value


def _feature(raw: bytes) -> list:
    out: list = []
    for number, _, body in _fields(raw):
        for _, kind, value in _fields(body):
            if number == 1:
                out.append(value.decode("utf-8", "replace"))
            elif number == 2:
                out += struct.unpack(f"<{len(value) // 4}f", value)
            elif kind == 0:
                out.append(value - (1 << 64) if value >> 63 else value)
            else:
                at = 0
                while at < len(value):
                    v, at = _varint(value, at)
                    out.append(v - (1 << 64) if v >> 63 else v)
    return out


def parse_example(raw: bytes) -> dict[str, list]:
    """A serialised example as names to lists of numbers or strings."""
    out = {}
    for number, _, features in _fields(raw):
        if number == 1:
            for _, _, entry in _fields(features):
                parts = {n: v for n, _, v in _fields(entry)}
                out[parts[1].decode()] = _feature(parts.get(2, b""))
    return out


def tfrecords(raw: bytes) -> Iterator[bytes]:
    """Records of a file, which may be gzip- or zlib-compressed."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    elif raw[:1] == b"\x78" and (raw[0] * 256 + raw[1]) % 31 == 0:
        raw = zlib.decompress(raw)
    at = 0
    while at + 12 <= len(raw):
        (n,) = struct.unpack_from("<Q", raw, at)
        yield raw[at + 12 : at + 12 + n]
        at += 16 + n


def read_tfrecord(spark: SparkSession, path: str) -> DataFrame:
    """``path, record, name, values`` (JSON) of every feature of every example."""

    def run(batches):
        for batch in batches:
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for k, record in enumerate(tfrecords(raw)):
                    rows = parse_example(record)
                    yield pa.RecordBatch.from_pydict({"path": [p] * len(rows), "record": pa.array([k] * len(rows), pa.int64()), "name": list(rows), "values": [json.dumps(v) for v in rows.values()]}, schema=_TF)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, record long, name string, values string")


_TF = pa.schema([("path", pa.string()), ("record", pa.int64()), ("name", pa.string()), ("values", pa.string())])
def mcap_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``path, topic, schema_name, encoding, n_messages, start_ns, end_ns`` of every channel, from the files' summaries."""
    return mcap.read(spark, path, "channels")


def read_mcap(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """``path, topic, ts_ns, publish_ns, encoding, data`` of every message of the wanted topics."""
    return mcap.read(spark, path, topics=topics or None).select("path", "topic", "ts_ns", "publish_ns", "encoding", "data")


def write_mcap(messages: list[tuple[str, int, bytes]], encoding: str = "json", schemas: dict[str, str] | None = None) -> bytes:
    """A file of messages ``(topic, log time, payload)``, without chunks or index; ``schemas`` names topics' types."""

    def record(op: int, body: bytes) -> bytes:
        return bytes([op]) + struct.pack("<Q", len(body)) + body

    def text(s: str) -> bytes:
        return struct.pack("<I", len(s.encode())) + s.encode()

    out, known, numbers = [mcap.MAGIC, record(1, text("") + text("tidewheel"))], {}, {}
    for name in dict.fromkeys((schemas or {}).values()):
        numbers[name] = len(numbers) + 1
        out.append(record(3, struct.pack("<H", numbers[name]) + text(name) + text("") + struct.pack("<I", 0)))
    for k, (topic, at, data) in enumerate(messages):
        if topic not in known:
            known[topic] = len(known) + 1
            out.append(record(4, struct.pack("<HH", known[topic], numbers.get((schemas or {}).get(topic), 0)) + text(topic) + text(encoding) + struct.pack("<I", 0)))
        out.append(record(5, struct.pack("<HIQQ", known[topic], k, at, at) + data))
    return b"".join([*out, record(15, struct.pack("<I", 0)), record(2, struct.pack("<QQI", 0, 0, 0)), mcap.MAGIC])
