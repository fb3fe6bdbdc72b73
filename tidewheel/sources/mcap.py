"""MCAP logs as a Spark data source: chunks of wanted topics by range reads, and files with an index.

``spark.read.format("mcap")`` plans from each file's summary. A partition is a group of
chunks that hold a wanted topic at a wanted time; only those bytes are read, by seeking.
Files without a summary are read from front to end, a record at a time, so their size does
not matter either. Filters on ``topic``, ``ts_ns`` and ``path`` are taken over by the source.

The option ``content`` says what a row is: ``messages`` (payloads), ``fields`` (numbers and
text by the file's own schema), ``images``, ``channels`` (from the summary, no message is
read) or ``attachments``.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from tidewheel.sources import wire

MAGIC = b"\x89MCAP0\r\n"
#: Record kinds of the format.
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, ATTACHMENT, ATTACHMENT_INDEX, STATISTICS, METADATA, METADATA_INDEX, SUMMARY_OFFSET, DATA_END = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15
#: Bytes that are read from a file's end to find its summary at once.
TAIL = 1 << 16
#: Bytes of chunks in a partition, and of payloads in a batch.
GROUP_BYTES, BATCH_BYTES, BATCH_ROWS = 64 << 20, 8 << 20, 4096
#: Summaries that are read at a time.
PLANNERS = 16
#: How messages name the parts of a joint state.
JOINT_PARTS = {"position": ("position", "joint_positions"), "velocity": ("velocity", "joint_velocities"), "effort": ("effort", "joint_efforts")}

CONTENTS = {
    "messages": "path string, topic string, ts_ns long, publish_ns long, sequence long, schema_name string, encoding string, data binary",
    "fields": "path string, topic string, ts_ns long, part int, value array<double>, text string",
    "images": "path string, topic string, ts_ns long, height int, width int, encoding string, format string, data binary",
    "channels": "path string, topic string, schema_name string, encoding string, n_messages long, start_ns long, end_ns long",
    "attachments": "path string, name string, media_type string, log_ns long, create_ns long, data binary",
}


# --- stores


class Ranges:
    """A file of any store that pyarrow opens, read by ranges; ``bytes_read`` counts them."""

    def __init__(self, path: str):
        store, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
        self.file = store.open_input_file(inner)
        self.size, self.bytes_read = self.file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        self.bytes_read += n
        return self.file.read_at(n, at) if n else b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def _split(path: str) -> tuple[pafs.FileSystem, str, str]:
    """A store, the path in it, and what to put before a path of the store to name it for all."""
    if "://" in path:
        store, inner = pafs.FileSystem.from_uri(path)
        return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), path.removeprefix("file:"), "file:"
    return pafs.LocalFileSystem(), path, ""


def list_logs(path: str) -> list[str]:
    """The MCAP files of a file, a folder with its subfolders, or a pattern, in order."""
    store, inner, prefix = _split(path)
    if any(c in inner for c in "*?["):
        top = inner[: re.search(r"[*?\[]", inner).start()].rpartition("/")[0] or "/"
        found = [f.path for f in store.get_file_info(pafs.FileSelector(top, recursive=True)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.path, inner)]
    else:
        info = store.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == pafs.FileType.File:
            return [path]
        found = [f.path for f in store.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".mcap") and "/_" not in f.path[len(inner) :]]
    return [prefix + f for f in sorted(found)]


# --- records


def _text(raw: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", raw, at)
    return raw[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n


def _walk(raw: bytes, at: int = 0) -> Iterator[tuple[int, int, int]]:
    """Kind, start and end of each whole record of a buffer."""
    end = len(raw)
    while at + 9 <= end:
        (n,) = struct.unpack_from("<Q", raw, at + 1)
        if at + 9 + n > end:
            return
        yield raw[at], at + 9, at + 9 + n
        at += 9 + n


@dataclass
class Channel:
    topic: str
    encoding: str
    schema_name: str = ""
    schema_encoding: str = ""
    schema: bytes = b""


@dataclass
class Index:
    """What a file's summary says."""

    channels: dict[int, Channel] = field(default_factory=dict)
    #: Start and end time, offset and length in the file, offsets of message indexes by channel.
    chunks: list[tuple[int, int, int, int, dict[int, int]]] = field(default_factory=list)
    #: Offset and length of each attachment.
    attachments: list[tuple[int, int]] = field(default_factory=list)
    counts: dict[int, int] | None = None
    n_chunks: int | None = None
    n_attachments: int | None = None


class _Known:
    """Schemas and channels as they come along in a file."""

    def __init__(self, channels: dict[int, Channel] | None = None):
        self.schemas: dict[int, tuple[str, str, bytes]] = {}
        self.channels = dict(channels or {})

    def take(self, op: int, rec: bytes) -> None:
        (number,) = struct.unpack_from("<H", rec)
        if op == SCHEMA:
            name, p = _text(rec, 2)
            encoding, p = _text(rec, p)
            (n,) = struct.unpack_from("<I", rec, p)
            self.schemas[number] = (name, encoding, bytes(rec[p + 4 : p + 4 + n]))
        elif number not in self.channels:
            topic, p = _text(rec, 4)
            encoding, _ = _text(rec, p)
            self.channels[number] = Channel(topic, encoding, *self.schemas.get(struct.unpack_from("<H", rec, 2)[0], ("", "", b"")))


def read_index(file: Ranges) -> Index | None:
    """The summary of a file; None where there is none that tells where its messages are."""
    tail = file.read(max(0, file.size - TAIL), TAIL)
    if len(tail) < 37 or tail[-8:] != MAGIC or tail[-37] != FOOTER:
        return None
    start, offsets, _ = struct.unpack_from("<QQI", tail, len(tail) - 28)
    if not start:
        return None
    base = file.size - len(tail)
    raw = tail[start - base :] if start >= base else file.read(start, base - start) + tail
    known, found = _Known(), Index()
    for op, a, b in _walk(raw):
        rec = raw[a:b]
        if op in (SCHEMA, CHANNEL):
            known.take(op, rec)
        elif op == CHUNK_INDEX:
            low, high, at, length, n = struct.unpack_from("<QQQQI", rec)
            pairs = {c: o for c, o in struct.iter_unpack("<HQ", rec[36 : 36 + n])}
            found.chunks.append((low, high, at, length, pairs))
        elif op == STATISTICS:
            _, _, _, found.n_attachments, _, found.n_chunks, _, _, n = struct.unpack_from("<QHIIIIQQI", rec)
            found.counts = {c: k for c, k in struct.iter_unpack("<HQ", rec[46 : 46 + n])}
        elif op == ATTACHMENT_INDEX:
            found.attachments.append(struct.unpack_from("<QQ", rec))
        elif op == FOOTER:
            break
    found.channels = known.channels
    listed = {c for chunk in found.chunks for c in chunk[4]} | set(found.counts or {})
    if not listed <= set(found.channels):
        return None
    # messages outside of chunks have no index
    if not found.chunks and (found.counts is None or any(found.counts.values())) or found.n_chunks not in (None, len(found.chunks)):
        return None
    return found


def open_chunk(rec: bytes) -> bytes:
    """The records of a chunk."""
    (size,) = struct.unpack_from("<Q", rec, 16)
    kind, p = _text(rec, 28)
    (n,) = struct.unpack_from("<Q", rec, p)
    data = rec[p + 8 : p + 8 + n]
    if not kind or not size:
        return data
    if kind not in ("zstd", "lz4"):
        raise ValueError(f"chunks compressed by {kind} are not supported")
    return pa.Codec(kind).decompress(data, size).to_pybytes()


def stream_records(file: Ranges, step: int = 4 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Kind, offset and body of each record from the front, a step of the file at a time; a cut file ends early."""
    if file.read(0, 8) != MAGIC:
        raise ValueError("not an MCAP file")
    at, held, base = 8, b"", 8
    while at + 9 <= file.size:
        if at + 9 > base + len(held):
            base, held = at, file.read(at, step)
        op = held[at - base]
        (n,) = struct.unpack_from("<Q", held, at - base + 1)
        if at + 9 + n > file.size:
            return
        if at + 9 + n > base + len(held):
            base, held = at, file.read(at, max(step, 9 + n))
        yield op, at, held[at - base + 9 : at - base + 9 + n]
        if op in (DATA_END, FOOTER):
            return
        at += 9 + n


# --- what a message holds


def numbers_of(message: dict, part: str | None, dtype: str | None = None) -> np.ndarray | None:
    """The numbers under a part of a message, by any of its names and through dots; a single number is one of one.

    Without a part these are the data, a joint state's positions or what there is besides the
    header. A pose gives its place, then its turn; ``dtype`` rounds to a numpy type first.
    """
    names = JOINT_PARTS.get(part, (part,)) if part else ("data", *JOINT_PARTS["position"])
    found = next((message[n] for n in names if n in message), None)
    if found is None and part and "." in part:
        found = message
        for step in part.split("."):
            found = found.get(step) if isinstance(found, dict) else None
    if part is None and (found is None or isinstance(found, dict)):  # poses and the like
        found = {k: v for k, v in message.items() if k != "header"} or None
    try:
        x = _flat(found)
    except (TypeError, ValueError):
        return None
    return None if x is None else x.astype(dtype).astype("f8") if dtype else x


def _flat(x) -> np.ndarray | None:
    if x is None or isinstance(x, (str, bool, np.bool_)):
        return None
    if isinstance(x, bytes):
        return np.frombuffer(x, "u1").astype("f8")
    if isinstance(x, dict):
        parts = [_flat(v) for k, v in x.items() if k != "header"]
        return None if not parts or any(p is None for p in parts) else np.concatenate(parts)
    if isinstance(x, list) and x and isinstance(x[0], (dict, list)):
        parts = [_flat(v) for v in x]
        return None if any(p is None for p in parts) else np.concatenate(parts)
    return np.atleast_1d(np.asarray(x, "f8"))


def text_of(message: dict) -> str | None:
    found = message.get("data", message.get("value"))
    return found if isinstance(found, str) else None


def image_of(message: dict) -> tuple[int | None, int | None, str | None, str | None, bytes] | None:
    """Height, width, encoding, format and bytes of an image or a compressed one."""
    data = message.get("data")
    if isinstance(data, np.ndarray):
        data = data.tobytes()
    if not isinstance(data, (bytes, bytearray)):
        return None
    if "height" in message and "width" in message:
        return int(message["height"]), int(message["width"]), str(message.get("encoding") or "rgb8"), "raw", bytes(data)
    return None, None, None, str(message.get("format") or "video"), bytes(data)


# --- reading


@dataclass
class Chunks(ds.InputPartition):
    """Chunks of a file and the wanted channels in them; without chunks, the whole file."""

    path: str
    channels: dict[int, Channel] | None = None
    chunks: list[tuple[int, int]] | None = None

    def __post_init__(self):
        self.value = self.path


class McapReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.content = options["path"], options.get("content", "messages")
        self.arrow = to_arrow_schema(schema)
        self.topics = set(json.loads(options["topics"])) if "topics" in options else None
        #: By topic: the parts that hold numbers, each with its numpy type or None.
        self.parts = {t: p if isinstance(p, list) else [(p, None)] for t, p in json.loads(options.get("parts", "{}")).items()}
        if self.content == "fields" and self.parts:
            self.topics = set(self.parts) if self.topics is None else self.topics & set(self.parts)
        self.low, self.high = int(options.get("start_ns", 0)), int(options.get("end_ns", (1 << 63) - 1))
        self.paths: set[str] | None = None
        self.group = int(options.get("group_bytes", GROUP_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("topic", "path") and isinstance(f, (ds.EqualTo, ds.In)) and (name == "path" or self.content in ("messages", "fields", "images")):
                values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                have = self.topics if name == "topic" else self.paths
                values = values if have is None else have & values
                if name == "topic":
                    self.topics = values
                else:
                    self.paths = values
            elif name == "ts_ns" and isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
                if not isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, ds.GreaterThan))
                if not isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, ds.LessThan))
            elif not (name in ("topic", "ts_ns", "path") and isinstance(f, ds.IsNotNull)):  # these are never null
                yield f

    def partitions(self):
        logs = [p for p in list_logs(self.path) if self.paths is None or p in self.paths]
        if self.content in ("channels", "attachments"):
            return [Chunks(p) for p in logs]
        with ThreadPoolExecutor(PLANNERS) as pool:
            return [part for parts in pool.map(self._plan, logs) for part in parts]

    def _plan(self, path: str) -> list[Chunks]:
        with Ranges(path) as file:
            index = read_index(file)
        if index is None:
            return [Chunks(path)]
        wanted = {k: c for k, c in index.channels.items() if self.topics is None or c.topic in self.topics}
        out, group, size = [], [], 0
        for low, high, at, length, by_channel in index.chunks:
            # a writer may leave out the message indexes; such a chunk may hold any channel
            if low <= self.high and high >= self.low and (not by_channel or not wanted.keys().isdisjoint(by_channel)):
                if group and size + length > self.group:
                    out.append(Chunks(path, wanted, group))
                    group, size = [], 0
                group.append((at, length))
                size += length
        return [*out, Chunks(path, wanted, group)] if group else out

    def read(self, partition):
        if partition is None:  # nothing was planned
            return
        with Ranges(partition.path) as file:
            rows = {"channels": self._channels, "attachments": self._attachments}.get(self.content, self._messages)(file, partition)
            yield from self._batches(rows)

    def _batches(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[-1]) if isinstance(row[-1], bytes) else 64
            if len(held) == BATCH_ROWS or size > BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.arrow, strict=True)], schema=self.arrow)

    def _messages(self, file: Ranges, partition: Chunks) -> Iterator[tuple]:
        known, wanted = _Known(partition.channels), {}
        decoders: dict[int, object] = {}

        def of(rec: bytes, a: int, b: int) -> Iterator[tuple]:
            """The rows of a message; it is decoded once, whatever many parts are wanted."""
            number, sequence, log, publish = struct.unpack_from("<HIQQ", rec, a)
            take = wanted.get(number)
            if take is None:
                c = known.channels.get(number)
                take = wanted[number] = c is not None and (self.topics is None or c.topic in self.topics)
            if not take or not self.low <= log <= self.high:
                return
            c, data = known.channels[number], rec[a + 22 : b]
            if self.content == "messages":
                yield partition.path, c.topic, log, publish, sequence, c.schema_name, c.encoding, bytes(data)
                return
            if number not in decoders:
                decoders[number] = wire.decoder(c.schema_name, c.schema_encoding, c.schema, c.encoding)
            made = wire.decode(decoders[number], bytes(data)) or {}
            if self.content == "images":
                if image := image_of(made):
                    yield partition.path, c.topic, log, *image
                return
            for k, (part, dtype) in enumerate(self.parts.get(c.topic, [(None, None)])):
                yield partition.path, c.topic, log, k, numbers_of(made, part, dtype), text_of(made)

        def inside(raw: bytes):
            for op, a, b in _walk(raw):
                if op == MESSAGE:
                    yield from of(raw, a, b)
                elif op in (SCHEMA, CHANNEL):
                    known.take(op, raw[a:b])

        if partition.chunks is not None:
            for at, length in partition.chunks:
                raw = file.read(at, length)
                for op, a, b in _walk(raw):
                    if op == CHUNK:
                        yield from inside(open_chunk(raw[a:b]))
            return
        for op, _, rec in stream_records(file):
            if op == CHUNK:
                yield from inside(open_chunk(rec))
            elif op in (SCHEMA, CHANNEL):
                known.take(op, rec)
            elif op == MESSAGE:
                yield from of(rec, 0, len(rec))

    def _channels(self, file: Ranges, partition: Chunks) -> Iterator[tuple]:
        index = read_index(file)
        if index is None or index.counts is None or any(not c[4] for c in index.chunks):
            yield from self._counted(file, partition)
            return
        for number, c in sorted(index.channels.items()):
            mine = [(low, high, offsets[number]) for low, high, _, _, offsets in index.chunks if number in offsets]
            yield partition.path, c.topic, c.schema_name, c.encoding, index.counts.get(number, 0), _edge(file, mine, False), _edge(file, mine, True)

    def _counted(self, file: Ranges, partition: Chunks) -> Iterator[tuple]:
        known, seen = _Known(), {}

        def note(rec: bytes, a: int) -> None:
            number, _, log = struct.unpack_from("<HIQ", rec, a)
            n, low, high = seen.get(number, (0, log, log))
            seen[number] = (n + 1, min(low, log), max(high, log))

        for op, _, rec in stream_records(file):
            if op == CHUNK:
                raw = open_chunk(rec)
                for kind, a, b in _walk(raw):
                    if kind == MESSAGE:
                        note(raw, a)
                    elif kind in (SCHEMA, CHANNEL):
                        known.take(kind, raw[a:b])
            elif op == MESSAGE:
                note(rec, 0)
            elif op in (SCHEMA, CHANNEL):
                known.take(op, rec)
        for number, c in known.channels.items():
            yield partition.path, c.topic, c.schema_name, c.encoding, *seen.get(number, (0, None, None))

    def _attachments(self, file: Ranges, partition: Chunks) -> Iterator[tuple]:
        index = read_index(file)
        if index is not None and index.n_attachments in (None, len(index.attachments)):
            for at, length in index.attachments:
                yield partition.path, *_attachment(file.read(at, length)[9:])
        else:
            for op, _, rec in stream_records(file):
                if op == ATTACHMENT:
                    yield partition.path, *_attachment(rec)


def _attachment(rec: bytes) -> tuple[str, str, int, int, bytes]:
    log, create = struct.unpack_from("<QQ", rec)
    name, p = _text(rec, 16)
    media, p = _text(rec, p)
    (n,) = struct.unpack_from("<Q", rec, p)
    return name, media, log, create, bytes(rec[p + 8 : p + 8 + n])


def _edge(file: Ranges, chunks: list[tuple[int, int, int]], last: bool) -> int | None:
    """First or last time of a channel: message indexes are read only of chunks that may hold it."""
    best = None
    for low, high, at in sorted(chunks, key=lambda c: -c[1] if last else c[0]):
        if best is not None and (high <= best if last else low >= best):
            break
        (n,) = struct.unpack("<Q", file.read(at + 1, 8))
        rec = file.read(at + 9, n)
        (size,) = struct.unpack_from("<I", rec, 2)
        times = np.frombuffer(rec, "<u8", size // 8, 6)[::2]
        if len(times):
            found = int(times.max() if last else times.min())
            best = found if best is None else (max if last else min)(best, found)
    return best


# --- writing


class LogFile:
    """Writes one MCAP file: chunks with message indexes, and a summary with chunk index, statistics and attachments."""

    def __init__(self, sink, compression: str = "zstd", chunk_bytes: int = 4 << 20, library: str = "tidewheel"):
        if compression not in ("zstd", "lz4", "none"):
            raise ValueError("compression must be zstd, lz4 or none")
        self.sink, self.at, self.kind, self.chunk_bytes = sink, 0, "" if compression == "none" else compression, chunk_bytes
        self.schemas: dict[tuple, int] = {}
        self.channels: dict[tuple, int] = {}
        self.defined: list[bytes] = []
        self.indexes: list[bytes] = []
        self.attached: list[bytes] = []
        self.counts: dict[int, int] = {}
        self.sequence: dict[int, int] = {}
        self.low = self.high = None
        self._open()
        self._put(MAGIC + self._record(HEADER, self._string("") + self._string(library)))

    @staticmethod
    def _record(op: int, body: bytes) -> bytes:
        return struct.pack("<BQ", op, len(body)) + body

    @staticmethod
    def _string(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<I", len(raw)) + raw

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def _open(self) -> None:
        self.body: list[bytes] = []
        self.size = 0
        self.index: dict[int, list[tuple[int, int]]] = {}

    def _append(self, raw: bytes) -> None:
        self.body.append(raw)
        self.size += len(raw)

    def channel(self, topic: str, encoding: str, schema_name: str = "", schema_encoding: str = "", schema: bytes = b"") -> int:
        about = (schema_name, schema_encoding, schema)
        if any(about) and about not in self.schemas:
            self.schemas[about] = len(self.schemas) + 1
            self.defined.append(self._record(SCHEMA, struct.pack("<H", self.schemas[about]) + self._string(schema_name) + self._string(schema_encoding) + struct.pack("<I", len(schema)) + schema))
            self._append(self.defined[-1])
        key = (topic, encoding, *about)
        if key not in self.channels:
            if len(self.channels) == 65_535:
                raise ValueError("a file holds 65,535 channels at most")
            self.channels[key] = len(self.channels) + 1
            self.defined.append(self._record(CHANNEL, struct.pack("<HH", self.channels[key], self.schemas.get(about, 0)) + self._string(topic) + self._string(encoding) + struct.pack("<I", 0)))
            self._append(self.defined[-1])
        return self.channels[key]

    def message(self, channel: int, log_ns: int, data: bytes, publish_ns: int | None = None, sequence: int | None = None) -> None:
        k = self.sequence.get(channel, 0) if sequence is None else sequence
        self.sequence[channel] = k + 1
        self.index.setdefault(channel, []).append((log_ns, self.size))
        self._append(self._record(MESSAGE, struct.pack("<HIQQ", channel, k, log_ns, log_ns if publish_ns is None else publish_ns) + data))
        self.counts[channel] = self.counts.get(channel, 0) + 1
        self.low = log_ns if self.low is None else min(self.low, log_ns)
        self.high = log_ns if self.high is None else max(self.high, log_ns)
        if self.size >= self.chunk_bytes:
            self._close()

    def _close(self) -> None:
        if not self.index:
            return
        raw = b"".join(self.body)
        packed = pa.Codec(self.kind).compress(raw, asbytes=True) if self.kind else raw
        times = [t for entries in self.index.values() for t, _ in entries]
        low, high, at = min(times), max(times), self.at
        self._put(self._record(CHUNK, struct.pack("<QQQI", low, high, len(raw), zlib.crc32(raw)) + self._string(self.kind) + struct.pack("<Q", len(packed)) + packed))
        length, offsets = self.at - at, b""
        start = self.at
        for channel, entries in self.index.items():
            offsets += struct.pack("<HQ", channel, self.at)
            self._put(self._record(MESSAGE_INDEX, struct.pack("<HI", channel, 16 * len(entries)) + b"".join(struct.pack("<QQ", *e) for e in entries)))
        self.indexes.append(self._record(CHUNK_INDEX, struct.pack("<QQQQI", low, high, at, length, len(offsets)) + offsets + struct.pack("<Q", self.at - start) + self._string(self.kind) + struct.pack("<QQ", len(packed), len(raw))))
        self._open()

    def attach(self, name: str, media_type: str, data: bytes, log_ns: int = 0, create_ns: int = 0) -> None:
        at = self.at
        body = struct.pack("<QQ", log_ns, create_ns) + self._string(name) + self._string(media_type) + struct.pack("<Q", len(data)) + data
        self._put(self._record(ATTACHMENT, body + struct.pack("<I", zlib.crc32(body))))
        self.attached.append(self._record(ATTACHMENT_INDEX, struct.pack("<QQQQQ", at, self.at - at, log_ns, create_ns, len(data)) + self._string(name) + self._string(media_type)))

    def finish(self) -> None:
        self._close()
        self._put(self._record(DATA_END, struct.pack("<I", 0)))
        start, groups = self.at, []
        counts = b"".join(struct.pack("<HQ", c, n) for c, n in self.counts.items())
        statistics = struct.pack("<QHIIIIQQI", sum(self.counts.values()), len(self.schemas), len(self.channels), len(self.attached), 0, len(self.indexes), self.low or 0, self.high or 0, len(counts)) + counts
        for op, records in ((SCHEMA, [r for r in self.defined if r[0] == SCHEMA]), (CHANNEL, [r for r in self.defined if r[0] == CHANNEL]), (STATISTICS, [self._record(STATISTICS, statistics)]), (CHUNK_INDEX, self.indexes), (ATTACHMENT_INDEX, self.attached)):
            at = self.at
            for r in records:
                self._put(r)
            if records:
                groups.append(self._record(SUMMARY_OFFSET, struct.pack("<BQQ", op, at, self.at - at)))
        offsets = self.at
        for r in groups:
            self._put(r)
        self._put(self._record(FOOTER, struct.pack("<QQI", start, offsets, 0)) + MAGIC)


@dataclass
class Written(ds.WriterCommitMessage):
    path: str | None


class McapWriter(ds.DataSourceArrowWriter):
    """A file for each task; files show up in the folder when the whole job commits, whatever was tried twice."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.compression, self.chunk_bytes = options.get("compression", "zstd"), int(options.get("chunk_bytes", 4 << 20))
        if self.compression not in ("zstd", "lz4", "none"):
            raise ValueError("compression must be zstd, lz4 or none")
        self.attachments = json.loads(options.get("attachments", "[]"))
        missing = {"topic", "ts_ns", "data"} - set(schema.names)
        if missing:
            raise ValueError(f"messages need the columns {sorted(missing)}")

    def _folder(self) -> tuple[pafs.FileSystem, str, str]:
        store, inner, _ = _split(self.path)
        return store, inner, posixpath.join(inner, f"_mcap-{self.job}")

    def write(self, iterator):
        store, _, folder = self._folder()
        log = name = sink = None
        for batch in iterator:
            names = batch.schema.names
            col = lambda n, default=None: batch.column(n).to_pylist() if n in names else [default] * batch.num_rows  # noqa: E731, B023
            about = zip(col("topic"), col("encoding", "json"), col("schema_name", ""), col("schema_encoding", ""), col("schema", b""), strict=True)
            for (topic, encoding, *schema), ts, publish, sequence, data in zip(about, col("ts_ns"), col("publish_ns"), col("sequence"), col("data"), strict=True):
                if log is None:
                    name = posixpath.join(folder, f"part-{uuid.uuid4().hex}.mcap")
                    store.create_dir(folder, recursive=True)
                    sink = store.open_output_stream(name)
                    log = LogFile(sink, self.compression, self.chunk_bytes)
                    for a in self.attachments:
                        with Ranges(a["path"]) as file:
                            log.attach(a["name"], a.get("media_type") or media_type(a["name"]), file.read(0, file.size))
                log.message(log.channel(topic, encoding, *((x or type(d)()) for x, d in zip(schema, ("", "", b""), strict=True))), ts, data or b"", publish, sequence)
        if log is not None:
            log.finish()
            sink.close()
        return Written(name)

    def commit(self, messages):
        store, inner, folder = self._folder()
        if self.overwrite and store.get_file_info(inner).type == pafs.FileType.Directory:
            for f in store.get_file_info(pafs.FileSelector(inner)):
                if f.type == pafs.FileType.File and f.path.endswith(".mcap"):
                    store.delete_file(f.path)
        for k, m in enumerate(m for m in messages if m is not None and m.path):
            store.move(m.path, posixpath.join(inner, f"part-{k:05d}-{self.job}.mcap"))
        self._clear(store, folder)

    def abort(self, messages):
        store, _, folder = self._folder()
        self._clear(store, folder)

    @staticmethod
    def _clear(store: pafs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


def media_type(name: str) -> str:
    """Kinds of attached files by their endings."""
    known = {"urdf": "application/xml", "xml": "application/xml", "json": "application/json", "yaml": "application/x-yaml", "yml": "application/x-yaml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
    return known.get(name.rpartition(".")[2].lower(), "application/octet-stream")


class McapSource(ds.DataSource):
    """``spark.read.format("mcap").load(path)`` and ``df.write.format("mcap").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        content = self.options.get("content", "messages")
        if content not in CONTENTS:
            raise ValueError(f"content must be one of {', '.join(CONTENTS)}")
        return CONTENTS[content]

    def reader(self, schema):
        return McapReader(self.options, schema)

    def writer(self, schema, overwrite):
        return McapWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, and let it take over filters."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(McapSource)
    return spark


def read(spark: SparkSession, path: str, content: str = "messages", **options: object) -> DataFrame:
    """Rows of logs; ``topics`` and ``parts`` may be lists and dictionaries."""
    reader = register(spark).read.format("mcap").option("content", content)
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, json.dumps(value if isinstance(value, dict) else sorted(value)) if isinstance(value, (list, dict, tuple, set, frozenset)) else value)
    return reader.load(path)


def write(messages: DataFrame, path: str, mode: str = "append", compression: str = "zstd", attachments: list[dict] | None = None, chunk_bytes: int = 4 << 20) -> None:
    """Write rows ``topic, ts_ns, data`` as indexed files, one a task.

    ``encoding, schema_name, schema_encoding, schema, publish_ns, sequence`` are taken where they are.
    ``attachments`` are ``name, path`` and perhaps ``media_type``; each file holds all of them.
    """
    register(messages.sparkSession)
    messages.write.format("mcap").mode(mode).option("compression", compression).option("chunk_bytes", chunk_bytes).option("attachments", json.dumps(attachments or [])).save(path)
