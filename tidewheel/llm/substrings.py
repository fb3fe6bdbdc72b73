"""Substring deduplication: windows of words that an earlier place already holds.

Consecutive windows that share a minimiser travel as one packed string to that
minimiser's bucket. Equal windows have equal minimisers, so a bucket holds all of a
window's places, and sorting its windows finds the first place of each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_rows, pieces, positional
from tidewheel.session import materialize, small_batches

WINDOW = 20
#: Words of the runs of which the least hash is a window's minimiser.
PART = 3
#: Windows that one packed string holds at most.
LONGEST = 64
#: Slots of the counts that tell frequent minimisers: half a megabyte of bits is sent to all tasks.
SLOTS = 1 << 22
#: One document of so many is counted to find the frequent minimisers; results do not depend on them.
COUNTED = 16
#: A slot is frequent if it has so many windows, and so many times the mean.
FREQUENT, TIMES_MEAN = 200_000, 8
#: Packed strings that a task remembers in each of two generations.
REMEMBERED = 50_000
#: Words that travel as a number of two bytes, and the documents they are looked for in; all others travel as they are.
VOCABULARY, VOCABULARY_DOCS = 60_000, 20_000
_OTHER = 0xFFFF
#: Words that a bucket task takes together, always whole buckets.
TOGETHER = 400_000
_SCHEMA = "key long, doc_id long, h long, start int, n int, packed binary"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` values, from hashes of runs of powers of two."""
    out, have, run, size, factor = None, 0, values, 1, _ODD[:1]
    while True:
        if width & size:
            if out is None:
                out, have = run, size
            else:
                n = len(values) - have - size + 1
                out = out[: max(n, 0)] * factor + run[have : have + max(n, 0)]
                have += size
        size *= 2
        if size > width:
            return _mixed(out[: max(len(values) - width + 1, 0)])
        half = size // 2
        n = max(len(run) - half, 0)
        run = run[:n] * factor + run[half : half + n]
        factor = factor * factor + _ODD[2:]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    size, run = 1, values
    while size * 2 <= width:
        run = np.minimum(run[: len(run) - size], run[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(run[:n], run[width - size : width - size + n])


class Windows:
    """The windows of some texts: word values, and minimisers by place."""

    def __init__(self, texts: list[bytes], window: int, part: int = PART) -> None:
        split = [t.split() for t in texts]
        self.words = [w for ws in split for w in ws]
        self.n_words = np.array([len(ws) for ws in split], "i8")
        self.base = np.concatenate([[0], np.cumsum(self.n_words)])
        self.window, part = window, min(part, window)
        values = np.fromiter(map(crc32, self.words), "u8", len(self.words))
        self.values = _mixed(values + _ODD[2])
        per_doc = np.maximum(self.n_words - window + 1, 0)
        #: Place of each window's first word, and the text that it belongs to.
        self.text = np.repeat(np.arange(len(texts)), per_doc)
        self.at = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + self.base[self.text]
        if len(self.at):
            self.minimiser = _least(_rolled(self.values, part), window - part + 1)[self.at]
        else:
            self.minimiser = np.zeros(0, "u8")

    def runs(self, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each packed string.

        A string ends where the text or the minimiser changes, and after ``LONGEST``
        windows; windows marked ``alone`` are strings of their own.
        """
        n = len(self.at)
        if not n:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        new = np.ones(n, bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (self.minimiser[1:] != self.minimiser[:-1]) | alone[1:] | alone[:-1]
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, n))
        cuts = -(-length // LONGEST)
        begin = np.repeat(first, cuts) + LONGEST * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        return begin, np.diff(np.append(begin, n))

    def packed(self, begin: np.ndarray, length: np.ndarray, numbers: dict[bytes, int]) -> list[bytes]:
        """Each string's words as two-byte numbers, and behind them the words that have none, in order."""
        codes = np.fromiter(map(numbers.get, self.words, repeat(_OTHER)), "<u2", len(self.words))
        other = np.flatnonzero(codes == _OTHER)
        first, end = self.at[begin], self.at[begin + length - 1] + self.window
        a, b = np.searchsorted(other, first), np.searchsorted(other, end)
        raw = codes.tobytes()
        strings = [raw[x:y] for x, y in zip((2 * first).tolist(), (2 * end).tolist(), strict=True)]
        rest = [self.words[k] for k in other.tolist()]
        for k in np.flatnonzero(b > a).tolist():
            strings[k] += b" ".join(rest[a[k] : b[k]])
        return strings


def unpack(strings: list[bytes], n_words: np.ndarray) -> np.ndarray:
    """A number for each word of all strings; equal words of these strings have equal numbers."""
    ends = (2 * n_words).tolist()
    word = np.frombuffer(b"".join([s[:e] for s, e in zip(strings, ends, strict=True)]), "<u2").astype("i4")
    rest = b" ".join([s[e:] for s, e in zip(strings, ends, strict=True) if len(s) > e])
    if rest:
        number: dict[bytes, int] = defaultdict(count(_OTHER).__next__)
        words = rest.split(b" ")
        word[word == _OTHER] = np.fromiter(map(number.__getitem__, words), "i4", len(words))
    return word


def frequent_words(docs: DataFrame) -> dict[bytes, int]:
    """Numbers of the most frequent words of a sample; they only make what travels shorter."""
    share = min(1.0, VOCABULARY_DOCS / max(1, docs.count()))
    words = docs.sample(share, seed=2).select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    top = words.groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(VOCABULARY)
    return {r["word"].encode(): k for k, r in enumerate(top.collect())}  # VOCABULARY rows at most


def _slot(minimiser: np.ndarray) -> np.ndarray:
    return (minimiser % np.uint64(SLOTS)).astype("i8")


def frequent_slots(docs: DataFrame, window: int) -> np.ndarray:
    """Packed bits of the slots whose minimisers are so frequent that their windows travel alone.

    They are told from a sample of the documents. Only the way that windows travel depends on
    them: whatever the bits, equal windows meet.
    """
    small_batches(docs.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            w = Windows([(t or "").encode() for t in part.column("text").to_pylist()], window)
            slot, n = np.unique(_slot(w.minimiser), return_counts=True)
            yield pa.RecordBatch.from_pydict({"slot": slot, "n": n})

    sampled = docs.sample(1 / COUNTED, seed=1).select("text")
    counts = materialize(sampled.mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "slots")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT / COUNTED, TIMES_MEAN * total / SLOTS)
    bits = np.zeros(SLOTS, bool)
    bits[[r["slot"] for r in counts.where(F.col("n") > least).select("slot").collect()]] = True  # a row a slot, SLOTS / TIMES_MEAN at most
    return np.packbits(bits)


def pack_windows(docs: DataFrame, window: int, alone: np.ndarray, numbers: dict[bytes, int]) -> DataFrame:
    """Packed strings of ``n`` windows from word ``start`` of a document; rows without a string are places known to be repeats.

    A task remembers the first place of strings that it has met. A later place of the same
    string is a repeat wherever the first may be, so it need not travel.
    """
    sent, vocabulary = docs.sparkSession.sparkContext.broadcast(alone), docs.sparkSession.sparkContext.broadcast(numbers)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(sent.value).astype(bool) if sent.value.any() else None
        young: dict[tuple, tuple] = {}
        old: dict[tuple, tuple] = {}
        for part in pieces(batches):
            rows = sorted(zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), part.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0))
            w = Windows([(r[2] or "").encode() for r in rows], window)
            single = frequent[_slot(w.minimiser)] if frequent is not None else np.zeros(len(w.at), bool)
            begin, length = w.runs(single)
            if not len(begin):
                continue
            strings, text = w.packed(begin, length, vocabulary.value), w.text[begin]
            key = w.minimiser[begin]
            if single.any():
                key = np.where(single[begin], _rolled(w.values, window)[w.at[begin]], key)
            start = w.at[begin] - w.base[text]
            travels = np.zeros(len(begin), bool)
            ranks = [(r[0] is None, r[0] or 0) for r in rows]
            for k, (s, t, a) in enumerate(zip(zip(length.tolist(), strings, strict=True), text.tolist(), start.tolist(), strict=True)):
                place = (ranks[t], a)
                seen = young.get(s) or old.get(s)
                if seen is None or place <= seen:
                    travels[k] = True
                    seen = place
                young[s] = seen
                if len(young) > REMEMBERED:
                    young, old = {}, young
            yield _block(rows, key, text, start, length, strings, travels)

    return docs.mapInArrow(run, _SCHEMA)


def _block(rows: list[tuple], key, text, start, length, strings, travels) -> pa.RecordBatch:
    # repeats that follow each other are one row
    repeat = ~travels
    joins = np.zeros(len(text), bool)
    joins[1:] = repeat[1:] & repeat[:-1] & (text[1:] == text[:-1]) & (start[1:] == start[:-1] + length[:-1])
    first = np.flatnonzero(~joins)
    ends = np.append(first[1:], len(text))
    total = np.concatenate([[0], np.cumsum(length)])
    n = total[ends] - total[first]
    ids, hashes = [r[0] for r in rows], [r[1] for r in rows]
    t = text[first].tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key[first].view("i8")),
            pa.array([ids[k] for k in t], pa.int64()),
            pa.array([hashes[k] for k in t], pa.int64()),
            pa.array(start[first].astype("i4")),
            pa.array(n.astype("i4")),
            pa.array([strings[k] if travels[k] else None for k in first.tolist()], pa.binary()),
        ],
        names=["key", "doc_id", "h", "start", "n", "packed"],
    )


def _later_places(window: int, none: np.ndarray, ids: np.ndarray, start: np.ndarray, n: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of the windows whose words also start at an earlier place among these rows."""
    word = unpack(strings, n + window - 1)
    hashed = _rolled(_mixed(word.astype("u8") + _ODD[2]), window)
    row = np.repeat(np.arange(len(n)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(n + window - 1) - (n + window - 1)
    at = base[row] + off
    h = hashed[at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    # a window that is alone with its hash needs no further look
    many = np.zeros(len(order), bool)
    many[1:] = same
    many[:-1] |= same
    order = order[many]
    if not len(order):
        return row[:0], off[:0]
    spread = np.arange(window)
    equal = (word[at[order][1:, None] + spread] == word[at[order][:-1, None] + spread]).all(axis=1) if len(order) > 1 else np.zeros(0, bool)
    if not (equal | (h[order][1:] != h[order][:-1])).all():
        # two sequences of one hash: sort by the words themselves
        order = order[np.lexsort(word[at[order][:, None] + spread].T)]
        equal = (word[at[order][1:, None] + spread] == word[at[order][:-1, None] + spread]).all(axis=1)
    group = np.concatenate([[0], np.cumsum(~equal)])
    place = np.lexsort((start[row[order]] + off[order], ids[row[order]], none[row[order]], group))
    order, group = order[place], group[place]
    first = order[np.searchsorted(group, group)]
    r, f = row[order], row[first]
    later = (none[r] != none[f]) | (ids[r] != ids[f]) | (start[r] + off[order] != start[f] + off[first])
    return row[order[later]], off[order[later]]


def _marks(window: int):
    """Buckets come sorted; emits the repeats among each one's windows, and passes on rows that are repeats already."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id")
        none = np.asarray(ids.is_null())
        at, length = batch.column("start").to_numpy(), batch.column("n").to_numpy().astype("i8")
        row, off = _later_places(window, none, ids.fill_null(0).to_numpy(), at.astype("i8"), length, batch.column("packed").to_pylist())
        order = np.lexsort((off, row))
        row, off = row[order], off[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)])) if len(row) else row
        n = np.diff(np.append(new, len(row)))
        taken = batch.select(["doc_id", "h"]).take(pa.array(row[new]))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array((at[row[new]] + off[new]).astype("i4")), pa.array(n.astype("i4"))], names=["doc_id", "h", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            known = batch.column("packed").is_null()
            if pc.any(known).as_py():
                yield batch.filter(known).select(["doc_id", "h", "start", "n"])
                batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
            words = pc.sum(batch.column("n")).as_py() + (window - 1) * batch.num_rows
            if size + words > TOGETHER:
                # all that is held up to the last change of bucket can go
                key = batch.column("key").to_numpy()
                change = np.flatnonzero(key != key[-1])
                cut = int(change[-1]) + 1 if len(change) else 0
                if cut or (held and held[-1].column("key")[-1].as_py() != key[-1]):
                    yield found(_one([*held, batch.slice(0, cut)]))
                    held, size, batch = [], 0, batch.slice(cut)
                    words = pc.sum(batch.column("n")).as_py() + (window - 1) * batch.num_rows
            held.append(batch)
            size += words
        if held:
            yield found(_one(held))

    return run


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def repeated_places(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``doc_id, h, start, n``: from word ``start`` on, ``n`` windows of the document repeat an earlier place.

    ``h`` is a hash of the text, so that rows of one id can be told apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("h"), F.col(text).cast("string").alias("text"))
    packed = pack_windows(rows, window, frequent_slots(rows, window), frequent_words(rows))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_marks(window), "doc_id long, h long, start int, n int")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


#: Bits of the filter that tells which documents may have a repeat: 16 MB whatever their number.
FILTER_BITS = 1 << 27


def _filter_of(places: DataFrame) -> np.ndarray:
    """A bit for each text hash of a document with repeats, as bytes; of fixed size."""
    bit = F.pmod("h", F.lit(FILTER_BITS)) + 1
    found = places.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((FILTER_BITS // 32768, 4096), "u1")
    for k, bits in found.collect():  # FILTER_BITS / 32768 rows of 4096 bytes at most
        out[k - 1] = np.frombuffer(bits, "u1")
    return out.reshape(-1)


def _cut(rows: pa.RecordBatch, window: int) -> dict:
    """Words, removed words and what is left of each text, from the places that repeat."""
    total, gone, left = [], [], []
    for text, places in zip(rows.column("text").to_pylist(), rows.column("places").to_pylist(), strict=True):
        words = (text or "").encode().split()
        total.append(len(words))
        if places:
            change = np.zeros(len(words) + 1, "i8")
            np.add.at(change, [p["start"] for p in places], 1)
            np.add.at(change, [p["start"] + p["n"] + window - 1 for p in places], -1)
            keep = np.cumsum(change[:-1]) == 0
            gone.append(len(words) - int(keep.sum()))
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        else:
            gone.append(0)
        left.append(b" ".join(words).decode())
    return {"n_words": total, "n_removed": gone, "kept_text": left}


def without_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Texts without the words of windows that an earlier place holds as well.

    Returns ``doc_id, n_words, n_removed, kept_text``, a row for each row. Words are
    ``[^\\x20\\x09-\\x0D]+`` and stay as they are; ``kept_text`` joins what is left by
    single spaces. Places are ordered by id, then by the number of the window's first
    word. Windows are judged on the input, so words that go in one place still count as the
    earlier place of others.

    A null, empty or wordless text has no words; a text shorter than the window is kept.
    Rows of one id are one document: their windows are ordered by the first word alone,
    and both of two equal windows with one first word stay. Rows without an id count
    likewise as one document, after all others. An empty table gives an empty table.
    Whole texts are taken, however long (a task holds a few whole texts at a time); other
    columns take no part, whatever their names.
    """
    plain, name, _ = positional(docs)
    rows = plain.select(F.col(name(id_col)).cast("long").alias("doc_id"), F.col(name(text)).cast("string").alias("text"), text_hash(F.col(name(text))).alias("h"))
    places = materialize(repeated_places(rows, "text", "doc_id", window), "places")
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter_of(places))

    def may_repeat(part):
        h = part.column("h").to_numpy()
        at = np.mod(h, FILTER_BITS)
        return {"doc_id": part.column("doc_id"), "h": part.column("h"), "text": part.column("text"), "may": (bits.value[at // 8] >> (at % 8)) & 1 == 1}

    schema = "doc_id long, n_words long, n_removed long, kept_text string"

    def cut(part):
        return {"doc_id": part.column("doc_id")} | _cut(part, window)

    split = map_rows(rows.select("doc_id", "h", "text"), may_repeat, "doc_id long, h long, text string, may boolean")
    clean = split.where("not may").withColumn("places", F.lit(None).cast("array<struct<start:int,n:int>>"))
    gathered = places.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    a, b = split.where("may").alias("a"), gathered.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")), "left")
    return map_rows(clean.select("doc_id", "text", "places"), cut, schema).unionByName(map_rows(joined.select("a.doc_id", "a.text", "b.places"), cut, schema))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM x),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE k > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
