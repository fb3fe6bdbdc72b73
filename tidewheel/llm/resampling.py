"""Target-distribution importance resampling over hashed word and word-pair features.

Every text becomes a stream of packed 16-bit bucket numbers. Blocks of streams are
written with 64-bit document offsets; sorting a block and run-length encoding it gives
its counts, and each task merges the runs of its blocks. Once the counts of corpus and
target are known, the gains are gathered along the written streams and added up between
the offsets, so texts are cut into features once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_rows, positional
from tidewheel.operators.numbering import number_rows
from tidewheel.session import materialize

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
SHARE = 25
#: Features whose gains are held at a time.
STEP = 1 << 20
#: A-Z become small letters; all other characters up to 0x7F but letters and digits become spaces.
_PLAIN = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def bucket_stream(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's words, then those of its pairs of consecutive words."""
    words = (text or "").encode().translate(_PLAIN).split()
    if not words:
        return np.zeros(0, "<u2")
    one = list(map(crc32, words))
    # a checksum goes on where another ended, so a pair costs its second word only
    two = map(crc32, map(b" ".__add__, words[1:]), one)
    n = len(words)
    out = np.empty(2 * n - 1, "u4")
    out[:n], out[n:] = one, np.fromiter(two, "u4", n - 1)
    return (out % np.uint32(buckets)).astype("<u2")


def pack_streams(docs: DataFrame, text: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """Blocks of documents: ``ids``, ``offsets`` (64-bit, one more than ids, in features) and ``stream`` (16-bit buckets)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit into 16 bits")

    def block(rows):
        found = [bucket_stream(t, buckets) for t in rows.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype("<i8")
        return {"ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), "offsets": [offsets.tobytes()], "stream": [np.concatenate([np.zeros(0, "<u2"), *found]).tobytes()]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")), block, "ids array<long>, offsets binary, stream binary")


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a stream in order and how often each comes: the sorted stream, run-length encoded."""
    ordered = np.sort(stream)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, "i8")
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def count_streams(streams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all streams. A task merges the runs of its blocks and gives each bucket once."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for raw in batch.column(0):
                value, n = runs(np.frombuffer(raw.as_buffer(), "<u2"))
                total[value] += n
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": there, "n": total[there]})

    return streams.select("stream").mapInArrow(merged, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the corpus, floored."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s_all + k)) / ((corpus + 1.0) * (t_all + k))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], "i4")


def segment_sums(stream: np.ndarray, offsets: np.ndarray, gains: np.ndarray, step: int = STEP) -> np.ndarray:
    """Sums of the gains of each document's features; zero for a document without any."""
    out = np.zeros(len(offsets) - 1, "i8")
    for at in range(0, len(stream), step):
        part = gains[stream[at : at + step]]
        cut = np.clip(offsets - at, 0, len(part))
        # documents without a feature here would make reduceat give an element instead of a sum
        live = np.flatnonzero(cut[1:] > cut[:-1])
        out[live] += np.add.reduceat(part, cut[live], dtype="i8")
    return out


def weigh_streams(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_features, weight`` of every document: the floored mean of its features' gains."""
    sent = streams.sparkSession.sparkContext.broadcast(gains)  # one number a bucket, 65,536 at most

    def weigh(rows):
        ids, sizes, weights = [], [], []
        for mine, offsets, stream in zip(rows.column("ids"), rows.column("offsets"), rows.column("stream"), strict=True):
            at = np.frombuffer(offsets.as_buffer(), "<i8")
            n = np.diff(at)
            ids.append(mine.values)
            sizes.append(n)
            weights.append(np.where(n > 0, segment_sums(np.frombuffer(stream.as_buffer(), "<u2"), at, sent.value) // np.maximum(n, 1), 0))
        return {"doc_id": pa.concat_arrays(ids), "n_features": pa.array(np.concatenate(sizes)), "weight": pa.array(np.concatenate(weights))}

    return map_rows(streams, weigh, "doc_id long, n_features long, weight long")


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, "i8")
    for bucket, n in counts.collect():  # a row for each bucket at most
        out[bucket] = n
    return out


def importance_weights(docs: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight`` of every row, from the counts of all rows of both tables."""
    streams = materialize(pack_streams(docs, text, id_col, buckets), "streams")
    wanted = materialize(pack_streams(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "text", "id", buckets), "target-streams")
    return weigh_streams(streams, gains_of(_dense(count_streams(streams, buckets), buckets), _dense(count_streams(wanted, buckets), buckets)))


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """Draw ``share`` per cent of the documents so that their features resemble the target's.

    Returns ``doc_id, n_features, weight, score, rank`` for every row. The score is the
    weight plus Gumbel noise made from ``seed`` and the id, so the highest scores are a draw
    without replacement by weight. Documents of ``least_words`` words or more can be drawn;
    the others, and those not drawn, have no rank. Ties go to the smaller id.

    A null, empty or wordless text has no features and weight zero. A row without an id
    draws the noise of an empty id and comes last among ties. Repeated rows are documents
    of their own, with equal scores and ranks that follow each other. Whole texts are
    taken whatever their length; one text's features must fit into a 2 GB block
    (about 500 million words). An empty table of documents gives an empty table, an empty target gains
    that only even out the corpus. Other columns take no part, whatever their names.
    """
    plain, name, _ = positional(docs)
    weighed = importance_weights(plain, target, name(text), name(id_col), target_text, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    long_enough = F.col("n_features") >= 2 * least_words - 1 if least_words > 0 else F.lit(True)
    able = scored.where(long_enough).withColumn("order", F.struct((-F.col("score")).alias("score"), F.col("doc_id").isNull().alias("none"), "doc_id", "n_features", "weight"))
    ranked = number_rows(able, "order", "place").drop("order")
    drawn = able.count() * share // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    return ranked.withColumn("rank", rank).drop("place").unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of the UTF-8 bytes as SQL: the table of 256 remainders comes from the polynomial, eight shifts each.
RESAMPLING_SQL = r"""
WITH RECURSIVE shifts(k, step, v) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT k, step + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM shifts WHERE step < 8),
crc AS (SELECT list(v ORDER BY k) AS t FROM shifts WHERE step = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
dn AS (SELECT doc_id, f, count(*) AS n FROM df GROUP BY ALL),
bn AS (SELECT f, count(*) AS n FROM bf GROUP BY ALL),
feature AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM dn UNION SELECT f FROM bn)),
place AS (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda c, y: xor(c // 256, crc.t[xor(c, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM feature, crc),
s AS (SELECT bucket, sum(n) AS n FROM dn JOIN place USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bn JOIN place USING (f) GROUP BY bucket),
gain AS (
  SELECT range AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM range(10000) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
w AS (SELECT doc_id, sum(n) AS n_features, sum(n * g) AS g FROM dn JOIN place USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
v AS (
  SELECT d.doc_id, CAST(coalesce(w.n_features, 0) AS BIGINT) AS n_features, len(d.w) AS n_words,
    CAST(CASE WHEN w.g IS NULL THEN 0 ELSE (w.g - ((w.g % w.n_features) + w.n_features) % w.n_features) // w.n_features END AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, n_features, n_words, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM v),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM o WHERE n_words >= 20)
SELECT o.doc_id, o.n_features, o.weight, o.score, CASE WHEN r.place <= 25 * (SELECT count(*) FROM r) // 100 THEN r.place END AS rank FROM o LEFT JOIN r USING (doc_id)
"""
