"""Clashing names, long texts, ties and tables without anything usable, for the operators whose own tests leave them out."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import LONG, TEXTS, docs, library, nothing  # noqa: F401
from tidewheel.llm import embedding_dedup, licenses, packing, quality_model, simhash, token_counts, token_files
from tidewheel.llm.common import SPACES

VERY_LONG = " ".join([LONG] * 6)


@pytest.fixture(scope="module")
def clashing(docs):  # noqa: F811
    """Columns named like what the operators make themselves."""
    own = "row start length base n_tokens n_bytes offset class rank salt key fp rep component_id x y score held_out part block sums place ids_crc32".split()
    extra = docs.sparkSession.createDataFrame([(900, VERY_LONG, "en", "s0", 1, "z"), (901, VERY_LONG, "en", "s0", 1, "z")], docs.schema)
    return docs.unionByName(extra).withColumns({n: F.lit("clash") for n in own})


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_counts_files_and_pieces(clashing):
    word, byte = library("word_bpe_49k.json"), library("byte_bpe_50k.json")
    rows = texts_of(clashing)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(clashing).collect())
    assert got == Counter((d, len((t or "").encode()), len(word(t))) for d, t in rows)
    files = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_files_roundtrip(clashing).collect())
    assert files == Counter((d, len(word(t)) + 1, zlib.crc32(np.array([*word(t), 1], "<u4").tobytes())) for d, t in rows)
    placed = packing.pack(clashing).collect()
    assert sum(r["length"] for r in placed) == sum(len(byte(t)) + 1 for _, t in rows)
    assert sum(r["doc_id"] == 900 for r in placed) == -(-(len(byte(VERY_LONG)) + 1) // 2048)


def test_fingerprints_of_long_texts(clashing):
    got = {r["doc_id"]: r for r in simhash.simhash_components(clashing).collect()}
    assert got[900]["fingerprint"] == got[901]["fingerprint"] == f"{simhash.fingerprint(VERY_LONG):016x}" and got[900]["component_id"] == got[901]["component_id"] <= 900


def test_quality_of_odd_tables(spark, clashing, nothing):  # noqa: F811
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(len(TEXTS))] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, text string")
    got = quality_model.score_quality(clashing, labels).collect()
    assert len(got) == clashing.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    of = {}
    for (d, t), r in zip(sorted(texts_of(clashing), key=str), sorted(got, key=lambda r: str(r["doc_id"]))):
        of.setdefault(r["doc_id"], set()).add(r["score"])
    assert of[900] == of[901] and len(of[900]) == 1
    assert quality_model.score_quality(nothing, labels).count() == 0
    none = quality_model.score_quality(clashing, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def slow_word_vectors(texts):
    """Each word's neighbours on both sides, one by one, in whole numbers."""
    index = quality_model.index_vectors()
    sums = np.zeros((quality_model.BUCKETS, quality_model.DIM), "i8")
    for t in texts:
        ids = quality_model.buckets_of(t).tolist()
        for i, b in enumerate(ids):
            for j in range(max(0, i - quality_model.REACH), min(len(ids), i + quality_model.REACH + 1)):
                if j != i:
                    sums[b] += index[ids[j]].astype("i8")
    return (sums / np.maximum(np.linalg.norm(sums.astype(float), axis=1, keepdims=True), 1e-9)).astype("f4")


def test_word_vectors_against_neighbours(spark):
    rng = np.random.default_rng(0)
    texts = [None, "", "one", "one two", *(" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 60))) for _ in range(40))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.array_equal(quality_model.word_vectors(df), slow_word_vectors(texts))


def test_pooled_is_mean_and_spread(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 1, (quality_model.BUCKETS, quality_model.DIM)).astype("f4")
    ids = quality_model.buckets_of("a b a c")
    x = vectors[ids]
    got = quality_model.pooled("a b a c", vectors)
    d = quality_model.DIM
    assert got[:d] == pytest.approx(x.mean(0), abs=1e-5) and got[d : 2 * d] == pytest.approx(x.std(0), abs=1e-3)
    assert got[2 * d : 3 * d] == pytest.approx(vectors[np.unique(ids)].mean(0), abs=1e-5) and got[-2:] == pytest.approx([0.75, np.log1p(4) / 10])


def test_no_valid_vector(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (None, [1.0, 0.0]), (4, None)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == Counter([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (4, 0, 4, True), (None, 0, None, False)])


def test_licenses_tie(spark):
    """Two templates of the same words are both found, wherever the text holds them."""
    text = "Permission is granted to use this thing for any purpose at all without asking anybody"
    found = licenses.scan_licenses(spark.createDataFrame([(1, f"x y {text} z"), (2, text)], "doc_id long, text string"), templates={"one": text, "two": text}).collect()
    assert len(found) == 2 and all("one" in str(r) and "two" in str(r) for r in found)
    assert set(SPACES) == set(" \t\n\x0b\x0c\r")
