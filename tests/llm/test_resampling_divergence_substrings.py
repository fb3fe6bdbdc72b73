"""Resampling, source divergence and repeated windows against plain Python, on odd texts, ties and copies."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import divergence, resampling, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, key string, places string"
PASSAGE = " ".join(f"p{k}" for k in range(45))
LONG = " ".join(f"Word{k % 977} and{k % 13}" for k in range(9000))
TEXTS = [None, "", " \n", "a", "É é İ ß The the", PASSAGE, f"x {PASSAGE} y", f"{PASSAGE} {PASSAGE}", PASSAGE, LONG, "ha " * 70, "ha\tha\n" * 30, " ".join(PASSAGE.split()[:20]), "日本語 ½ don't stop", "1 2 3 " * 9]


def small_rows():
    rows = [(k, t, None if k == 4 else ("en" if k % 2 else "de"), None if k == 3 else f"s{k % 3}", 1, "r", "k", "p") for k, t in enumerate(TEXTS)]
    # a null id twice, a repeated row, one id with two texts
    return [*rows, (None, f"q {PASSAGE}", "en", "s0", 1, "r", "k", "p"), (None, PASSAGE, "en", "", 1, "r", "k", "p"), (5, PASSAGE, "de", "s2", 1, "r", "k", "p"), (6, f"other {PASSAGE}", "de", "s0", 1, "r", "k", "p")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(small_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "the passage and Word1 and1", "z"), (2, None, "z"), (3, "p1 p2 p3 p4", "z")], "item_id long, text string, ids string")


# --- resampling


def slow_features(text, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % buckets for f in found]


def slow_resample(rows, target, share=25, least=20, seed=7, buckets=10_000):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(slow_features(text, buckets)[1])
    for text in target:
        t.update(slow_features(text, buckets)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        n, f = slow_features(text, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = [k + 1 if k < share * len(able) // 100 else None for k in range(len(able))]
    return Counter([(*r[:4], k) for r, k in zip(able, rank)] + [(*r[:4], None) for r in out if not r[4]])


def test_stream_holds_words_and_pairs():
    for text in TEXTS:
        n, f = slow_features(text, 10_000)
        assert resampling.bucket_stream(text).tolist() == f and len(f) == max(2 * n - 1, 0)


@pytest.mark.parametrize("share,buckets", [(25, 10_000), (60, 7), (100, 65536)])
def test_resample_against_brute_force(spark, docs, target, share, buckets):
    got = resampling.resample(docs, target, share=share, buckets=buckets).collect()
    assert Counter(tuple(r) for r in got) == slow_resample([(r[0], r[1]) for r in small_rows()], [r["text"] for r in target.collect()], share=share, buckets=buckets)


def test_resample_of_many_and_ties(spark, target):
    rng = np.random.default_rng(3)
    rows = [(k // 2, " ".join(rng.choice(["the", "p1", "p2", "and1", "zz"], rng.integers(15, 30)))) for k in range(400)] + [(9, "same " * 25)] * 6
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), target, share=33).collect()
    assert Counter(tuple(r) for r in got) == slow_resample(rows, [r["text"] for r in target.collect()], share=33)


def test_resample_empty_tables(nothing, docs, target):
    assert resampling.resample(nothing, target).count() == 0
    got = resampling.resample(docs, target.limit(0)).collect()
    assert Counter(tuple(r) for r in got) == slow_resample([(r[0], r[1]) for r in small_rows()], [])
    with pytest.raises(ValueError, match="16 bits"):
        resampling.resample(docs, target, buckets=70_000)


def test_segment_sums_step_by_step():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 9, 60)
    offsets, gains = np.concatenate([[0], np.cumsum(sizes)]), rng.integers(-50, 50, 11).astype("i4")
    stream = rng.integers(0, 11, offsets[-1]).astype("<u2")
    want = [int(gains[stream[a:b]].sum()) for a, b in zip(offsets, offsets[1:])]
    for step in (1, 3, 7, 1000):
        assert resampling.segment_sums(stream, offsets, gains, step).tolist() == want


def test_runs_count():
    for stream in (np.zeros(0, "<u2"), np.array([5, 1, 5, 65535, 1, 5], "<u2")):
        value, n = resampling.runs(stream)
        assert dict(zip(value.tolist(), n.tolist())) == dict(Counter(stream.tolist()))


def test_streams_are_written_as_packed_files(spark, docs):
    blocks = resampling.pack_streams(docs).collect()
    assert sum(len(b["ids"]) for b in blocks) == len(small_rows())
    for b in blocks:
        at = np.frombuffer(b["offsets"], "<i8")
        assert at[0] == 0 and len(at) == len(b["ids"]) + 1 and 2 * at[-1] == len(b["stream"])


# --- divergence


def slow_divergence(rows, least, top, smoothing=5):
    held, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        held[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        mine = sorted(s for g, s in groups if g == lang)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + smoothing) // (n + smoothing * len(kept)) for t in kept}

        p = {s: shares(held[lang, s]) for s in mine}
        q = shares(sum((held[lang, s] for s in mine), Counter()))
        for s in mine:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if held[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, last in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:last])]
    return Counter(out)


@pytest.mark.parametrize("least,top", [(1, 50), (2, 3), (30, 50)])
def test_divergence_against_brute_force(docs, least, top):
    got = divergence.source_divergence(docs, least_docs=least, top=top).collect()
    assert Counter(tuple(r) for r in got) == slow_divergence([r[1:4] for r in small_rows()], least, top)


def test_divergence_of_random_sources(spark):
    rng = np.random.default_rng(2)
    words = ["The", "the", "ÉT", "ét", "Zz", "aa", "日本", "x1y"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), str(rng.choice(["en", "de", ""])), None if rng.random() < 0.1 else f"s{rng.integers(0, 5)}") for _ in range(500)]
    got = divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4), least_docs=30, top=4).collect()
    assert Counter(tuple(r) for r in got) == slow_divergence(rows, 30, 4)


def test_divergence_is_exact_for_large_counts(spark):
    count, total = 4 * 10**15 + 1, 8 * 10**15 + 3
    row = spark.range(1).select(divergence._share(F.lit(count), F.lit(total), F.lit(7), 5).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (count + 5) // (total + 35)


def test_divergence_empty(nothing):
    assert divergence.source_divergence(nothing).count() == 0


def test_divergence_runs_in_the_jvm(docs):
    plan = divergence.source_divergence(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


# --- repeated windows


def slow_without(rows, window):
    first = {}
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    rank = [(d is None, d or 0) for d, _ in rows]
    for r, ws in zip(rank, split):
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            first[k] = min(first.get(k, (r, i)), (r, i))
    # rows of one id and one text share their marks; so do their windows
    out = []
    for (d, _), r, ws in zip(rows, rank, split):
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < (r, i):
                gone |= set(range(i, i + window))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window", [20, 5, 3, 2, 1])
def test_repeats_against_brute_force(docs, window):
    got = substrings.without_repeats(docs, window=window).collect()
    assert Counter(tuple(r) for r in got) == slow_without([(r[0], r[1]) for r in small_rows()], window)


@pytest.mark.parametrize("frequent,remembered,together", [(200_001, 50_000, 400_000), (200_000, 50_000, 400_000), (1, 3, 60), (1, 50_000, 10**6), (200_000, 3, 60)])
def test_repeats_whatever_way_windows_travel(spark, monkeypatch, frequent, remembered, together):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "TIMES_MEAN", 0 if frequent == 1 else 8)
    monkeypatch.setattr(substrings, "REMEMBERED", remembered)
    monkeypatch.setattr(substrings, "TOGETHER", together)
    monkeypatch.setattr(substrings, "VOCABULARY", 4 if frequent == 200_001 else 60_000)
    rng = np.random.default_rng(5)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(20, 60))) for _ in range(6)]
    rows = [(int(rng.integers(0, 120)), " ".join([f"d{k}", *(str(rng.choice(passages)) if rng.random() < 0.5 else " ".join(f"w{x}" for x in rng.integers(0, 3, 25)) for _ in range(rng.integers(1, 5)))])) for k in range(150)]
    rows += [(500 - k, passages[0]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = substrings.without_repeats(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    assert Counter(tuple(r) for r in got) == slow_without(rows, 20)


@pytest.mark.parametrize("longest", [1, 2, 64])
def test_strings_cover_each_window_once(monkeypatch, longest):
    monkeypatch.setattr(substrings, "LONGEST", longest)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, n)).encode() for n in (0, 5, 19, 20, 21, 400)] + [b"a " * 500]
    w = substrings.Windows(texts, 20)
    begin, length = w.runs(np.zeros(len(w.at), bool))
    got = []
    numbers = {b"w0": 0, b"w2": 1, b"a": 2}
    strings = w.packed(begin, length, numbers)
    name = {}
    for k, word in zip(substrings.unpack(strings, length + 19).tolist(), [x for b, n in zip(w.at[begin], length) for x in w.words[b : b + n + 19]]):
        assert name.setdefault(k, word) == word
    assert len(set(name.values())) == len(name)
    rest = {v: k for k, v in numbers.items()}
    for s, n, text, at in zip(strings, length, w.text[begin], w.at[begin] - w.base[w.text[begin]]):
        other = iter(s[2 * (n + 19) :].split(b" "))
        words = [rest.get(c) or next(other) for c in np.frombuffer(s[: 2 * (n + 19)], "<u2").tolist()]
        assert len(words) == n + 19
        got += [(int(text), int(at + k), b" ".join(words[k : k + 20])) for k in range(n)]
    want = [(t, k, b" ".join(x.split()[k : k + 20])) for t, x in enumerate(texts) for k in range(len(x.split()) - 19)]
    assert got == want
    # windows of the same words have the same minimiser
    of = defaultdict(set)
    for m, t, a in zip(w.minimiser.tolist(), w.text, w.at - w.base[w.text]):
        of[b" ".join(texts[t].split()[a : a + 20])].add(m)
    assert all(len(x) == 1 for x in of.values())


def test_two_windows_of_one_hash_stay_apart(monkeypatch):
    """With a hash that says nothing, the words themselves decide."""
    monkeypatch.setattr(substrings, "_rolled", lambda values, width: np.zeros(max(len(values) - width + 1, 0), "u8"))
    strings = [np.array(x, "<u2").tobytes() for x in ([0, 1, 2, 3], [0, 1, 2, 4], [5, 1, 2, 4], [0, 1, 2, 3])]
    row, off = substrings._later_places(3, np.zeros(4, bool), np.array([4, 3, 2, 1]), np.zeros(4, "i8"), np.full(4, 2), strings)
    assert sorted(zip(row.tolist(), off.tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_repeats_of_nothing(nothing):
    assert substrings.without_repeats(nothing).count() == 0
