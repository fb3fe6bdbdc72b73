"""Every stage of the pipeline against plain Python over the rows that the stage before gave, and the whole run against its stages."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import library, slow_fingerprint
from tidewheel.llm import mixing, pii, rules
from tidewheel.llm.common import min_labels

NAMES = ("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(140):
        text = " ".join(rng.choice(words, rng.integers(5, 90)))
        if k % 6 == 0:
            text += f" write to person{k % 4}@site{k % 3}.org or call +1 (555) 555-01{k % 90 + 10}"
        if k % 9 == 0:
            text = "spam eggs " * int(rng.integers(3, 60))
        if k % 10 == 7 and k > 10:  # a near copy
            text = rows[k - 5][1] + (" x" if k % 20 == 7 else "")
        rows.append((k, text, "en", None if k % 31 == 0 else f"s{k % 3}", len(text)))
    rows += [(500, None, "en", "s0", 0), (501, "", "en", "s1", 0), (3, rows[3][1], "en", "s0", 1)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def plain_quality(rows):
    every = rules.BASE_RULES + rules.ADDED_RULES
    return [r for r in rows if not any(rule.rejects(rules.Text(r[1])) for rule in every)]


def plain_near_duplicates(rows):
    fp = [slow_fingerprint(r[1]) for r in rows]
    labels = np.arange(len(rows))
    i, j = np.nonzero([[bin(a ^ b).count("1") <= 3 for b in fp] for a in fp])
    min_labels(labels, i, j)
    return {int(c): [r for r, x in zip(rows, labels) if x == c] for c in set(labels.tolist())}


def test_stages_and_the_whole_run(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    take = lambda df: [tuple(r) for r in df.select(*NAMES).collect()]
    rows = take(docs)
    (_, quality), (_, near), (_, private), (_, mixed), (_, packed) = corpus_pipeline.STAGES

    docs = quality(spark, docs, folder)
    assert Counter(take(docs)) == Counter(plain_quality(rows)) and 0 < docs.count() < len(rows)

    groups = plain_near_duplicates(take(docs))
    docs = near(spark, docs, folder)
    kept = take(docs)
    assert len(kept) == len(groups) < sum(map(len, groups.values()))
    assert Counter(r[0] for r in kept) == Counter(min(r[0] for r in g) for g in groups.values())

    spans = {}
    for r in pii.find_personal_data(docs).collect():
        spans[r["doc_id"]] = [x.split(":") for x in r["spans"].split(",") if x]
    docs = private(spark, docs, folder)
    want = {}
    for doc, text, *_ in kept:
        out, at = "", 0
        for kind, start, end in spans[doc]:
            if int(start) < at:  # overlaps what is gone already
                at = max(at, int(end))
                continue
            out += text[at : int(start)] + f"<{kind.upper()}>"
            at = int(end)
        want[doc] = out + text[at:]
    got = {r[0]: r[1] for r in take(docs)}
    assert got.keys() == want.keys() and any("@" in t for _, t, *_ in kept) and not any("@" in t for t in got.values())
    import re

    mark = lambda t: re.sub(r"[<\[][A-Za-z]+[>\]]", "*", t)
    assert {d: mark(t) for d, t in got.items()} == {d: mark(t) for d, t in want.items()}

    before = take(docs)
    times = {r["doc_id"]: r["times_taken"] for r in mixing.mix_sources(docs).collect()}
    docs = mixed(spark, docs, folder)
    assert Counter(take(docs)) == Counter({r: times[r[0]] for r in before if times[r[0]]})

    of, pieces = library("byte_bpe_50k.json"), Counter()
    for doc, text, *_ in take(docs):
        ids = np.array([*of(text), 1], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            pieces[doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    found = packed(spark, docs, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == pieces
    filled = Counter()
    for r in found:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in whole) == pieces
