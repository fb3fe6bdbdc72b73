"""The corpus operators against brute force, on texts with nulls, ties, copies and junk."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewheel.functions import near
from tidewheel.llm import bpe, embedding_dedup, licenses, mixing, packing, pii, quality_model, rules, simhash, token_counts, token_files
from tidewheel.llm.common import min_labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(9000))
BASE = "the quick brown fox jumps over the lazy dog while many other words follow each other along the road to town and back again without end"
TEXTS = [None, "", " ", "\n\n", "a", "a b", "a\x1fb c", BASE, BASE, BASE + " x", "THE " + BASE, LONG, "don't stop ''s <|endoftext|> x", "日本語 é İ ½", "x " * 50, "mail a.b@c.de or a.b@c.de, ip 1.2.3.4 256.1.1.1, card 4111 1111 1111 1111, tel +1 (555) 555-0100", "﻿odd line\x0bend"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k == 3 else f"s{k % 4}", len(t or ""), "z") for k, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s0", 5, "z"), (4, "a", "en", "s0", 1, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    b, of = bpe.load(bpe.tokenizer_path(name)), library(name)
    texts = [t or "" for t in TEXTS] + ["".join(np.random.default_rng(k).choice(list("ab Z'sé.,\n\t09ß "), 60)) for k in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode_all(texts)] == [of(x) for x in texts]
    assert b.count_all(texts) == [len(of(x)) for x in texts]


def test_ids_with_little_memory(monkeypatch):
    """What is remembered changes no id, however often it is given up."""
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    rng = np.random.default_rng(0)
    texts = [" ".join(f"word{k} the" for k in rng.integers(0, 60, 12)) for _ in range(60)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        b, of = bpe.Bpe(bpe.tokenizer_path(name)), library(name)
        for at in range(0, 60, 4):
            part = texts[at : at + 4]
            assert [np.frombuffer(x, "<u4").tolist() for x in b.encode_all(part)] == [of(x) for x in part]
            assert b.count_all(part) == [len(of(x)) for x in part]


def test_token_counts(docs, nothing):
    of = library("word_bpe_49k.json")
    for r in token_counts.count_tokens(docs, limit=100).collect():
        if r["doc_id"] is not None and r["doc_id"] != 4:
            t = TEXTS[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(of(t)), len(of(t)) > 100)
    assert token_counts.count_tokens(nothing).count() == 0


def test_token_files(docs, nothing):
    of, at = library("word_bpe_49k.json"), 0
    got = sorted(token_files.token_files_roundtrip(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted([*range(len(TEXTS)), 4])]
    for r in got:
        ids = [*of("no id" if r["doc_id"] is None else TEXTS[r["doc_id"]]), 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_files_roundtrip(nothing).count() == 0


def test_packing(docs, nothing):
    of = library("byte_bpe_50k.json")
    got = packing.pack(docs).collect()
    fill, cover = Counter(), Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
        if r["doc_id"] is not None:
            ids = [*of(TEXTS[r["doc_id"]]), 1]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
            cover[r["doc_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and all(cover[k] == (1 + (k == 4)) * (len(of(t)) + 1) for k, t in enumerate(TEXTS))
    for s in fill:
        spans = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist()
    assert packing.pack(nothing).count() == 0


def test_cutting_stock_covers_and_is_tight():
    rng = np.random.default_rng(0)
    for n in (1, 30, 3000):
        demand = np.bincount(rng.integers(1, 33, n), minlength=33)[1:]
        found = packing.patterns(np.arange(1, 33), demand, 32)
        assert (sum(o * k for o, k in found) == demand).all() and all(o @ np.arange(1, 33) <= 32 for o, _ in found)
        least = -(-(demand @ np.arange(1, 33)) // 32)
        assert sum(k for _, k in found) <= (1.02 * least + 2 if n > 100 else 11 / 9 * least + 1)
    assert packing.patterns(np.arange(1, 33), np.zeros(32, "i8"), 32) == []


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, nothing):
    fp = [slow_fingerprint(t) for t in TEXTS]
    assert [simhash.fingerprint(t) for t in TEXTS] == fp
    labels = np.arange(len(fp))
    i, j = np.nonzero([[bin(a ^ b).count("1") <= 3 for b in fp] for a in fp])
    min_labels(labels, i, j)
    for r in simhash.simhash_components(docs).collect():
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == labels[r["doc_id"]]
    assert simhash.simhash_components(nothing).count() == 0


def test_blocks_meet_any_three_damaged_bytes():
    import itertools

    blocks = simhash.blocks_of_four()
    assert len(blocks) == 14 and all(any(not set(b) & set(d) for b in blocks) for d in itertools.combinations(range(8), 3))


@pytest.mark.parametrize("long_list", [20_000, 7])
def test_links_lose_no_pair(spark, long_list):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 6, dtype="u8")
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, k)).astype("u8"), axis=1) for c in centre for k in (1, 2, 3)]))
    labels = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    min_labels(labels, i, j)
    classes = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps.view("i8"))], "fp long, rep long")
    got = np.arange(len(fps))
    edges = np.array([tuple(r) for r in simhash.links(classes, long_list).collect()])
    min_labels(got, edges[:, 0], edges[:, 1])
    assert (got == labels).all()


def slow_repeats(words):
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_quality_rules(docs, nothing):
    got = {r["doc_id"]: r for r in rules.quality_report(docs).collect()}
    for k, t in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), slow_repeats(words))
        assert not (r["base_failed"] and r["kept"])
    assert got[7]["kept"] and got[14]["base_failed"]
    verdict = {r["doc_id"]: r["kept"] for r in rules.quality_rules(docs).collect()}
    assert verdict == {k: r["kept"] for k, r in got.items()}
    assert rules.quality_report(nothing).count() == 0 and rules.quality_rules(nothing).count() == 0


def test_cascade_charges_what_a_rule_adds():
    """Work of shared features counts once, rejections only among texts that are left."""
    a, b, c = (rules.Rule(n, reads, None) for n, reads in (("a", ("n_words",)), ("b", ("n_words", "most_common")), ("c", ("n_symbols",))))
    # (bytes, words, lines, rejected by a, b, c)
    sample = [(600, 100, 1, [k < 5, k < 8, False]) for k in range(10)]
    plan = rules.order_rules((a, b, c), sample)
    assert [(x["rule"].name, x["selectivity"]) for x in plan] == [("a", 0.5), ("b", 0.6), ("c", 0.0)]
    work = rules.FEATURES
    after_a = [x for x in plan if x["rule"].name == "b"][0]
    assert after_a["cost_ns"] == pytest.approx(100 * (work["ids"][1][1] + work["most_common"][1][1]))  # words are there already
    assert [x for x in rules.order_rules((a,), sample, rules.needed(("n_words",)))][0]["cost_ns"] == 0
    cheap = rules.order_rules((a, b, c), [(600, 100, 1, [k < 5, k < 8, k == 9]) for k in range(10)])
    assert [x["rule"].name for x in cheap] == ["c", "a", "b"]  # a tenth for a sixth of the work


def test_cascade_is_the_same_again(docs, spark):
    names = lambda: [x["rule"].name for x in rules.plan_cascade(docs, rules.BASE_RULES + rules.ADDED_RULES)]
    first = names()
    assert sorted(first) == sorted(r.name for r in rules.BASE_RULES + rules.ADDED_RULES) and all(names() == first for _ in range(3))
    assert sorted(map(str, rules.quality_rules(docs).collect())) == sorted(map(str, rules.quality_rules(docs).collect()))
    with pytest.raises(ValueError):
        rules.quality_rules(docs.withColumn("kept", F.lit(1)), keep=("kept",))


def test_report_equals_sql(docs, spark):
    import duckdb

    c = duckdb.connect()
    table = docs.toArrow()
    c.register("documents", table)
    want = c.execute(rules.REPORT_SQL)
    names = [d[0] for d in want.description]
    key = lambda r: str(r)
    assert sorted((tuple(r[n] for n in names) for r in rules.quality_report(docs).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_repeated_words_random():
    rng = np.random.default_rng(0)
    for _ in range(60):
        ids = rng.integers(0, 2, rng.integers(0, 60))
        assert rules.repeated_words(ids) == slow_repeats(ids.tolist())


def test_personal_data(docs, nothing):
    r = pii.find_personal_data(docs).where("doc_id = 15").first()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (2, 1, 1, 1)
    assert pii.find_personal_data(nothing).count() == 0
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[15] and "4111" not in clean[15] and clean[7] == BASE and clean[0] is None


def test_disclosing_terms(spark):
    rows = [(k, f"note {k} from agent zanzibar at x@y.com about case item{chr(97 + k)}") for k in range(5)]
    rows += [(10 + k, f"note {k} from agent nobody about the case and more") for k in range(40)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[0][1]
    assert f"term:{text.index('zanzibar')}:{text.index('zanzibar') + 8}" in got[0] and got[0].count("email") == 1
    assert f"term:{text.index('agent')}" not in got[0] and got[10] == ""


def found_terms(spark, rows):
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    return {r["doc_id"]: [text[r["doc_id"]][x["s"] : x["e"]] for x in r["_spans"] if pii.KINDS[x["k"]] == "term"] for r in got}


def test_disclosing_terms_of_a_class(spark):
    rows = [(k, f"note{chr(97 + k)} from agent zanzibar at u{k}@acme.example.org about case {chr(97 + k)}item") for k in range(8)]
    rows += [(10 + k, f"note from agent nobody about the case and number {k}") for k in range(400)]
    got = found_terms(spark, rows)
    assert all(got[k] == ["zanzibar"] for k in range(8)) and not any(got[10 + k] for k in range(400))


def test_disclosing_terms_in_whole_texts(spark):
    far = " ".join(f"and then more of {w}" for w in ("this", "that", "such", "those"))
    rows = [(k, f"zanzibar {far} from x@y.com {far} Zanzibar {'abcde'[k] * 4}") for k in range(5)]
    rows += [(9, f"{far} only zanzibar here")] + [(10 + k, f"{far} from number {k}") for k in range(200)]
    got = found_terms(spark, rows)
    assert all(got[k] == ["zanzibar", "Zanzibar"] for k in range(5)) and got[9] == ["zanzibar"]
    assert not any(got[10 + k] for k in range(200))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[9] == f"{far} only [TERM] here" and clean[0].count("[TERM]") == 2


def test_disclosing_terms_among_copies(spark):
    rows = [(k, f"{'abcd'[k] * 4} agent zanzibar at x@y.com") for k in range(4)]
    rows += [(10 + k, rows[0][1]) for k in range(2000)] + [(5000 + k, f"agent {'efghij'[k % 6] * (3 + k // 6)}") for k in range(120)]
    got = found_terms(spark, rows)
    assert all(got[k] == ["zanzibar"] for k in (*range(4), 10, 2009)) and not any(got[5000 + k] for k in range(120))


def test_disclosing_terms_of_odd_letters(spark, monkeypatch):
    monkeypatch.setattr(pii, "IN_MEMORY", 0, raising=False)  # no size of the corpus changes what a word is
    rows = [(k, f"agent zanzi²bar at x@y.com {'abcde'[k] * 4}") for k in range(5)] + [(10 + k, f"agent number {k}") for k in range(100)]
    got = found_terms(spark, rows)
    assert all(got[k] == ["zanzi²bar"] for k in range(5)) and not any(got[10 + k] for k in range(100))


def slow_base(text):
    """Base spans by plain scans: patterns tried from each place, checks by arithmetic."""
    found, digits = [], lambda x: [int(c) for c in x if c in "0123456789"]
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        at, tried = 0, re.compile(pattern)
        while at < len(text):
            m = tried.match(text, at)
            if not m:
                at += 1
                continue
            d, at = digits(m[0]), m.end()
            luhn = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
            if kind == "email" or (kind == "ip" and max(map(int, m[0].split("."))) <= 255) or (kind == "card" and 12 <= len(d) <= 19 and luhn % 10 == 0) or (kind == "phone" and 9 <= len(d) <= 15):
                found.append((m.start(), ["email", "ip", "card", "phone"].index(kind), m.end(), kind))
    return sorted(found)


def test_base_spans_of_odd_runs():
    """Against the patterns themselves, on texts of few characters; and in linear time on long runs."""
    import time

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(8)
    for _ in range(4000):
        text = "".join(rng.choice(list("a@..-1 é"), rng.integers(1, 24)))
        got = [(k, s, e) for s, k, e in pii.base_spans(text)]
        assert [x[1:] for x in got if x[0] == "email"] == [m.span() for m in email.finditer(text)]
        assert [x[1:] for x in got if x[0] == "ip"] == [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for text in ("a" * 10**6 + " @", "a" * 10**6 + "@b", "1" * 10**6, "1." * 500_000 + "x", "a@" * 500_000, "@" * 10**6, "a@" + "b" * 10**6):
        began = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - began < 2


def test_base_spans_against_plain_scans(spark):
    rng = np.random.default_rng(0)
    bits = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111 11111111", "5500 0000 0000 0004 1", "+49 (30) 123-4567", "+1", " ", ".", "-", "é", "日本", "12", "\n", "note", "٣٤"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(rows).collect():
        want = slow_base(texts[r["doc_id"]])
        digest = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[3] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("term")) == digest


def slow_terms(texts, support=pii.SUPPORT, disclosure=pii.DISCLOSURE):
    """Disclosing terms from sets of different texts."""
    texts = sorted({t for t in texts if t is not None} | ({""} if None in texts else set()))
    holds, levels = {}, {}
    for n, t in enumerate(texts):
        spans = slow_base(t)
        for m in re.finditer(r"[^\W\d_]{3,}", t):
            if not any(a < m.end() and m.start() < b for a, _, b, _ in spans):
                holds.setdefault(m[0].lower(), set()).add(n)
        for a, _, b, kind in spans:
            for key, own in pii._levels(kind, t[a:b]):
                levels.setdefault((key, own), set()).add(n)
    out, total = set(), len(texts)
    for (_, own), at in levels.items():
        if not support <= len(at) < total:
            continue
        p = len(at) / total
        for term, where in holds.items():
            both, weight = len(at & where), 0 if own else support
            if both >= support and np.log2((both + weight * p) / (len(where) + weight) / p) >= disclosure * -np.log2(p) - 1e-12:
                out.add(term)
    return out


@pytest.mark.parametrize("sent", [pii.SENT_TERMS, 0])
def test_disclosing_terms_against_sets(spark, sent):
    """Copies, terms with and without their entity, classes of entities; sent to all tasks or joined."""
    rng = np.random.default_rng(1)
    common, secret = [f"word{chr(97 + k)}" for k in range(20)], [f"secret{chr(97 + k)}" for k in range(12)]
    rows = []
    for k in range(900):
        text = " ".join(rng.choice(common, 12))
        if k % 9 == 0:
            who = rng.integers(0, 12)
            text = f"{secret[who].title() if k % 2 else secret[who]} {text} u{who if k % 18 else k}@{'host' + chr(97 + who)}.org"
        elif k % 31 == 0:
            text += " " + secret[rng.integers(0, 12)]
        rows.append((k, text, f"note{k}"))
    rows += [(1000 + k, rows[0][1], "copy") for k in range(500)] + [(None, rows[9][1], "x"), (2000, None, "x"), (2001, "", "x"), (2000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    flagged = slow_terms([t for _, t, _ in rows])
    assert len(flagged) > 4
    assert {r[0] for r in pii.disclosing_terms(docs).collect()} == flagged
    got = pii.find_personal_data(docs, sent=sent).collect()
    assert len(got) == len(rows)
    text = {}
    for k, t, _ in rows:
        text.setdefault(k, t or "")
    for r in got:
        t = text[r["doc_id"]]
        base = [(a, b) for a, _, b, _ in slow_base(t)]
        want = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in flagged and not any(a < m.end() and m.start() < b for a, b in base)]
        assert [(x["s"], x["e"]) for x in r["_spans"] if pii.KINDS[x["k"]] == "term"] == want
    clean = pii.sanitise(docs, sent=sent)
    assert clean.columns == docs.columns and clean.where("spans = 'copy'").count() == 500
    assert all(not flagged.intersection(re.findall(r"[^\W\d_]{3,}", (r["text"] or "").lower())) and "@" not in (r["text"] or "") for r in clean.collect())
    with pytest.raises(ValueError):
        pii.find_personal_data(docs, keep=("spans",))


def test_mixing(docs, nothing, spark):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, ((r["doc_id"] or -1, r["taken"]) for r in got))) == sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(nothing).count() == 0
    rows = [(k, "w " * (1 + k % 7), f"s{k % 3}") for k in range(3000)]
    per = {}
    for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        n = per.setdefault(r["pattern"][0], [0, r["target"]])
        n[0] += r["taken"]
    assert all(abs(a - t) <= 8 for a, t in per.values())


def test_mixing_fills_rare_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(k, "w " * (1 + k * k * 37 % 199), "rare" if k % 50 == 0 else f"s{k % 3}") for k in range(6000)]
    per = {}
    for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=lambda names: [2.0 if s == "rare" else 50.0 for s in names]).collect():
        n = per.setdefault(r["pattern"][0], [0, r["target"]])
        n[0] += r["taken"]
    assert all(abs(a - t) <= 2 for a, t in per.values()), per


def slow_targets(sizes, weights, times):
    """Targets by raising the level of all open sources until each is full or the total is given."""
    from fractions import Fraction

    total, target, open_ = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), {k for k, n in enumerate(sizes) if n}
    while open_ and total:
        whole = sum(weights[k] for k in open_)
        step = min([total / whole] + [(times * sizes[k] - target[k]) / Fraction(weights[k]) for k in open_])
        for k in open_:
            target[k] += step * weights[k]
        total -= step * whole
        open_ = {k for k in open_ if target[k] < times * sizes[k]}
    return [float(x) for x in target]


def test_mixing_against_brute_force(spark):
    """Every column of every document, from plain counts and targets by another way."""
    rng = np.random.default_rng(7)
    sources = ["b", "ä", "a", None, "z", "tiny"]
    rows = [(int(k) if k % 50 else None, None if k % 97 == 0 else " ".join(["w"] * int(rng.integers(0, 40))) + "\x1f\t", sources[min(5, int(rng.exponential(1.2)))] if k % 400 else "tiny", "kept") for k in range(3000)]
    rows += [rows[5]] * 40 + [(9000, "one", "alone", "kept"), (9001, "", "empty", "kept"), (9002, None, "nothing", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string").repartition(5)
    got = [r.asDict() for r in mixing.mix_sources(docs, keep=("note",)).collect()]
    sizes = Counter()
    plain = Counter()
    for i, t, s, _ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        plain[(i, n, s)] += 1
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, slow_targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3)))
    assert Counter((r["doc_id"], r["size"], r["pattern"][0]) for r in got) == plain
    taken = Counter()
    for r in got:
        s = r["pattern"][0]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s], abs=1e-6) and r["note"] == "kept"
        assert r["taken"] == r["times_taken"] * r["size"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 8 for s in names), (taken, target)
    key = lambda rs: sorted(str((r["doc_id"], r["size"], r["pattern"], r["taken"])) for r in rs)
    assert key(got) == key([r.asDict() for r in mixing.mix_sources(docs.repartition(3)).collect()])
    with pytest.raises(ValueError):
        mixing.mix_sources(docs.withColumn("draw", F.lit(1)), keep=("draw",))


def test_mixing_splits_repeated_rows(spark, monkeypatch):
    """A row that fills a hash bucket by itself is taken part by part."""
    monkeypatch.setattr(mixing, "SPLIT_ROWS", 100)
    monkeypatch.setattr(mixing, "LEAST_ROWS", 40)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    rows = [(1, "w w w", "a")] * 2000 + [(k, "w " * (1 + k % 5), "a" if k % 2 else "b") for k in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    per = {}
    got = mixing.mix_sources(docs).collect()
    for r in got:
        n = per.setdefault(r["pattern"][0], [0, r["target"]])
        n[0] += r["taken"]
    assert len(got) == len(rows) and all(abs(a - t) <= 5 for a, t in per.values()), per
    assert {r["times_taken"] for r in got if r["doc_id"] == 1} <= {0, 1, 2, 3}


def slow_route(capacity, quota, times):
    """Most words and least cost by shortest paths, one at a time."""
    edges = []  # from, to, capacity, cost

    def join(a, b, cap, cost):
        edges.append([a, b, cap, cost])
        edges.append([b, a, 0, -cost])

    for m, n in capacity.items():
        for t in range(times):
            join("in", ("p", m, t), n, t)
            for s in m:
                join(("p", m, t), ("s", s), n, 0)
    for s, q in quota.items():
        join(("s", s), "out", q, 0)
    words = cost = 0
    while True:
        dist, back = {"in": 0}, {}
        for _ in range(len(edges)):
            before = dict(dist)
            for k, (a, b, cap, c) in enumerate(edges):
                if cap and a in dist and dist[a] + c < dist.get(b, 10**9):
                    dist[b], back[b] = dist[a] + c, k
            if before == dist:
                break
        if "out" not in dist:
            return words, cost
        path, v = [], "out"
        while v != "in":
            path.append(back[v])
            v = edges[back[v]][0]
        n = min(edges[k][2] for k in path)
        for k in path:
            edges[k][2] -= n
            edges[k ^ 1][2] += n
        words, cost = words + n, cost + n * dist["out"]


def test_route_against_shortest_paths():
    rng = np.random.default_rng(3)
    for _ in range(60):
        names = "abcde"[: rng.integers(1, 6)]
        capacity = {}
        for _ in range(rng.integers(1, 9)):
            capacity[tuple(sorted(rng.choice(list(names), rng.integers(1, len(names) + 1), replace=False)))] = int(rng.integers(0, 12))
        quota = {s: int(rng.integers(0, 40)) for s in {s for m in capacity for s in m}}
        given = mixing.route(capacity, quota, 3)
        assert all(0 <= given[m] <= 3 * n for m, n in capacity.items())
        cost = sum(max(0, min(given[m] - t * n, n)) * t for m, n in capacity.items() for t in range(3))
        assert (sum(given.values()), cost) == slow_route(capacity, quota, 3), (capacity, quota)


def test_route_of_many_patterns():
    import time

    rng = np.random.default_rng(0)
    capacity = {tuple(sorted({*rng.integers(0, 300, rng.integers(1, 5)).tolist()})): int(rng.integers(1, 10_000)) for _ in range(100_000)}
    size = Counter()
    for m, n in capacity.items():
        for s in m:
            size[s] += n
    total = sum(capacity.values())
    weights = rng.exponential(1, 300)
    quota = {s: int(total * w / weights.sum()) for s, w in enumerate(weights)}
    began = time.perf_counter()
    given = mixing.route(capacity, quota, 3)
    assert time.perf_counter() - began < 60
    assert sum(given.values()) > 0.99 * sum(min(quota[s], 3 * size[s]) for s in quota)


def test_rare_patterns_count_for_one_source(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, "w " * (1 + k % 4), sorted({*rng.choice(list("abcde"), rng.integers(1, 4)).tolist()})) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    exact, usual = (sorted(tuple(map(str, r)) for r in mixing.mix_sources(docs, most_patterns=m).collect()) for m in (None, 200_000))
    assert exact == usual and len({r[1] for r in exact}) > 11
    got = mixing.mix_sources(docs, most_patterns=6).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(500)) and len({tuple(r["pattern"]) for r in got}) <= 6 + 5
    assert all(set(r["pattern"]) <= set(rows[r["doc_id"]][2]) for r in got)


def test_shares_and_flow():
    assert mixing.shares([100, 100, 100], [5, 2, 1], 300, 3) == pytest.approx([187.5, 75, 37.5])
    assert mixing.shares([10, 1000], [5, 2], 1010, 3) == pytest.approx([30, 980])
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 25, "b": 20}, 3)
    assert sum(flow.values()) == 45 and max(flow.values()) <= 20  # repetition spreads before a third use
    many = mixing.route({("a", "b"): 5}, {"a": 4, "b": 20}, 3)
    assert many == {("a", "b"): 15}


def test_overlapping_sources(spark):
    rows = [(k, "w w", ["a", "b"] if k % 2 else ["a"]) for k in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"))
    assert {tuple(r["pattern"]) for r in got.collect()} == {("a",), ("a", "b")}


def test_licenses(spark, nothing):
    mit = licenses.TEMPLATES["mit-opening"]
    edited = mit.replace("charge", "cost")
    rows = [(0, "intro words here. Released under the MIT License. more"), (1, None), (2, "x " * 400 + mit + " y" * 37), (3, edited), (4, "words about the License and nothing else at all"), (5, "Released under the MIT"), (6, f"{LONG} {licenses.TEMPLATES['bsd']} {LONG}")]
    rows += [(7, ""), (None, "# SPDX-License-Identifier: MIT"), (0, "SPDX-License-Identifier: ISC"), (8, licenses.TEMPLATES["bsd-3-clause"]), (9, "public domain, CC0 1.0."), (10, "public domain CC0")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, spans string, n_matches string")
    got = [(r["doc_id"], r["licenses"]) for r in licenses.scan_licenses(docs).collect()]
    want = [(0, "mit-notice"), (1, ""), (2, "mit-opening"), (3, "mit-opening"), (4, ""), (5, ""), (6, "bsd"), (7, ""), (None, "spdx-mit"), (0, "spdx-isc"), (8, "bsd,bsd-2-clause,bsd-3-clause"), (9, "cc0-1.0-notice"), (10, "")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert licenses.scan_licenses(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.Library({"none": " "})
    assert len(licenses.Library({"cc0": "Public domain CC0 1.0", "mit": "MIT License"}).short) == 2


def test_licenses_against_brute_force():
    """Containment of every template in every window, on edited copies among other words."""
    library = licenses.Library(licenses.TEMPLATES)
    rng = np.random.default_rng(0)
    other = [f"other{k}" for k in range(300)]
    docs, places = [], 0
    for n in range(160):
        words = list(rng.choice(other, rng.integers(0, 400)))
        for _ in range(rng.integers(0, 3)):
            t = library.templates[rng.integers(0, len(library.templates))]
            text = licenses.TEMPLATES[t.name].split()
            for _ in range(rng.integers(0, 1 + len(text) // 40)):
                kind, at = rng.integers(0, 3), int(rng.integers(0, len(text)))
                text[at : at + 1] = [[], ["changed"], [text[at], "more"]][kind]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = text
        docs.append(licenses.word_hashes(words))
    met = missed = 0
    for doc, got in zip(docs, library.scan(docs)):
        assert all(0 <= s < e <= len(doc) for _, s, e in got)
        shingles = licenses.shingle_hashes(doc)
        for t in library.templates:
            here = [(s, e) for n, s, e in got if n == t.name]
            for s, e in here:  # what is found is there
                near_ = shingles[max(0, s - 2 * t.span) : e + 2 * t.span]
                assert np.isin(t.shingles, near_).mean() >= licenses.CONTAINED
            starts = range(max(1, len(shingles) - t.span + 1)) if np.isin(t.shingles, shingles).mean() >= licenses.CONTAINED else ()
            if any(np.isin(t.shingles, shingles[i : i + t.span]).mean() >= licenses.CONTAINED for i in starts):
                met, missed = met + 1, missed + (not here)
    assert met > 100 and missed == 0


@pytest.mark.parametrize("list_rows", [64, 8])
def test_near_vectors(spark, monkeypatch, list_rows):
    monkeypatch.setattr(near, "LIST_ROWS", list_rows)
    monkeypatch.setattr(near, "BLOCK_ROWS", 8192 if list_rows == 64 else 50)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 16))
    x[200:300] = x[rng.integers(0, 20, 100)] + rng.normal(0, 0.12, (100, 16))
    x[300:310] = x[5]
    x = x.astype("f4")
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 0.0]), (907, [1.0, 0.0]), (None, rows[5][1])]
    u = x.astype("f8")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = np.nonzero(u @ u.T >= 0.9)
    labels = np.arange(400)
    min_labels(labels, i, j)
    n = np.bincount(i, minlength=400) - 1
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = embedding_dedup.near_vectors(df).collect()
    assert len(got) == 409
    for r in got:
        k = r["vec_id"]
        want = (n[k], labels[k]) if k is not None and k < 400 else (1, 906) if k in (906, 907) else (0, k)
        assert (r["n_links"], r["component_id"], r["kept"]) == (*want, k is not None and k == want[1])
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_recall_of_near_vectors():
    """Against brute force, with the default share of the margin and with the whole of it."""
    rng = np.random.default_rng(2)
    for dim in (12, 64):
        x = rng.normal(0, 1, (4000, dim))
        x[2000:] = x[rng.integers(0, 2000, 2000)] + rng.normal(0, 0.4, (2000, dim))
        x = near.unit_rows(x)
        i, j = np.nonzero((x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool))
        for share in (None, 1.0):
            index = near.Index(x, len(x), 0.9, share=share)
            own, probes = index.place(x)
            codes, off = index.encode(x, own)
            met = probes[i, own[j]] | probes[j, own[i]]
            assert len(i) > 500 and (met.all() if share else met.mean() >= 0.99)
            assert all(index.near(x[a : a + 1], int(own[b]), codes[b : b + 1], off[b : b + 1])[0, 0] for a, b in zip(i[:500], j[:500]))
            if dim == 64 and share is None:
                assert probes.mean() < 0.4


def test_quality_model(spark, nothing):
    rng = np.random.default_rng(0)
    good = lambda: " ".join(rng.choice(["river", "stone", "green", "walk", "under", "light", "the", "of"], 60))
    bad = lambda: " ".join(w + "$$$" for w in rng.choice(["river", "stone", "CLICK", "BUY"], 60))
    rows = [(k, good() if k % 2 else bad()) for k in range(600)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)] + [(1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_model.score_quality(docs, labels).collect()}
    held = [k for k in range(600) if got[k]["held_out"]]
    assert held == [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k]["predicted"] == k % 2 for k in held]) > 0.95 and 0 <= got[1000]["score"] <= 1 and got[1000]["score"] == got[1001]["score"]
    assert quality_model.score_quality(docs.limit(5), labels.limit(0)).first()["score"] == 0.5
    assert quality_model.score_quality(nothing, labels.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, " ".join(f"w{(k * 31 + i * i) % 997}" for i in range(40)) + f" reach me at u{k}@site.org", "en", f"s{k % 3}", 0) for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "s0", 0) for k in range(5)] + [(200, "too short", "en", None, 0), (201, None, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert not ids & {200, 201} and (name == "quality rules" or not ids & {100, 101, 102, 103, 104})
    assert docs.where(F.col("text").contains("@")).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == ids


def test_pipeline_keeps_clashing_columns(spark, tmp_path, docs):
    import corpus_pipeline

    own = "kept rejected_by component_id n_email spans _spans _row _id _text _near h times times_taken copy size pattern fp rep key bucket start".split()
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in own)).cache()
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in out.collect() for c in own)
    assert corpus_pipeline.packing(spark, rows, str(tmp_path)).count() >= rows.count()


def test_pipeline_keeps_one_of_each_group_of_rows(spark):
    import corpus_pipeline

    other = " ".join(f"unlike{k} thing{k * 7}" for k in range(60))
    rows = [(1, BASE), (1, BASE), (2, BASE), (None, BASE), (None, other), (None, other), (3, "x " + other[::-1]), (3, LONG)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert got == sorted([(1, BASE), (0, other), (3, "x " + other[::-1]), (3, LONG)])


def test_pipeline_mixes_rows_as_planned(spark):
    import corpus_pipeline

    rows = [(k // 4, f"word{k // 4} " * 5, f"s{k % 3}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.mix_sources(docs).agg(F.sum("times_taken")).first()[0]
    assert corpus_pipeline.mixture(spark, docs, "").count() == planned
