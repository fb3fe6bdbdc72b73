"""Personal data, and the terms that disclose it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_rows, positional
from tidewheel.session import materialize, small_batches

#: Kinds in the order that ties are listed in; the method's own spans come last.
KINDS = ("email", "ip", "card", "phone", "term")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Only the first digit of a run can begin a match, so no run is tried from each of its places.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
#: Columns that the operator makes itself.
_OWN = frozenset("doc_id _id _text base_sha256 spans _spans".split()) | {f"n_{k}" for k in KINDS}
#: A term is judged if it comes in so many different texts with an entity.
SUPPORT = 3
#: Share of an entity's information that a term may disclose.
DISCLOSURE = 0.9
#: Different terms whose counts a task holds before it passes them on.
AT_A_TIME = 100_000
#: Disclosing terms that are sent to all tasks at most; more are joined to the documents that may hold them.
SENT_TERMS = 200_000
#: Bits of the filter that tells which documents may hold one of more terms: 16 MB whatever their number.
FILTER_BITS = 1 << 27


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Start and end of the matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in time linear in the text.

    No run of local characters holds an "@", so each "@" is looked at once, with the run
    before it and the domain behind it.
    """
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        else:
            # what lies before this sign belongs to no later match
            free = at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """Start, kind and end of all base matches, in order."""
    found = []
    if "@" in text:
        found += [(s, "email", e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), "card", m.end()))
        if "+" in text:
            found += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[0], _ORDER[x[1]], x[2]))


def _levels(kind: str, value: str) -> list[tuple[int, bool]]:
    """Hashes of an entity's value (true) and of the classes that it is in (false)."""
    plain = value.lower() if kind in ("email", "ip") else "".join(c for c in value if c in "0123456789")
    if kind == "email":
        host = plain.split("@")[1].split(".")
        classes = {".".join(host), ".".join(host[-2:])}
    elif kind == "ip":
        parts = plain.split(".")
        classes = {".".join(parts[:k]) + "." for k in (1, 2, 3)}
    else:
        classes = {plain[:6], plain[:1]} if kind == "card" else {plain[:-4], plain[:-7]}
    hashed = lambda x: xxhash.xxh64_intdigest(x.encode()) >> 1
    return [(hashed(f"{kind}:{plain}"), True), *((hashed(f"class {kind}:{c}"), False) for c in sorted(classes))]


def words(text: str, spans: list[tuple[int, str, int]]) -> Iterator[tuple[int, int, str]]:
    """Place and lower case of each term that touches no span; the spans are in order."""
    k, until, n = 0, 0, len(spans)
    for m in _TERM.finditer(text):
        while k < n and spans[k][0] < m.end():
            until, k = max(until, spans[k][2]), k + 1
        if m.start() >= until:
            yield m.start(), m.end(), m[0].lower()


def terms(text: str, spans: list[tuple[int, str, int]]) -> set[str]:
    return {w for *_, w in words(text, spans)} if spans else {w.lower() for w in set(_TERM.findall(text))}


def _with_entities(texts: DataFrame) -> DataFrame:
    """Each different text that has entities: their levels and its terms."""

    def run(rows):
        out = {"_h": [], "_levels": [], "_terms": []}
        for h, t in zip(rows.column("_h").to_pylist(), rows.column("_text").to_pylist(), strict=True):
            if t and (spans := base_spans(t)):
                out["_h"].append(h)
                out["_levels"].append([{"ent": x, "own": own} for x, own in sorted({x for s, k, e in spans for x in _levels(k, t[s:e])})])
                out["_terms"].append(sorted(terms(t, spans)))
        return out

    return materialize(map_rows(texts, run, "_h long, _levels array<struct<ent:long,own:boolean>>, _terms array<string>").dropDuplicates(["_h"]), "entities")


def _term_counts(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """In how many different texts each term comes outside of spans: ``term, n``."""

    def count(batches):
        found: dict[str, float] = {}

        def out():
            return pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.float64())})

        for batch in batches:
            for k in range(batch.num_rows):
                text, share = batch.column(0)[k].as_py() or "", 1 / (batch.column(1)[k].as_py() or 1)
                for w in terms(text, base_spans(text)):
                    found[w] = found.get(w, 0) + share
                if len(found) > AT_A_TIME:
                    yield out()
                    found.clear()
        yield out()

    small_batches(texts.sparkSession)
    # each of m copies counts as 1/m
    shared = texts.join(copies, "_h", "left").select("_text", "m")
    return shared.mapInArrow(count, "term string, n double").groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n"))


def disclosing_terms(docs: DataFrame, text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """A table of the terms, ``term``, above the threshold for an entity or a class of entities."""
    texts = docs.select(F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_h"))
    near = _with_entities(texts)
    copies = materialize(texts.groupBy("_h").agg(F.count("*").alias("m")).where("m > 1"), "copies")
    total = docs.count() - (copies.agg(F.sum(F.col("m") - 1)).first()[0] or 0)
    prior, weight = F.col("n_ent") / F.lit(total), F.when(F.col("own"), 0).otherwise(support)
    # a term in more texts than ``most`` is below the threshold even if all texts of the level have it
    most = (F.col("n_ent") + weight * prior) / F.pow(prior, F.lit(1 - disclosure)) - weight
    at = near.select("_h", F.explode("_levels").alias("x")).select("_h", "x.ent", "x.own")
    judged = at.groupBy("ent", "own").agg(F.count("*").alias("n_ent")).where((F.col("n_ent") >= support) & (F.col("n_ent") < total))
    judged = materialize(judged.withColumn("prior", prior).withColumn("weight", weight).withColumn("most", most + 1e-6), "levels")
    widest = judged.agg(F.max("most")).first()[0]
    if widest is None:
        return docs.sparkSession.createDataFrame([], "term string")
    counts = _term_counts(texts, copies).where(F.col("n").between(support, widest))
    pairs = near.select("_h", F.explode("_terms").alias("term")).join(counts, "term").join(at.join(judged, ["ent", "own"]), "_h").where("n <= most")
    both = pairs.groupBy("ent", "own", "term").agg(F.count("*").alias("n_both"), *(F.first(c).alias(c) for c in ("n", "prior", "weight"))).where(F.col("n_both") >= support)
    told = F.log2((F.col("n_both") + F.col("weight") * F.col("prior")) / (F.col("n") + F.col("weight")) / F.col("prior"))
    return materialize(both.where(told >= disclosure * -F.log2("prior")).select("term").distinct(), "disclosing")


def _filter_of(flagged: DataFrame) -> np.ndarray:
    """A bit for each hash of a term, as bytes; of fixed size."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS)) + 1
    found = flagged.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((FILTER_BITS // 32768, 4096), "u1")
    for k, bits in found.collect():  # FILTER_BITS / 32768 rows of 4096 bytes at most
        out[k - 1] = np.frombuffer(bits, "u1")
    return out.reshape(-1)


def _with_terms(rows: DataFrame, text: str, flagged: DataFrame, at_most: int) -> tuple[DataFrame, frozenset[str] | None]:
    """The rows with what is needed to find the flagged terms in them: the terms themselves, or the column ``_mine``.

    Up to ``at_most`` terms go to all tasks. More stay where they are: a filter of fixed
    size goes instead, the documents' words that pass it are joined to the terms, and
    each row gets those that it holds.
    """
    n = flagged.count()
    if n <= at_most:
        return rows.withColumn("_mine", F.lit(None).cast("array<string>")), frozenset(r[0] for r in flagged.collect())
    bits = rows.sparkSession.sparkContext.broadcast(_filter_of(flagged))
    rows = materialize(rows.withColumn("_n", F.monotonically_increasing_id()), "numbered")

    def may_hold(batch):
        out = {"_n": [], "term": []}
        for k, x in zip(batch.column("_n").to_pylist(), batch.column(text).to_pylist(), strict=True):
            words_ = sorted(terms(x or "", base_spans(x or "")))
            at = np.fromiter((xxhash.xxh64_intdigest(w.encode(), 42) for w in words_), "u8", len(words_)) & np.uint64(FILTER_BITS - 1)
            hit = np.flatnonzero(bits.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1") & 1)
            out["_n"] += [k] * len(hit)
            out["term"] += [words_[i] for i in hit]
        return out

    met = map_rows(rows.select("_n", text), may_hold, "_n long, term string").join(flagged, "term")
    return rows.join(met.groupBy("_n").agg(F.collect_list("term").alias("_mine")), "_n", "left").drop("_n"), None

def _spans_of(text: str, flagged: frozenset[str] | set[str]) -> tuple[list, list]:
    """The base spans of a text, and all its spans."""
    base = base_spans(text)
    if not flagged or flagged.isdisjoint(terms(text, base)):
        return base, base
    return base, sorted(base + [(a, "term", b) for a, b, w in words(text, base) if w in flagged], key=lambda y: (y[0], _ORDER[y[1]], y[2]))


def _pass(docs: DataFrame, text: str, columns: tuple[str, ...], made: str, make, support: int, disclosure: float, sent: int) -> DataFrame:
    """One pass over whole texts; ``make(rows, texts, found)`` gives the columns, ``found`` has both lists of spans of each."""
    rows, flagged = _with_terms(docs, text, disclosing_terms(docs, text, support, disclosure), sent)
    shared = docs.sparkSession.sparkContext.broadcast(flagged)  # SENT_TERMS at most
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batch):
        texts = [x or "" for x in batch.column(text).to_pylist()]
        mine = [shared.value] * len(texts) if shared.value is not None else [set(x or ()) for x in batch.column("_mine").to_pylist()]
        found = [_spans_of(x, m) for x, m in zip(texts, mine, strict=True)]
        return {c: batch.column(c) for c in columns} | make(batch, texts, found)

    return map_rows(rows, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), made]))


def find_personal_data(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), support: int = SUPPORT, disclosure: float = DISCLOSURE, sent: int = SENT_TERMS) -> DataFrame:
    """Personal data in every whole text.

    Base kinds are patterns with checks (``KINDS``). To these come terms that disclose
    an entity: with entity e in n(e) of N different texts, term t in n(t) and both in n(t, e),
    t discloses log2(p(e | t) / p(e)) bits of the entity's -log2 p(e). Whole different texts
    count, without their spans. A term is flagged if it discloses ``disclosure`` of an
    entity and comes in ``support`` different texts with it; each of its occurrences in any text,
    with or without the entity, is a span.

    Most entities come in one text only, which tells nothing of their value. So terms
    are judged against classes too: an address's domain and the domain above it, a
    network of one, two or three numbers, a card's issuer and first digit, a phone number
    without its last four or seven digits. The kind itself is no secret, as it stands in
    the place of the span. p(class | t) is smoothed by ``support`` different texts of the class's
    share, so that a common class needs more of them.

    Texts may be null or empty (no span) or very long; ids null or repeated: each row gives
    one, and equal texts get equal spans. An empty table gives no row. Returns ``keep``,
    ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, _spans`` (the spans as an
    array, kinds as positions in ``KINDS``). A column of ``keep`` named as one of the
    operator's own is an error; ``sanitise`` takes columns of any name.
    """
    if clash := _OWN.intersection(keep):
        raise ValueError(f"the operator has columns of its own named {sorted(clash)}")
    source = docs.select(*keep, F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))

    def make(batch, texts, found):
        out = {"doc_id": batch.column("_id")} | {f"n_{k}": [sum(x[1] == k for x in s) for s, _ in found] for k in KINDS[:4]}
        out["base_sha256"] = [hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in s).encode()).hexdigest() for s, _ in found]
        out["spans"] = [",".join(f"{k}:{a}:{b}" for a, k, b in s) for _, s in found]
        out["_spans"] = [[{"s": a, "k": _ORDER[k], "e": b} for a, k, b in s] for _, s in found]
        return out

    made = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, _spans array<struct<s:int,k:int,e:int>>"
    return _pass(source, "_text", keep, made, make, support, disclosure, sent)


def replace_spans(text: str | None, spans: list[tuple[int, str, int]]) -> str | None:
    """The text with each span generalised to its kind; overlapping spans are one, named by the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, kind, end in sorted(spans, key=lambda x: (x[0], -x[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", id_col: str = "doc_id", support: int = SUPPORT, disclosure: float = DISCLOSURE, sent: int = SENT_TERMS) -> DataFrame:
    """The same rows and columns with personal data and disclosing terms generalised to their kinds.

    Columns may have any names. A null text stays null and an empty one empty; rows that
    repeat are each kept; ids play no part and may be null.
    """
    plain, name, back = positional(docs)
    body = name(text)
    others = tuple(c for c in plain.columns if c != body)

    def make(batch, texts, found):
        whole = batch.column(body).to_pylist()
        return {body: [replace_spans(t, s) for t, (_, s) in zip(whole, found, strict=True)]}

    return back(_pass(plain, body, others, f"`{body}` string", make, support, disclosure, sent))
