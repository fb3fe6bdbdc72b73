"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import map_rows, positional

_CAPITALS = bytes(range(65, 91))
WINDOW = 8


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window of words that occurs twice or more in the sequence."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, "u8")
    wide = ids.astype("u8")
    with np.errstate(over="ignore"):
        for k in range(window):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + n] + np.uint64(1)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, window)
    a, b = order[:-1][same], order[1:][same]
    if (windows[a] == windows[b]).all():
        starts = np.concatenate([a, b])
    else:  # two windows share a mixed value: count the windows themselves
        seen = Counter(map(tuple, windows.tolist()))
        starts = np.array([i for i, w in enumerate(map(tuple, windows.tolist())) if seen[w] > 1])
    edge = np.zeros(len(ids) + 1, "i4")
    np.add.at(edge, np.unique(starts), 1)
    np.add.at(edge, np.unique(starts) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


class Text:
    """A document's features, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @functools.cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @functools.cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @functools.cached_property
    def n_words(self) -> int:
        return len(self.words)

    @functools.cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @functools.cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))

    @functools.cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @functools.cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @functools.cached_property
    def ids(self) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.fromiter((known.setdefault(w, len(known)) for w in self.words), "i8", self.n_words)

    @functools.cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.ids)

    @functools.cached_property
    def n_capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _CAPITALS))

    @functools.cached_property
    def most_common(self) -> int:
        """How often the most frequent word comes."""
        return int(np.bincount(self.ids).max()) if self.n_words else 0


#: What each feature needs, and its work in nanoseconds, as measured on a common machine: for each byte, word and line.
#: Only their proportions matter, and they are fixed, so equal samples give equal plans.
FEATURES = {
    "raw": ((), (0.1, 0, 0)),
    "words": (("raw",), (0.5, 40, 0)),
    "n_words": (("words",), (0, 0, 0)),
    "word_chars": ((), (1.5, 0, 0)),
    "n_symbols": (("raw",), (1.0, 0, 0)),
    "lines": (("raw",), (0.5, 0, 120)),
    "n_dup_lines": (("lines",), (0, 0, 80)),
    "ids": (("words",), (0, 90, 0)),
    "n_repeat_words": (("ids",), (0, 150, 0)),
    "n_capitals": (("raw",), (0.8, 0, 0)),
    "most_common": (("ids",), (0, 3, 0)),
}


def needed(features: Iterable[str]) -> frozenset[str]:
    """Features with all that they are made from."""
    out: set[str] = set()
    for f in features:
        out |= {f} | needed(FEATURES[f][0])
    return frozenset(out)


@dataclass(frozen=True)
class Rule:
    name: str
    reads: tuple[str, ...]
    rejects: Callable[[Text], bool]


#: Base rules, then those that the cascade adds. Each is a comparison of whole numbers.
BASE_RULES = (
    Rule("too_few_words", ("n_words",), lambda t: t.n_words < 20),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
ADDED_RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda t: 100 * t.n_symbols > 15 * t.n_words),
    Rule("word_length", ("word_chars", "n_words"), lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 20 * t.n_words),
    Rule("duplicate_lines", ("n_dup_lines",), lambda t: 100 * t.n_dup_lines > 40 * len(t.lines)),
    Rule("shouting", ("n_capitals", "word_chars"), lambda t: 100 * t.n_capitals > 40 * t.word_chars),
    Rule("one_word", ("most_common", "n_words"), lambda t: 100 * t.most_common > 30 * t.n_words),
)


def order_rules(rules: tuple[Rule, ...], sample: list[tuple[int, int, int, list[bool]]], known: frozenset[str] = frozenset()) -> list[dict]:
    """Greedy order by rejections for the work that a rule adds.

    ``sample`` has each text's bytes, words, lines and the rules that reject it. A rule is
    charged only for features that neither ``known`` nor an earlier rule has made, and
    both its work and its rejections are those of texts that earlier rules leave. Returns
    a row for each rule: ``rule, cost_ns`` (a text), ``selectivity`` (of the texts left).
    """
    rest, alive, plan = list(enumerate(rules)), list(sample), []
    while rest:
        n, (n_bytes, n_words, n_lines) = max(1, len(alive)), (sum(x[k] for x in alive) for k in range(3))

        def judged(x):
            work = [FEATURES[f][1] for f in needed(x[1].reads) - known]
            cost = sum(w[0] * n_bytes + w[1] * n_words + w[2] * n_lines for w in work) / n
            return cost, sum(t[3][x[0]] for t in alive) / n

        costs = {x[0]: judged(x) for x in rest}
        best = min(rest, key=lambda x: (-costs[x[0]][1] / (costs[x[0]][0] + 1.0), costs[x[0]][0], x[0]))
        plan.append({"rule": best[1], "cost_ns": costs[best[0]][0], "selectivity": costs[best[0]][1]})
        alive = [t for t in alive if not t[3][best[0]]]
        known |= needed(best[1].reads)
        rest.remove(best)
    return plan


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample: int = 400, known: frozenset[str] = frozenset()) -> list[dict]:
    """``order_rules`` on a sample of at most ``sample`` texts, drawn by a hash; their figures come to the driver, not the texts.

    The sample only decides the order in which rules run; a document's verdict, which is
    whether any rule rejects it, is the same in every order.
    """
    drawn = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0)

    def figures(rows):
        texts = [Text(x) for x in rows.column("text").to_pylist()]
        return {"b": [len(t.raw) for t in texts], "w": [t.n_words for t in texts], "l": [t.raw.count(b"\n") + 1 for t in texts], "hit": [[bool(r.rejects(t)) for r in rules] for t in texts]}

    # the limit stands last, so that only as many partitions are read as it takes
    few = map_rows(drawn, figures, "b long, w long, l long, hit array<boolean>").limit(sample).collect()
    return order_rules(rules, sorted(tuple(r) for r in few), known)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Judge each whole text by a cascade that stops at the first rule that rejects it.

    ``plan_cascade`` sets the order. A null or empty text has no word, so the base rules
    reject it. Returns ``id_col``, the columns ``keep``, ``kept`` and ``rejected_by``:
    which of several rules is named depends on the order, ``kept`` does not. One pass, no
    shuffle; ids may be null or repeated, every row gives one; an empty table gives none.
    A column named as one of these two is an error; ``without_rejected`` takes any.
    """
    columns = list(dict.fromkeys([id_col, *keep]))
    if clash := {"kept", "rejected_by"}.intersection(columns):
        raise ValueError(f"the operator has columns of its own named {sorted(clash)}")
    order = [x["rule"] for x in plan_cascade(docs, rules, text)]
    source = docs.select(*columns, *([] if text in columns else [text]))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def judge(rows):
        by = []
        for x in rows.column(text).to_pylist():
            t = Text(x)
            by.append(next((r.name for r in order if r.rejects(t)), None))
        return {c: rows.column(c) for c in columns} | {"kept": [x is None for x in by], "rejected_by": by}

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return map_rows(source, judge, f"{schema}, kept boolean, rejected_by string")


def without_rejected(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows, with all their columns whatever they are called, that no rule rejects."""
    plain, new, back = positional(docs)
    return back(quality_rules(plain, rules, new(text), new(id_col), tuple(plain.columns)).where("kept"))


#: The figures that a report has of every text, whatever the cascade asks for.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame) -> DataFrame:
    """The cascade's verdict beside the base figures of every document.

    The report's own figures are known before the cascade begins, so its plan charges
    rules only for the others. Null texts, ids and empty tables: as ``quality_rules``.
    """
    order = [x["rule"] for x in plan_cascade(docs, BASE_RULES + ADDED_RULES, known=needed(REPORTED))]

    def report(rows):
        texts = [Text(x) for x in rows.column("text").to_pylist()]
        out = {n: [getattr(t, n) for t in texts] for n in REPORTED}
        kept = [not any(r.rejects(t) for r in order) for t in texts]
        return {"doc_id": rows.column("doc_id"), **out, "base_failed": [any(r.rejects(t) for r in BASE_RULES) for t in texts], "kept": kept}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(source, report, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT r, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, range(0, 8) AS k(k) GROUP BY r),
m AS (SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(ws) AS x FROM w) GROUP BY r, x) GROUP BY r),
f AS (SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l.ls) - len(list_distinct(l.ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(l.ls) AS n_lines, length(regexp_replace(d.t, '[^A-Z]', '', 'g')) AS n_capitals, coalesce(m.n, 0) AS most
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN p USING (r) LEFT JOIN m USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 15 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_capitals > 40 * word_chars OR 100 * most > 30 * n_words) AS kept
FROM f
"""
