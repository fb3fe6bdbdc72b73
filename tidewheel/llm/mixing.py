"""Mixing sources to target weights by a minimum-cost flow."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.llm.common import WORD
from tidewheel.session import materialize

#: Membership patterns that the driver plans with by default, those of most words. Documents of a rarer pattern of
#: several sources count for one of these, drawn by a hash of the pattern; ``most_patterns=None`` plans them all.
MOST_PATTERNS = 200_000
#: Rows of a plan that are sent to all tasks; a longer one is joined.
SENT_ROWS = 20_000
#: Documents, of all patterns, in a hash bucket on average: what one task fills document by document.
BUCKET_ROWS = 4096
#: A bucket of more rows, which only rows of equal id and text can fill, is split by row.
SPLIT_ROWS = 8192
#: Documents of one pattern in a hash bucket on average, at least, or all of the pattern.
LEAST_ROWS = 1024


_OWN = frozenset("doc_id pattern size h draw number key every rest source_size target width bucket edge left extra times_taken taken in_edge as".split())


def by_rank(weights: Sequence[float] = (5, 2, 1)) -> Callable[[list], list[float]]:
    """Weights repeating over the sources in order."""
    return lambda sources: [float(weights[k % len(weights)]) for k in range(len(sources))]


def shares(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight, none above ``most`` times its size; what is above goes to the others by weight."""
    target, open_, left = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s > 0 and weights[k] > 0], float(total)
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in open_:
                target[k] = left * weights[k] / whole
            break
        for k in over:
            target[k] = float(most * sizes[k])
        left -= sum(target[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return target


class _Flow:
    """A largest flow of words from patterns through member sources to quotas, grown supply by supply.

    Between sources, what a pattern sends to one can move to another of its members. Paths
    to sources with quota left are found by levels, all shortest ones at once, so the
    number of passes over the patterns is small.
    """

    def __init__(self, members: list[list[int]], quota: list[int]):
        self.members, self.left = members, list(quota)
        self.sent: list[dict[int, int]] = [{} for _ in members]  # pattern -> source -> words
        self.users: list[set[int]] = [set() for _ in quota]  # source -> patterns that send to it
        self.of: list[list[int]] = [[] for _ in quota]
        for p, ss in enumerate(members):
            if len(ss) > 1:
                for s in ss:
                    self.of[s].append(p)

    def _give(self, p: int, s: int, n: int) -> None:
        self.sent[p][s] = self.sent[p].get(s, 0) + n
        if len(self.members[p]) > 1:
            self.users[s].add(p)

    def _take(self, p: int, s: int, n: int) -> None:
        self.sent[p][s] -= n
        if not self.sent[p][s]:
            del self.sent[p][s]
            self.users[s].discard(p)

    def _levels(self) -> list[int | None]:
        """How many moves each source is away from one with quota left."""
        level: list[int | None] = [0 if n else None for n in self.left]
        front = [s for s, n in enumerate(self.left) if n]
        while front:
            after = []
            for t in front:
                for p in self.of[t]:
                    for s in self.sent[p]:
                        if level[s] is None:
                            level[s] = level[t] + 1
                            after.append(s)
            front = after
        return level

    def _push(self, s: int, n: int, level: list, todo: list) -> int:
        """Make room for up to ``n`` words at a source by moves along falling levels."""
        done = min(n, self.left[s]) if level[s] == 0 else 0
        self.left[s] -= done
        while level[s] and done < n:
            if todo[s] is None:
                todo[s] = [(p, t) for p in sorted(self.users[s]) for t in self.members[p] if t != s and level[t] == level[s] - 1]
            if not todo[s]:
                break
            p, t = todo[s][-1]
            free = self._push(t, min(n - done, self.sent[p].get(s, 0)), level, todo)
            if free:
                self._take(p, s, free)
                self._give(p, t, free)
                done += free
            if done < n:
                todo[s].pop()
        return done

    def add(self, supply: dict[int, int]) -> None:
        """Send as much of the patterns' new words as fits; words that are sent stay sent."""
        rest = {}
        for p in sorted(supply, key=lambda p: (len(self.members[p]), p)):
            n = supply[p]
            for s in sorted(self.members[p], key=lambda s: -self.left[s]):
                if got := min(n, self.left[s]):
                    self.left[s] -= got
                    self._give(p, s, got)
                    n -= got
            if n and len(self.members[p]) > 1 or n and self.users[self.members[p][0]]:
                rest[p] = n
        while rest and any(self.left):
            level, moved = self._levels(), False
            todo: list[list | None] = [None] * len(self.left)
            for p in list(rest):
                for s in sorted((s for s in self.members[p] if level[s] is not None), key=lambda s: level[s]):
                    got = self._push(s, rest[p], level, todo)
                    if got:
                        self._give(p, s, got)
                        rest[p] -= got
                        moved = True
                    if not rest[p]:
                        del rest[p]
                        break
            if not moved:
                break


def route(capacity: dict[tuple, int], quota: dict[object, int], times: int) -> dict[tuple, int]:
    """How many words each membership pattern gives: a flow of most words at least cost.

    A pattern (the sources that its documents are in) offers its words once for
    nothing, again at cost 1, a third time at cost 2 and so on, ``times`` times at most;
    so repetition spreads over patterns before any is used once more. Each source
    takes up to its quota from the patterns that it is in.

    What patterns can send together is a polymatroid, and the cost is a sum of convex
    costs of the patterns; there the cheapest tier first, then the next on top of it, is
    the cheapest of the largest flows. So there is one largest flow for each tier, grown
    from the one before. A source whose documents are in no other needs no flow: it
    takes the lesser of its quota and ``times`` its words.
    """
    shared = {s for members in capacity if len(members) > 1 for s in members}
    out = {members: min(times * n, quota[members[0]]) for members, n in capacity.items() if len(members) == 1 and members[0] not in shared}
    patterns = [(members, n) for members, n in capacity.items() if members not in out and n]
    number = {s: k for k, s in enumerate(dict.fromkeys(s for members, _ in patterns for s in members))}
    flow = _Flow([[number[s] for s in members] for members, _ in patterns], [quota[s] for s in number])
    for _ in range(times):
        flow.add({p: n for p, (_, n) in enumerate(patterns)})
    given = {members: sum(flow.sent[p].values()) for p, (members, _) in enumerate(patterns)}
    return {members: out.get(members, given.get(members, 0)) for members in capacity}


def mix_sources(
    docs: DataFrame,
    sources: str = "source",
    text: str = "text",
    id_col: str = "doc_id",
    weights: Callable[[list], list[float]] | None = None,
    times: int = 3,
    seed: int = 7,
    keep: tuple[str, ...] = (),
    most_patterns: int | None = MOST_PATTERNS,
) -> DataFrame:
    """Decide how many words of each document go to a mix of given source weights.

    ``sources`` is a string column, or an array of strings for documents in several
    sources; null is a source of its own, sorted last. Sizes are words
    (``[^\\x20\\x09-\\x0D]+``); a null or empty text has none and is not taken. Documents are
    aggregated by membership pattern, ``route`` gives each pattern its words, and within a
    pattern every document is taken as often as the words allow; the rest is filled with
    whole documents in an order drawn by ``seed``: all of the hash buckets below the one in
    which the words run out, and in that one each document that still fits. A pattern
    has so many buckets that each holds ``LEAST_ROWS`` of its documents or more; a bucket
    that repeated rows make larger than ``SPLIT_ROWS`` is split once more, row by row.

    No document is taken more than ``times`` times. Rows of equal id, or without one, are
    documents of their own; of rows equal in id and text any may be the one that is taken
    more. An empty table gives no row; sources of no words take nothing. Returns one row
    per document: ``doc_id, pattern, size, source_size, target, times_taken, taken, h``;
    ``pattern`` is what the document counts for, ``source_size`` and ``target`` are those of
    its first source. Columns named in ``keep`` are carried along; one named as the
    operator's own is an error.

    ``most_patterns`` bounds what the driver plans with: beyond it, the rarest patterns of several
    sources count for one of these. None plans every pattern exactly, with memory and
    time of the driver that grow with their number (100,000 take about a second).
    """
    if clash := _OWN.intersection(keep):
        raise ValueError(f"the operator has columns of its own named {sorted(clash)}")
    spark = docs.sparkSession
    many = docs.schema[sources].dataType.simpleString().startswith("array")
    members = F.array_sort(F.array_distinct(F.col(sources))) if many else F.array(F.col(sources).cast("string"))
    sized = materialize(
        docs.select(
            *keep,
            F.col(id_col).cast("long").alias("doc_id"),
            F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None).cast("string"))).alias("pattern"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text).alias("h"),
        ).withColumns({"draw": F.xxhash64(F.lit(seed), "doc_id", "h"), "number": F.monotonically_increasing_id()}),
        "sizes",
    )
    sized, found = _planned(sized, most_patterns)
    capacity = {tuple(r["pattern"]): r["size"] for r in found}
    names = sorted({s for p in capacity for s in p}, key=lambda s: (s is None, s or ""))
    size_of = dict.fromkeys(names, 0)
    for p, n in capacity.items():
        for s in p:
            size_of[s] += n
    target = dict(zip(names, shares([size_of[s] for s in names], (weights or by_rank())(names), sum(capacity.values()), times), strict=True))
    given = route(capacity, {s: round(t) for s, t in target.items()}, times)

    width = -(-sum(r["n"] for r in found) // BUCKET_ROWS) or 1
    rows_of = {tuple(r["pattern"]): r["n"] for r in found}
    plan_rows = []
    for p, n in capacity.items():
        every = min(times, given[p] // n) if n else 0
        plan_rows.append((list(p), every, given[p] - every * n, size_of[p[0]], target[p[0]], max(1, min(width, rows_of[p] // LEAST_ROWS))))
    send = F.broadcast if len(plan_rows) <= SENT_ROWS else lambda df: df
    key = F.to_json("pattern")
    plan = spark.createDataFrame(plan_rows, "pattern array<string>, every long, rest long, source_size long, target double, width long").withColumn("key", key).drop("pattern")
    marked = sized.withColumn("key", key).join(send(plan), "key").withColumn("bucket", F.pmod("draw", "width"))
    edge = _edges(marked, spark, send)
    below = F.expr("CASE WHEN rest = 0 OR size = 0 THEN 0 WHEN edge IS NULL OR bucket < edge THEN 1 WHEN bucket > edge THEN 0 END").cast("int")
    marked = marked.join(edge, "key", "left").withColumn("extra", below)
    full, at_edge = marked.where("extra IS NOT NULL"), marked.where("extra IS NULL")
    # one hash bucket a pattern is left; repeated rows can make it large
    large = at_edge.groupBy("key").agg(F.count("*").alias("in_edge")).where(F.col("in_edge") > SPLIT_ROWS)
    if not large.isEmpty():
        split = at_edge.drop("edge").withColumn("rest", F.col("left")).drop("left").join(large, "key", "left")
        parts = F.ceil(F.coalesce(F.col("in_edge"), F.lit(1)) / LEAST_ROWS)
        split = split.withColumn("bucket", F.pmod(F.xxhash64("draw", "number"), parts)).drop("in_edge", "extra")
        again = split.join(_edges(split, spark, send), "key", "left").withColumn("extra", below)
        full = full.unionByName(again.where("extra IS NOT NULL"), allowMissingColumns=True)
        at_edge = again.where("extra IS NULL").select(at_edge.columns)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "doc_id", "h", "number"], kind="stable", na_position="last")
        left, extra = int(rows["left"].iloc[0]), []
        for n in rows["size"]:
            extra.append(int(n <= left))
            left -= int(n) * extra[-1]
        return rows.assign(extra=extra)

    filled = at_edge.groupBy("key").applyInPandas(fill, at_edge.schema)
    count = F.least(F.col("every") + F.col("extra"), F.lit(times))
    return full.select(filled.columns).unionByName(filled).select("doc_id", "pattern", "size", "source_size", "target", count.cast("int").alias("times_taken"), (count * F.col("size")).alias("taken"), "h", *keep)


def _planned(sized: DataFrame, most: int | None) -> tuple[DataFrame, list]:
    """The documents with the pattern that they count for, and the words and rows of each such pattern."""
    sums = lambda df: df.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    if most is None:
        return sized, sums(sized).orderBy(F.desc("size"), F.to_json("pattern")).collect()  # in order, so that reruns agree
    found = sums(sized).orderBy(F.desc("size"), F.to_json("pattern")).limit(most + 1).collect()
    if len(found) <= most:
        return sized, found
    first = sums(sized).orderBy(F.desc("size"), F.to_json("pattern")).limit(most).select("pattern", F.lit(True).alias("planned"))
    one = F.array(F.element_at("pattern", (F.pmod(F.xxhash64("pattern"), F.size("pattern")) + 1).cast("int")))
    folded = sums(sized).select("pattern").join(first, "pattern", "left").select(F.to_json("pattern").alias("key"), F.when(F.col("planned"), F.col("pattern")).otherwise(one).alias("as"))
    folded = materialize(folded, "folded")
    now = sized.withColumn("key", F.to_json("pattern")).join(folded, "key").withColumn("pattern", F.col("as")).drop("as", "key")
    now = materialize(now, "folded-sizes")
    return now, sums(now).collect()  # the planned patterns, and one for each source


def _edges(rows: DataFrame, spark, send) -> DataFrame:
    """Of each key, the bucket in which its words run out, and the words left for it: ``key, edge, left``.

    A row for each bucket meets by key; a bucket stands for ``LEAST_ROWS`` rows or more.
    """
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    order = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    at = sums.withColumn("up_to", F.sum("words").over(order)).where("up_to > rest and up_to - words <= rest")
    edge = at.groupBy("key").agg(F.min(F.struct("bucket", (F.col("rest") - (F.col("up_to") - F.col("words"))).alias("left"))).alias("e")).select("key", F.col("e.bucket").alias("edge"), F.col("e.left").alias("left"))
    # a row for each pattern at most
    return send(spark.createDataFrame([tuple(r) for r in edge.collect()], "key string, edge long, left long"))
