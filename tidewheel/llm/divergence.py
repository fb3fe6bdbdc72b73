"""How far each source's vocabulary is from that of its language and of the other sources."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.session import materialize

#: Runs of what is not 00 to 40, 5B to 60 or 7B to 7F, written as what that leaves: Java takes a tenth of the time.
TERM = r"[A-Za-z\x80-\x{10FFFF}]+"
LEAST_DOCS = 30
TOP_TERMS = 50
#: Occurrences that every kept term gets on top of its own.
SMOOTHING = 5
#: Shares are whole numbers of this unit.
UNIT = 1_000_000_000


def lowered(term: Column) -> Column:
    """A-Z as small letters; terms without other letters take the quick way."""
    return F.when(F.length(term) == F.octet_length(term), F.lower(term)).otherwise(F.translate(term, string.ascii_uppercase, string.ascii_lowercase))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: how often a term comes in a group, and in how many of its documents.

    The matches of a text are taken once: all of them, and each different one, are
    exploded together and told apart by ``kind``.
    """
    # a text of plain letters only is lowered at once, others term by term
    plain = F.length("text") == F.octet_length("text")
    matched = docs.select("lang", "source", plain.alias("plain"), F.regexp_extract_all(F.when(plain, F.lower("text")).otherwise(F.col("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    different = F.array_distinct("terms")
    once = F.when(F.col("plain"), different).otherwise(F.array_distinct(F.transform(different, lowered)))
    parts = F.array(F.struct(F.lit(0).alias("kind"), F.col("plain"), F.col("terms")), F.struct(F.lit(1).alias("kind"), F.lit(True).alias("plain"), once.alias("terms")))
    rows = matched.select("lang", "source", F.explode(parts).alias("part")).select("lang", "source", F.col("part.kind").alias("kind"), F.col("part.plain").alias("plain"), F.explode("part.terms").alias("term"))
    term = F.when(F.col("plain"), F.col("term")).otherwise(lowered(F.col("term")))
    return rows.select("lang", "source", "kind", term.alias("term")).groupBy("lang", "source", "term").agg(F.count_if(F.col("kind") == 0).alias("n"), F.count_if(F.col("kind") == 1).alias("docs"))


def _share(count: Column, total: Column, kept: Column, smoothing: int) -> Column:
    """``1 + floor(UNIT * (count + smoothing) / (total + smoothing * kept))`` in whole numbers of up to 38 digits."""
    wide = "decimal(19,0)"
    over = F.lit(UNIT).cast(wide) * (count + F.lit(smoothing)).cast(wide)
    return 1 + F.call_function("div", over, (total + F.lit(smoothing) * kept).cast(wide))


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, smoothing: int = SMOOTHING) -> DataFrame:
    """Distances between the term shares of the sources of each language, and their most typical terms.

    Returns ``lang, source, part, item, value, rank``. A language keeps the terms that at
    least ``least_docs`` of its documents hold; every group of a language and a source has
    a share of each. Part ``pair``: ``item`` is another source of the language and
    ``value`` the sum of the differences over all kept terms, every one ranked. Part
    ``term``: ``item`` is a kept term that the group holds and favours over its language,
    ``value`` the difference, the first ``top`` ranked. Ties go to the smaller item.

    Only relational operations: matches are exploded and counted, groups are crossed with
    the kept vocabulary of their language so that zeros are rows, and the dense table is
    joined with itself on language and term. Vocabularies are dealt out by a hash of the
    term, so a language of many rows is no single task.

    Null texts, languages and sources count as empty ones: an empty text has no terms, an
    empty language or source is one like any other. Repeated rows are documents of their
    own. A language without a kept term has pairs of value zero and no terms; a language of
    one source has no pairs. Whole texts are taken, however long; an empty table gives an empty
    table; ids and other columns take no part, whatever their names.
    """
    spark = docs.sparkSession
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    found = materialize(term_counts(plain), "all-term-counts")
    kept = materialize(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term"), "kept-terms")
    counts = materialize(found.select("lang", "source", "term", "n").join(kept, ["lang", "term"], "left_semi"), "term-counts")
    groups = materialize(plain.select("lang", "source").distinct(), "groups")

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt")
    crossed = _salted(groups, salts).join(kept.select("*", salt), ["lang", "salt"]).drop("salt")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    # one row a group: its kept occurrences, those of its language, and the vocabulary's size
    totals = groups.join(of_group, ["lang", "source"], "left").join(size, "lang").join(of_lang, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("all", F.lit(0)).alias("all"), "v")
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    filled = crossed.join(counts, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    salted = _salted(totals, salts).join(filled.select("*", salt), ["lang", "source", "salt"])
    dense = materialize(
        salted.join(in_lang, ["lang", "term"]).select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("v"), smoothing).alias("p"), _share(F.col("n_lang"), F.col("all"), F.col("v"), smoothing).alias("q")),
        "dense",
    )

    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    apart = dense.join(other, ["lang", "term"]).where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item"))
    pair = pairs.join(apart, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    term = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
x AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
gn AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM dense GROUP BY lang, source),
ln AS (SELECT lang, sum(n) AS total, count(*) AS v FROM l GROUP BY lang),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS p FROM dense JOIN gn USING (lang, source)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS q FROM l JOIN ln USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
both_parts AS (SELECT * FROM pair UNION ALL SELECT * FROM term),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
