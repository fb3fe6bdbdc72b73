"""Corpus preparation in five stages, each written as Parquet and read by the next.

Every stage takes rows with any further columns, whatever their names, and gives them
back unchanged. Ids may be null or repeated: rows are told apart by themselves. An empty
table gives an empty table. Each stage says what it does with null and empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import positional
from tidewheel.llm.mixing import mix_sources
from tidewheel.llm.packing import pack
from tidewheel.llm.pii import sanitise
from tidewheel.llm.rules import without_rejected
from tidewheel.llm.simhash import simhash_components
from tidewheel.session import materialize, remove, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and very short texts go, repeated rows stay."""
    return without_rejected(docs)


def _numbered(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """``positional`` rows with a number of their own, ``row``, that stays whatever reads them."""
    plain, name, back = positional(docs)
    return materialize(plain.withColumn("row", F.monotonically_increasing_id()), "rows"), name, back


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows, the one of the smallest id, text hash and row number.

    Rows of equal id are documents of their own; a row without an id comes after those with one.
    Null and wordless texts have one fingerprint, so they are one group.
    """
    rows, name, back = _numbered(docs)
    groups = simhash_components(rows, name("text"), "row").select(F.col("doc_id").alias("row"), "component_id")
    rank = F.struct(F.col(name("doc_id")).isNull().alias("without"), F.col(name("doc_id")).alias("id"), F.xxhash64(name("text")).alias("h"), "row")
    first = groups.join(rows.select("row", rank.alias("rank")), "row").groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.row")
    return back(rows.join(first, "row", "left_semi"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced by its kind; null texts stay null."""
    return sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; those without words, null texts too, are not taken.

    A null source is a source. Copies are equal rows.
    """
    rows, name, back = _numbered(docs)
    mixed = mix_sources(rows, name("source"), name("text"), name("doc_id"), keep=("row",)).where("times_taken > 0").select("row", "times_taken")
    return back(rows.join(mixed, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times_taken")))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece; a null or empty text is its end token alone."""
    return pack(docs)


STAGES = [("quality rules", quality), ("simhash near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("packing", packing)]

#: Personal data and packing are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's own tables, and the stage before, are deleted when it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if before:
            remove(spark, before)
        before = path
    return docs
