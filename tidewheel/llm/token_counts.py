"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.bpe import load, tokenizer_path
from tidewheel.llm.common import map_rows


def count_tokens(docs: DataFrame, tokenizer: str | None = None, text: str = "text", id_col: str = "doc_id", limit: int = 2048) -> DataFrame:
    """The number of tokens of each whole text, as the tokenizers library counts them.

    Pre-tokens that are proven to be one token of the vocabulary count as one each;
    only the others are merged. No rows move between tasks. A null text is empty and
    has no token; ids may be null or repeated, every row gives one row. Whole texts count,
    however long. An empty table gives an empty table; other columns take no part, whatever
    their names.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``).
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def count(rows):
        return {"doc_id": rows.column("doc_id"), "n_bytes": rows.column("n_bytes"), "n_tokens": load(path).count_all([x or "" for x in rows.column("text").to_pylist()])}

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return map_rows(source, count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
