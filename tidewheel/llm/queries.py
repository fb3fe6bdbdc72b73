"""The corpus operators as queries over the standard tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.llm.common import table
from tidewheel.llm.divergence import DIVERGENCE_SQL, source_divergence
from tidewheel.llm.embedding_dedup import near_vectors
from tidewheel.llm.licenses import scan_licenses
from tidewheel.llm.mixing import mix_sources
from tidewheel.llm.packing import pack
from tidewheel.llm.pii import find_personal_data
from tidewheel.llm.quality_model import score_quality
from tidewheel.llm.resampling import RESAMPLING_SQL, resample
from tidewheel.llm.rules import REPORT_SQL, quality_report
from tidewheel.llm.simhash import simhash_components
from tidewheel.llm.substrings import SUBSTRING_SQL, without_repeats
from tidewheel.llm.token_counts import count_tokens
from tidewheel.llm.token_files import token_files_roundtrip


def op1_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_quality_model(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"))


def op7_personal_data(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents")).drop("_spans")


def op8_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_token_files(spark, sf_dir):
    return token_files_roundtrip(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op11_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_substrings(spark, sf_dir):
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_quality_model, op3_license_scan, op4_packing, op5_simhash, op6_quality_rules, op7_personal_data, op8_token_counts, op9_token_files, op10_mixing, op11_resampling, op12_divergence, op13_substrings)}

ORACLES = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, to_id) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.to_id),
c AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n ON n.a = v.vec_id
""",
    "op6_quality_rules": REPORT_SQL,
    "op11_resampling": RESAMPLING_SQL,
    "op12_divergence": DIVERGENCE_SQL,
    "op13_substrings": SUBSTRING_SQL,
}
