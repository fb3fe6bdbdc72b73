"""Column types of the catalog's tables, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 3
METRICS = ("ldlj", "sparc", "dead_fraction", "gripper_chatter_rate", "joint_path_length", "overall_saturation", "mean_entropy", "psd_high_fraction", "state_action_consistency", "static_fraction", "jitter_ratio")

TABLES = {
    "episodes": "episode_id string not null, content_hash string not null, source_uri string not null, source_format string not null, robot string, task string, language_instruction string, operator_id string, scene_id string, num_frames int not null, duration_s float not null, fps float not null, cameras array<struct<name:string,width:int,height:int,fps:float>> not null, state_dim short, action_dim short, ingest_batch_id string not null, ingested_at timestamp not null, extra map<string,string> not null",
    "quality_scores": "episode_id string not null, scorer_version string not null, overall_score float, " + ", ".join(f"{m} float" for m in METRICS) + ", flags array<string> not null, computed_at timestamp not null",
    "embeddings": "episode_id string not null, model_id string not null, level string not null, camera string, pooling string not null, dim int not null, vector array<float> not null, num_frames_sampled int, computed_at timestamp not null",
    "dedup_edges": "episode_a string not null, episode_b string not null, similarity float not null, model_id string not null, method string not null, computed_at timestamp not null",
    "curation_labels": "episode_id string not null, label string not null, reason string, labeled_by string not null, labeled_at timestamp not null",
}


def schema_of(table: str) -> StructType:
    if table not in TABLES:
        raise ValueError(f"no such table: {table}")
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The rows in the table's columns and types.

    Unknown columns and required ones that are missing raise at once; a null in a
    required column, or a value that its type can't hold, fails the write.
    """
    want = schema_of(table)
    names = {f.name for f in want}
    if extra := [c for c in df.columns if c not in names]:
        raise ValueError(f"{table}: unknown columns {extra}")
    if missing := [f.name for f in want if not f.nullable and f.name not in df.columns]:
        raise ValueError(f"{table}: missing required columns {missing}")
    out = []
    for f in want:
        kind = f.dataType.simpleString()
        c = F.col(f.name).cast(kind) if f.name in df.columns else F.lit(None).cast(kind)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{table}.{f.name} must not be null")).cast(kind)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)
