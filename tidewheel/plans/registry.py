"""Known datasets, where a name points to, and files that name a selection of episodes."""

from __future__ import annotations

import difflib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans.catalog import Files
from tidewheel.sources.lerobot import HUB_URL

ENTRY = "id string, name string, description string, format string, embodiment array<string>, tags array<string>, demo_suitable boolean, sources array<struct<type:string,uri:string>>"
SEARCHED = ("id", "name", "description", "format")


class Registry:
    """Datasets from a JSON file of entries, one list of objects with the fields of ``ENTRY``."""

    def __init__(self, spark: SparkSession, path: str):
        folder, _, name = path.rstrip("/").rpartition("/")
        raw = json.loads(Files(spark, folder).read(name))
        self.raw = raw["datasets"] if isinstance(raw, dict) else raw
        if problems := [p for k, e in enumerate(self.raw) for p in entry_problems(e, k)]:
            raise ValueError("; ".join(problems))
        ids = [e["id"] for e in self.raw]
        if twice := sorted({i for i in ids if ids.count(i) > 1}):
            raise ValueError(f"ids that come twice: {twice}")
        # a registry is a file of entries written by hand
        self.entries = spark.read.schema(ENTRY).json(spark.sparkContext.parallelize([json.dumps(e) for e in self.raw], 1)) if self.raw else spark.createDataFrame([], ENTRY)

    def get(self, dataset_id: str) -> dict:
        found = {e["id"]: e for e in self.raw}
        if dataset_id not in found:
            like = difflib.get_close_matches(dataset_id, list(found), n=3, cutoff=0.4)
            raise KeyError(f"no dataset {dataset_id!r}" + (f"; did you mean {', '.join(like)}?" if like else ""))
        return found[dataset_id]

    def list(self, format: str | None = None, embodiment: str | None = None, tag: str | None = None, demo_only: bool = False) -> DataFrame:
        """Entries that fit all that is given; words are looked for inside, whatever their case."""
        x = self.entries
        if format:
            x = x.where(F.contains(F.lower("format"), F.lit(format.lower())))
        for column, word in (("embodiment", embodiment), ("tags", tag)):
            if word:
                wanted = F.lit(word.lower())
                x = x.where(F.exists(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda v: F.contains(F.lower(v), wanted)))  # noqa: B023
        return x.where(F.coalesce("demo_suitable", F.lit(False))) if demo_only else x

    def search(self, words: str) -> DataFrame:
        """Entries that have every word in some field, those with more hits first, then in the file's order."""
        wanted = words.lower().split()
        many = [F.lower(F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")) for c in ("embodiment", "tags")]
        fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in SEARCHED] + many
        x = self.entries.withColumn("_n", F.monotonically_increasing_id())
        hits = F.lit(0)
        for w in wanted:
            met = [F.contains(f, F.lit(w)) for f in fields]
            any_ = met[0]
            for m in met[1:]:
                any_ = any_ | m
            x = x.where(any_)
            for m in met:
                hits = hits + m.cast("int")
        return x.withColumn("score", hits).orderBy(F.desc("score"), "_n").drop("_n")


def entry_problems(entry: dict, place: int) -> list[str]:
    """What is wrong with an entry, each named by its place in the file."""
    out = [f"datasets[{place}].{k}: required" for k in ("id", "name", "format") if not entry.get(k)]
    if entry.get("id") and not re.fullmatch(r"[a-z0-9][a-z0-9_.-]*", entry["id"]):
        out.append(f"datasets[{place}].id: lower-case letters, digits, '_', '.' and '-' only")
    out += [f"datasets[{place}].{k}: must be a list" for k in ("embodiment", "tags", "sources") if not isinstance(entry.get(k, []), list)]
    return out


def resolve_path(spark: SparkSession, name: str, registry: Registry | None = None) -> tuple[str, str]:
    """What a dataset's name points to: its kind and place.

    In this order: a hub address, an address of a store, something that is there, an id
    of the registry (its first source), ``org/repo`` on the hub, else a path.
    """
    if HUB_URL.match(name):
        return "hub", name
    if re.match(r"(s3a?|gs|gcs|abfss?|hdfs|viewfs|file|memory)://", name):
        return "store", name
    if Files(spark, name).exists(""):
        return "path", name
    if registry is not None and any(e["id"] == name for e in registry.raw):
        sources = registry.get(name).get("sources") or []
        if not sources:
            raise ValueError(f"dataset {name!r} has no source")
        return resolve_path(spark, sources[0]["uri"])
    if re.fullmatch(r"[\w.-]+/[\w.-]+", name):
        return "hub", f"hf://{name}"
    return "path", name


def write_selection(spark: SparkSession, path: str, episode_ids: list[str], source: str, reason: str | None = None, label: str | None = None) -> None:
    """A file that names episodes chosen by hand, and why."""
    folder, _, name = path.rpartition("/")
    made = {"episode_ids": list(dict.fromkeys(episode_ids)), "source": source} | ({"reason": reason} if reason else {}) | ({"label": label} if label else {})
    Files(spark, folder).write(name, json.dumps(made))


def read_selection(spark: SparkSession, path: str) -> dict:
    folder, _, name = path.rpartition("/")
    made = json.loads(Files(spark, folder).read(name))
    if not isinstance(made, dict) or not isinstance(made.get("episode_ids"), list) or not all(isinstance(x, str) for x in made["episode_ids"]):
        raise ValueError(f"{path}: episode_ids must be a list of strings")
    if made.get("label") not in (None, "approved", "rejected", "held"):
        raise ValueError(f"{path}: no such label {made['label']!r}")
    return {"source": None, "reason": None, "label": None} | made
