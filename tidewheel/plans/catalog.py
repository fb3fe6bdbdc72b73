"""An append-only Parquet catalog: rows count once a manifest names their files."""

from __future__ import annotations

import datetime
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.vectors import check_metric, cosine, latest, mean_vector, usable
from tidewheel.plans import functions
from tidewheel.plans.log import CommitLog, Files
from tidewheel.plans.schema import METRICS, SCHEMA_VERSION, TABLES, conform, schema_of
from tidewheel.plans.vector_index import VectorIndex

POLICIES = ("higher-quality", "longer", "first")
LABELS = ("approved", "rejected", "held")


class Catalog:
    """Tables of episodes, scores, embeddings, near-duplicate edges and labels."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        if not self.files.exists("catalog.json"):
            raise FileNotFoundError(f"no catalog at {root}")
        self.log = CommitLog(spark, self.files)
        found = json.loads(self.files.read("catalog.json"))
        if found["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"catalog has schema version {found['schema_version']}; this code knows {SCHEMA_VERSION}")

    @staticmethod
    def init(spark: SparkSession, root: str, exist_ok: bool = False) -> Catalog:
        files = Files(spark, root)
        if files.exists("catalog.json"):
            if not exist_ok:
                raise FileExistsError(f"there is a catalog at {root}")
        else:
            files.write("catalog.json", json.dumps({"schema_version": SCHEMA_VERSION, "created_at": _now().isoformat(), "tables": sorted(TABLES)}))
        return Catalog(spark, root)

    def commit(self, tables: dict[str, DataFrame], batch_id: str | None = None) -> str:
        """Append rows of one or several tables; readers see all of them or none."""
        return self._commit(tables, batch_id)["batch_id"]

    def _commit(self, tables: dict[str, DataFrame], batch_id: str | None = None) -> dict:
        self.log.refresh()
        batch, day = batch_id or uuid.uuid4().hex, _now().date().isoformat()
        named: dict[str, list[str]] = {}
        for name, df in tables.items():
            folder = f"{name}/ingest_date={day}/{batch}-{uuid.uuid4().hex[:8]}"
            conform(df, name).write.parquet(f"{self.root}/{folder}")
            named[name] = [f"{folder}/{p.rsplit('/', 1)[1]}" for p in self.files.glob(f"{folder}/*.parquet")]
        at = _now().isoformat()
        # for readers that know manifests only; the log's entry is the commit
        self.files.write(f"_batches/{batch}/manifest-{uuid.uuid4().hex}.json", json.dumps({"batch_id": batch, "committed_at": at, "files": named}))
        return self.log.append(batch, at, named)

    def committed(self, table: str, after: int = -1) -> list[str]:
        return self.log.committed(table, after)

    def orphans(self) -> list[str]:
        """Files on disk that no manifest names."""
        known = {f for t in TABLES for f in self.committed(t)}
        found = [p for t in TABLES for p in self.files.glob(f"{t}/*/*/*.parquet")]
        return [p for p in found if "/".join(p.rsplit("/", 4)[1:]) not in known]

    def table(self, name: str, after: int = -1) -> DataFrame:
        """The committed rows, or only those of commits later than ``after``."""
        return self._rows(name, self.committed(name, after))

    def _rows(self, name: str, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema_of(name))
        return self.spark.read.schema(schema_of(name)).parquet(*(f"{self.root}/{f}" for f in files))

    def latest_quality(self) -> DataFrame:
        """The newest score of each episode; versions compare as strings."""
        return latest(self.table("quality_scores"), ["episode_id"], F.desc("scorer_version"), F.desc("computed_at"))

    def curation(self) -> DataFrame:
        return latest(self.table("curation_labels"), ["episode_id"], F.desc("labeled_at"), F.desc("label"))

    def views(self) -> None:
        """The tables and views by name, and the functions of ``functions`` beside them."""
        functions.register(self.spark)
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        self.latest_quality().createOrReplaceTempView("v_latest_quality")
        self.curation().createOrReplaceTempView("v_curation")
        for policy in POLICIES:
            self.dup_losers(0.0, policy, keep_similarity=True).createOrReplaceTempView(f"v_dup_losers_{policy.replace('-', '_')}")
        self.spark.sql("DROP TEMPORARY FUNCTION IF EXISTS v_dup_losers")
        chosen = " UNION ALL ".join(f"SELECT episode_id, similarity, '{p}' AS policy FROM v_dup_losers_{p.replace('-', '_')}" for p in POLICIES)
        self.spark.sql(f"CREATE TEMPORARY FUNCTION v_dup_losers(thr DOUBLE, chosen STRING) RETURNS TABLE (episode_id STRING) RETURN SELECT DISTINCT l.episode_id FROM ({chosen}) l WHERE l.similarity >= v_dup_losers.thr AND l.policy = v_dup_losers.chosen")

    def query(self, sql: str) -> DataFrame:
        """A single SELECT (or WITH) over the catalog's tables and views."""
        if not re.match(r"\s*(select|with)\b", sql, re.I):
            raise ValueError("only SELECT is allowed")
        self.views()
        return self.spark.sql(sql)

    def dup_losers(self, threshold: float, policy: str = "higher-quality", keep_similarity: bool = False) -> DataFrame:
        edges = self.table("dedup_edges").where(F.col("similarity") >= threshold)
        return dup_losers(edges, self.latest_quality(), self.table("episodes"), policy, keep_similarity)

    def compute_edges(self, model_id: str, threshold: float = 0.97, metric: str = "dot") -> int:
        """Near-duplicate edges that are not there yet; how many were added.

        Vectors stay in an index (see ``vector_index``): only those committed since the last
        run at this threshold or a lower one query it, and pairs of older ones are not
        looked at again. The first run, a lower threshold and a table that has outgrown
        its lists go over all vectors.
        """
        check_metric(threshold, metric)
        head, found, saved = self.log.head(), None, []
        mine = self._episode_vectors(model_id)
        sizes = {r["dim"]: r["n"] for r in mine.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each length of vector
        for dim in sorted(d for d in sizes if d > 0):
            index = VectorIndex(self, model_id, dim, metric)
            rows = mine if index.needs_all(threshold, sizes[dim]) else self._episode_vectors(model_id, index.state["head"])
            rows = usable(rows.where(F.size("vector") == dim), "episode_id", "vector", ["camera"]).withColumnRenamed("_k0", "camera")
            if rows.isEmpty():
                continue
            pairs, state = index.update(rows, sizes[dim], head, threshold)
            saved.append((index, state))
            if pairs is not None:
                found = pairs if found is None else found.unionByName(pairs)
        have = self.table("dedup_edges").where(F.col("model_id") == model_id).select("episode_a", "episode_b")
        added = 0
        if found is not None:
            best = found.groupBy("episode_a", "episode_b").agg(F.max("similarity").alias("similarity"))
            rows = best.join(have, ["episode_a", "episode_b"], "left_anti").withColumns({"model_id": F.lit(model_id), "method": F.lit("ann-cosine"), "computed_at": F.lit(_now())})
            added = self._rows("dedup_edges", self._commit({"dedup_edges": rows})["files"]["dedup_edges"]).count()
        for index, state in saved:  # once the edges are there; a run that stops before is done again
            index.save(state)
        return added

    def _episode_vectors(self, model_id: str, after: int = -1) -> DataFrame:
        v = self.table("embeddings", after).where((F.col("model_id") == model_id) & (F.col("level") == "episode"))
        return v.withColumn("camera", F.coalesce("camera", F.lit("")))

    def curate(self, by: str, where: str | None = None, ids: list[str] | None = None, label: str = "approved", reason: str | None = None, dedup: float | None = None, policy: str = "higher-quality") -> DataFrame:
        """Label a selection; near-duplicate losers in it are rejected instead."""
        if label not in LABELS:
            raise ValueError(f"label must be one of {LABELS}")
        episodes = self.table("episodes")
        chosen = episodes.join(self.latest_quality().drop("flags", "computed_at"), "episode_id", "left")
        if where:
            chosen = chosen.where(F.expr(where))
        if ids is not None:
            wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "episode_id string")
            if missing := [r[0] for r in wanted.join(episodes, "episode_id", "left_anti").take(5)]:
                raise ValueError(f"no such episodes: {missing}")
            chosen = chosen.join(wanted, "episode_id", "left_semi")
        out = chosen.select("episode_id")
        if dedup is not None:
            losers = self.dup_losers(dedup, policy).withColumn("_lost", F.lit(True))
            out = out.join(losers, "episode_id", "left").select("episode_id", F.when(F.col("_lost"), "rejected").otherwise(label).alias("label"), F.when(F.col("_lost"), f"policy:{policy}").otherwise(F.lit(reason)).alias("reason"))
        else:
            out = out.select("episode_id", F.lit(label).alias("label"), F.lit(reason).cast("string").alias("reason"))
        out = out.withColumns({"labeled_by": F.lit(by), "labeled_at": F.lit(_now())})
        self.commit({"curation_labels": out})
        return self.curation()

    def search(self, query: list[float] | None = None, like: str | None = None, model_id: str | None = None, top: int = 10, text: str | None = None, camera: str | None = None) -> DataFrame:
        """Episodes by cosine to a vector, to the mean of an episode's own vectors, or to a text.

        A text becomes a vector by the model that is registered under the name before the "@"
        of ``model_id`` (see ``sampling.register_model``). ``camera`` keeps to one view.
        """
        if sum(x is not None for x in (query, like, text)) != 1:
            raise ValueError("give a query vector, an episode or a text")
        v = self.table("embeddings")
        if model_id is None:
            models = [r[0] for r in v.select("model_id").distinct().take(2)]
            if len(models) != 1:
                raise ValueError("name the model")
            model_id = models[0]
        v = v.where((F.col("model_id") == model_id) & (F.col("level") == "episode") & (F.lit(True) if camera is None else F.col("camera") == camera))
        if like is not None:
            mine = mean_vector(v.where(F.col("episode_id") == like), ["episode_id"]).select("vector").first()
            if mine is None:
                raise ValueError(f"no vectors of {like}")
            query = list(mine[0])
        if text is not None:
            from tidewheel.operators.sampling import model

            query = [float(x) for x in model(model_id.split("@")[0])([text])[0]]
        q = F.array(*(F.lit(float(x)) for x in query))
        best = v.select("episode_id", "camera", cosine(F.col("vector"), q).alias("score")).groupBy("episode_id").agg(F.max(F.struct("score", "camera")).alias("b"))
        return best.join(self.table("episodes"), "episode_id").select("episode_id", "b.score", "b.camera", "task", "robot").orderBy(F.desc("score"), "episode_id").limit(top)

    def stats(self) -> DataFrame:
        e, q = self.table("episodes"), self.latest_quality().select("episode_id", "overall_score")
        x = e.join(q, "episode_id", "left").withColumn("task", F.coalesce("task", F.lit("(none)")))
        return x.groupBy("task").agg(F.count("*").alias("episodes"), F.sum("num_frames").alias("frames"), F.sum("duration_s").alias("seconds"), F.min("overall_score").alias("min_score"), F.avg("overall_score").alias("avg_score"), F.median("overall_score").alias("median_score"), F.max("overall_score").alias("max_score"))

    def ingest(self, episodes: DataFrame, scores: DataFrame | None = None, batch_id: str | None = None) -> str:
        """Register episodes whose content is not there yet; of equal ones, the first id."""
        new = latest(episodes, ["content_hash"], F.col("episode_id")).join(self.table("episodes").select("content_hash"), "content_hash", "left_anti")
        tables = {"episodes": new}
        if scores is not None:
            tables["quality_scores"] = scores.join(new.select("episode_id"), "episode_id", "left_semi")
        return self.commit(tables, batch_id)

    def ingest_dataset(self, path: str, fps: float | None = None, robot: str | None = None, scorer: str = "q-v2", batches: int = 1, **settings) -> dict[str, int]:
        """Read a dataset, hash, score and register its episodes.

        Episodes whose content is in the catalog, or comes twice in the dataset, are passed
        over. Ids follow from source and content, so a repeated run makes the same. With
        several ``batches``, episodes are committed part by part, dealt by their hash, and
        ``_batches/<id>/_checkpoint.json`` says how far a run came; a run that was cut short is
        taken up by running it again. ``fps`` is the dataset's own if it is not given, else that
        of its times, and 30 to judge by if neither tells. ``settings`` go to ``episode_metrics``.
        """
        from tidewheel.operators import inspect, quality
        from tidewheel.session import materialize
        from tidewheel.sources import datasets, lerobot

        kind = lerobot.detect_format(self.spark, path)
        meta = lerobot.info(self.spark, path) if kind in ("lerobot-v2", "lerobot-v3", "groot") else {}
        frames, said = datasets.open_dataset(self.spark, path, fps or meta.get("fps") or 30.0)
        stored = fps or meta.get("fps")
        if not stored:
            rates = inspect.frame_rate(inspect.first_episodes(frames, 5, 100)).where("fps is not null").orderBy("episode_id").take(1)
            stored = rates[0]["fps"] if rates else 0.0
        frames = frames.withColumn("episode_id", F.col("episode_id").cast("string"))
        metrics = quality.episode_metrics(frames, float(stored or 30.0), spectra=True, **settings)
        sizes = frames.groupBy("episode_id").agg(F.min_by(F.size("state"), "frame_index").alias("state_dim"), F.min_by(F.size("action"), "frame_index").alias("action_dim"))
        scored = materialize(metrics.join(sizes, "episode_id").join(said.withColumn("episode_id", F.col("episode_id").cast("string")), "episode_id", "left"), "scored")
        ranked = latest(scored, ["content_hash"], F.col("episode_id"))
        batch, now = uuid.uuid4().hex, _now()
        ids = F.substring(F.sha2(F.concat_ws("|", F.lit(path), "episode_id", "content_hash"), 256), 1, 32)
        dim = lambda c: F.when(F.col(c) >= 0, F.col(c).cast("short"))
        per = float(stored or 0.0)
        episodes = ranked.select(
            ids.alias("episode_id"), "content_hash", F.lit(path).alias("source_uri"), F.lit(kind).alias("source_format"), F.lit(robot or meta.get("robot_type")).cast("string").alias("robot"),
            F.lit(None).cast("string").alias("task"), "language_instruction", F.col("num_frames").cast("int").alias("num_frames"), F.when(F.lit(per) > 0, F.col("num_frames") / F.lit(per or 1.0)).otherwise(0.0).cast("float").alias("duration_s"), F.lit(per).cast("float").alias("fps"),
            F.array().cast("array<struct<name:string,width:int,height:int,fps:float>>").alias("cameras"), dim("state_dim").alias("state_dim"), dim("action_dim").alias("action_dim"), F.lit(batch).alias("ingest_batch_id"), F.lit(now).alias("ingested_at"), F.create_map(F.lit("source_episode_id"), "episode_id").alias("extra"),
        )
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None)).cast("float")
        named = {"psd_high_fraction": "psd_high", "state_action_consistency": "neighbour_variance"}
        scores = ranked.select(ids.alias("episode_id"), F.lit(scorer).alias("scorer_version"), number("overall_score").alias("overall_score"), *(number(named.get(m, m)).alias(m) for m in METRICS), "flags", F.lit(now).alias("computed_at"))
        seen, before = scored.count(), self.table("episodes").count()
        part = F.pmod(F.xxhash64("content_hash"), F.lit(batches))
        of_part = episodes.select("episode_id", "content_hash")
        for k in range(batches):
            mine = episodes.where(part == k)
            self.ingest(mine, scores.join(of_part.where(part == k).select("episode_id"), "episode_id", "left_semi"), f"{batch}-{k}" if batches > 1 else batch)
            self.files.write(f"_batches/{batch}/_checkpoint.json", json.dumps({"batch_id": batch, "source_uri": path, "parts": batches, "done": k + 1, "updated_at": _now().isoformat()}))
        registered = self.table("episodes").count() - before
        return {"seen": seen, "registered": registered, "skipped": seen - registered, "scored": scores.where("overall_score is not null").count()}

    def embed(self, images: DataFrame, model: str, fps: float | None = None, pooling: str = "mean", make=None) -> int:
        """Vectors of episodes that have none of the model yet; how many rows were added."""
        from tidewheel.operators.sampling import embed_episodes
        from tidewheel.session import materialize

        made = materialize(embed_episodes(images, model, fps, self.table("embeddings"), pooling, make=make), "vectors")
        if not (n := made.count()):
            return 0
        self.commit({"embeddings": made})
        return n

    def studio(self) -> DataFrame:
        """Every episode with its latest score and label, the best first, those without a score last."""
        scores = self.latest_quality().select("episode_id", "overall_score", "flags")
        labels = self.curation().select("episode_id", "label", "reason")
        return self.table("episodes").join(scores, "episode_id", "left").join(labels, "episode_id", "left").orderBy(F.desc_nulls_last("overall_score"), "episode_id")

    def label_counts(self) -> DataFrame:
        return self.curation().groupBy("label").agg(F.count("*").alias("episodes"))


def dup_losers(edges: DataFrame, quality: DataFrame, episodes: DataFrame, policy: str = "higher-quality", keep_similarity: bool = False) -> DataFrame:
    """The episode of each edge that its policy gives up; ties go against the greater id."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    # only what the policy looks at is joined to the edges
    value = {"higher-quality": F.coalesce("overall_score", F.lit(-1.0)), "longer": F.coalesce("num_frames", F.lit(0))}.get(policy, F.col("ingested_at"))
    about = (quality if policy == "higher-quality" else episodes).select("episode_id", value.alias("v"))
    x = edges
    for n in ("a", "b"):
        x = x.join(about.select(F.col("episode_id").alias(f"episode_{n}"), F.col("v").alias(f"v{n}")), f"episode_{n}", "left")
    a, b = F.col("episode_a"), F.col("episode_b")
    if policy == "first":
        la, lb = F.col("vb"), F.col("va")
    else:
        none = F.lit(-1.0 if policy == "higher-quality" else 0)
        la, lb = F.coalesce("va", none), F.coalesce("vb", none)
    loser = F.when(la > lb, b).when(lb > la, a).otherwise(F.greatest(a, b))
    out = x.select(loser.alias("episode_id"), *(["similarity"] if keep_similarity else []))
    return out.distinct()


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)
