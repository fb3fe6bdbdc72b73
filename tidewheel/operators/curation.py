"""Filtering, linting and statistics of episode tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class FilterRules:
    """Criteria of ``filter_episodes``; an empty one is not applied."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    min_quality: float | None = None
    exclude_flags: list[str] = field(default_factory=list)
    #: Bounds on video columns: name to (least, most); a missing value passes.
    video: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


def filter_episodes(episodes: DataFrame, scores: DataFrame | None, rules: FilterRules) -> DataFrame:
    """Adds ``reasons``, all criteria that an episode fails, and ``kept``.

    In this order: not on the include list, on the exclude list, then, where there is a
    quality row, its score (none is below any bound), flags and video bounds. Episodes
    without a quality row pass the latter.
    """
    x = episodes if scores is None else episodes.join(scores.withColumn("_scored", F.lit(True)), "episode_id", "left")
    scored = F.coalesce(F.col("_scored"), F.lit(False)) if scores is not None else F.lit(False)
    tests: list[tuple[str, Column]] = []
    if rules.include:
        tests.append(("not_included", ~F.col("episode_id").cast("string").isin(rules.include)))
    if rules.exclude:
        tests.append(("excluded", F.col("episode_id").cast("string").isin(rules.exclude)))
    if scores is not None:
        if rules.min_quality is not None:
            tests.append(("low_quality", scored & (F.col("overall_score").isNull() | (F.col("overall_score") < rules.min_quality))))
        for flag in rules.exclude_flags:
            tests.append((f"flag:{flag}", scored & F.array_contains("flags", flag)))
        for name, (least, most) in rules.video.items():
            if least is not None:
                tests.append((f"{name}<{least}", F.col(name) < least))
            if most is not None:
                tests.append((f"{name}>{most}", F.col(name) > most))
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests))) if tests else F.array().cast("array<string>")
    return x.withColumn("reasons", reasons).drop("_scored").withColumn("kept", F.size("reasons") == 0)


#: Phrases that say nothing, camera names that say no place, and bounds.
GENERIC_TASKS = ("task desc", "task description", "task", "hold", "up", "down", "do something", "n/a", "none", "test", "demo")
AMBIGUOUS_CAMERAS = ("laptop", "phone", "webcam", "cam", "camera", "image", "rgb", "default")
TASK_MIN_CHARS, TASK_MAX_CHARS = 25, 60
MIN_EPISODE_FRAMES = 3


def normal_task(task: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(task)), r"[.!]+$", ""))


def lint_episodes(episodes: DataFrame, task: str = "language_instruction", frames: str = "num_frames") -> DataFrame:
    """One row per issue of an episode: ``episode_id, code, severity``."""
    t = F.trim(F.coalesce(F.col(task), F.lit("")))
    rules = [
        ("task.missing", "warn", t == ""),
        ("task.generic", "warn", (t != "") & normal_task(t).isin(*GENERIC_TASKS)),
        ("task.too_short", "warn", (t != "") & ~normal_task(t).isin(*GENERIC_TASKS) & (F.length(t) < TASK_MIN_CHARS)),
        ("task.too_long", "info", F.length(t) > TASK_MAX_CHARS),
        ("episode.too_short", "error", F.col(frames) < MIN_EPISODE_FRAMES),
    ]
    issues = F.array_compact(F.array(*(F.when(w, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, w in rules)))
    return episodes.select("episode_id", F.explode(issues).alias("i")).select("episode_id", "i.code", "i.severity")


def lint_dataset(frames: DataFrame, columns: tuple[str, ...] = ("action", "state"), episodes: DataFrame | None = None, task: str = "language_instruction") -> DataFrame:
    """Dataset-wide issues: no frame at all, a column missing or of several widths, instructions missing in all or some episodes."""
    sizes = frames.agg(F.count("*").alias("n"), *(F.count_distinct(F.size(c)).alias(f"{c}_d") for c in columns), *(F.count(c).alias(f"{c}_n") for c in columns))
    rules = [("dataset.empty", "error", F.col("n") == 0)]
    for c in columns:
        rules += [(f"{c}.missing", "warn", (F.col("n") > 0) & (F.col(f"{c}_n") == 0)), (f"{c}.inconsistent_dim", "error", F.col(f"{c}_d") > 1)]
    if episodes is not None:
        said = episodes.agg(F.count("*").alias("_e"), F.count_if(F.trim(F.coalesce(F.col(task), F.lit(""))) != "").alias("_t"))
        sizes = sizes.crossJoin(said)  # one row each
        rules += [("task.missing", "warn", (F.col("_e") > 0) & (F.col("_t") == 0)), ("task.partial_coverage", "warn", (F.col("_t") > 0) & (F.col("_t") < F.col("_e")))]
    issues = F.array_compact(F.array(*(F.when(w, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, w in rules)))
    return sizes.select(F.explode(issues).alias("i")).select("i.*")


def lint_cameras(cameras: DataFrame, episodes: DataFrame | None = None, min_views: int = 2, min_width: int = 640, min_height: int = 480) -> DataFrame:
    """Camera issues ``episode_id, code, severity`` from rows ``episode_id, name, width, height``.

    A name is judged by what follows its last dot. With ``episodes``, those without any
    camera are named too. Episodes that differ in their cameras give one row without an id.
    """
    name = F.lower(F.element_at(F.split("name", r"\."), -1))
    per = cameras.select("episode_id", F.when(name.isin(*AMBIGUOUS_CAMERAS), "camera.ambiguous_name").alias("a"), F.when((F.col("width") < min_width) | (F.col("height") < min_height), "camera.low_resolution").alias("b"))
    one = per.select("episode_id", F.explode(F.array_compact(F.array("a", "b"))).alias("code")).distinct()
    views = cameras.groupBy("episode_id").agg(F.count_distinct("name").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
    found = one.unionByName(views.where(F.col("n") < min_views).select("episode_id", F.lit("camera.too_few_views").alias("code")))
    if episodes is not None:
        found = found.unionByName(episodes.join(views, "episode_id", "left_anti").select("episode_id", F.lit("camera.none").alias("code")))
    kind = cameras.schema["episode_id"].dataType.simpleString()
    differ = views.agg(F.count_distinct("names").alias("n")).where("n > 1").select(F.lit(None).cast(kind).alias("episode_id"), F.lit("camera.inconsistent_keys").alias("code"))
    mild = F.col("code").isin("camera.too_few_views", "camera.low_resolution")
    return found.unionByName(differ).withColumn("severity", F.when(mild, "info").otherwise("warn"))


def analysis_needed(rules: FilterRules, reader: dict[str, tuple[str, ...]]) -> set[str]:
    """Which costly analyses a filter needs: those of ``reader`` whose columns it bounds.

    Without a bound on any, none has to run. ``reader`` maps an analysis (pixels, motion) to
    its columns.
    """
    return {kind for kind, columns in reader.items() if any(c in rules.video and rules.video[c] != (None, None) for c in columns)}


def filter_with_analyses(episodes: DataFrame, scores: DataFrame | None, rules: FilterRules, analyses: dict[str, tuple[tuple[str, ...], Callable[[], DataFrame]]]) -> DataFrame:
    """``filter_episodes``, with the analyses that its bounds need, and no others.

    ``analyses`` maps a name to the columns that it gives and a function that makes
    them, a row an episode. Those that are needed are joined to the scores; an episode
    without a row of them has nulls, which pass.
    """
    wanted = analysis_needed(rules, {kind: columns for kind, (columns, _) in analyses.items()})
    found = scores
    for kind in sorted(wanted):
        columns, make = analyses[kind]
        made = make().select("episode_id", *columns)
        found = made if found is None else found.drop(*columns).join(made, "episode_id", "full")
    return filter_episodes(episodes, found, rules)


def dimension_stats(frames: DataFrame, column: str, key: list[str], first: int | None = None) -> DataFrame:
    """Least, most, mean and deviation (ddof 0) of each dimension; ``first`` frames of each episode only, if given."""
    x = frames.where(F.col("frame_index") < first) if first else frames
    x = x.select(*key, F.posexplode(column).alias("dim", "x"))
    return x.groupBy(*key, "dim").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))


def pooled_stats(stats: DataFrame) -> DataFrame:
    """Statistics of all episodes from those of each, without a second look at the frames."""
    n, m, s = F.col("count"), F.col("mean"), F.col("std")
    out = stats.groupBy("dim").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum(n).alias("count"), F.sum(n * m).alias("_m"), F.sum(n * (s * s + m * m)).alias("_q"))
    mean = F.col("_m") / F.col("count")
    return out.select("dim", "min", "max", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("count") - mean * mean)).alias("std"), "count")


def dataset_stats(episodes: DataFrame) -> DataFrame:
    return episodes.agg(
        F.count("*").alias("n_episodes"), F.sum("num_frames").alias("n_frames"), F.min("num_frames").alias("min_frames"), F.max("num_frames").alias("max_frames"),
        F.avg("num_frames").alias("mean_frames"), F.avg(F.col("language_instruction").isNotNull().cast("double")).alias("language_coverage"),
    )
