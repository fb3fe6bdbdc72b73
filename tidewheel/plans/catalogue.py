"""All queries over the standard tables, and the SQL that says the same.

The tables hold no robot episodes. Events of a user, in time order, stand for an
episode's frames (state, action and gripper derive from the event), users for
episodes, event types for topics, documents for catalog episodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.functions import vectors as V
from tidewheel.operators import action_tokens, curation, diagnostics, images, inspect, kernels, motion, quality, sampling, segment, temporal, video
from tidewheel.plans import functions
from tidewheel.plans.catalog import Catalog, dup_losers
from tidewheel.plans.relational import ORACLES as RELATIONAL_SQL
from tidewheel.plans.relational import QUERIES as RELATIONAL
from tidewheel.session import new_path
from tidewheel.sources import mcap, messages

FPS = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_id"),
        (F.row_number().over(w) - 1).cast("long").alias("frame_index"),
        ((micros() - F.first(micros()).over(w)) / F.lit(3.6e10)).alias("timestamp"),
        F.array(F.col("value"), F.log(1 + F.abs("value"))).alias("state"),
        F.array(F.floor(F.col("value") / 10).cast("double"), (F.col("event_id") % 7).cast("double")).alias("action"),
        (F.col("event_id") % 2).cast("double").alias("gripper"),
    )


def judged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by the last digit of their number: 1 keeps its own times, which have gaps; 3 steps back once, 5 has a
    state that is no number, 7 has three frames, 8 lacks an action; the others have a steady second a frame."""
    ep, i = F.col("episode_id") % 10, F.col("frame_index")
    t = F.when(ep == 1, F.col("timestamp")).when((ep == 3) & (i == 7), i - 1.5).otherwise(i.cast("double"))
    state = F.when((ep == 5) & (i == 4), F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.col("state"))
    action = F.when((ep == 8) & (i == 2), F.lit(None)).otherwise(F.col("action"))
    return frames(spark, sf_dir).where((ep != 7) | (i < 3)).withColumns({"timestamp": t, "state": state, "action": action})


_F = """f AS (SELECT user_id AS ep, row_number() OVER w - 1 AS i, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 3.6e10 AS t, value AS s0, ln(1 + abs(value)) AS s1,
  floor(value / 10) AS a0, CAST(event_id % 7 AS DOUBLE) AS a1, CAST(event_id % 2 AS DOUBLE) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_JF = _F.replace("f AS (", "f0 AS (", 1) + """, f AS (SELECT ep, i, CASE WHEN ep % 10 = 1 THEN t WHEN ep % 10 = 3 AND i = 7 THEN i - 1.5 ELSE CAST(i AS DOUBLE) END AS t,
  CASE WHEN ep % 10 = 5 AND i = 4 THEN CAST('nan' AS DOUBLE) ELSE s0 END AS s0, CASE WHEN ep % 10 = 5 AND i = 4 THEN 1.0 ELSE s1 END AS s1,
  CASE WHEN ep % 10 = 8 AND i = 2 THEN NULL ELSE a0 END AS a0, CASE WHEN ep % 10 = 8 AND i = 2 THEN NULL ELSE a1 END AS a1, g FROM f0 WHERE ep % 10 <> 7 OR i < 3)"""
_STATE = "x AS (SELECT ep, i, t, 0 AS dim, s0 AS x FROM f UNION ALL SELECT ep, i, t, 1, s1 FROM f)"
_ACTION = "x AS (SELECT ep, i, t, 0 AS dim, a0 AS x FROM f UNION ALL SELECT ep, i, t, 1, a1 FROM f)"
_W = "(PARTITION BY ep ORDER BY i)"
_STEP = f"""s AS (SELECT *, t - lag(t) OVER w AS dt, greatest(abs(s0 - lag(s0) OVER w), abs(s1 - lag(s1) OVER w)) AS ds,
  sqrt((s0 - lag(s0) OVER w) * (s0 - lag(s0) OVER w) + (s1 - lag(s1) OVER w) * (s1 - lag(s1) OVER w)) AS step,
  coalesce(abs(a0 - lag(a0) OVER w) <= 1e-6 AND abs(a1 - lag(a1) OVER w) <= 1e-6, false) AS held FROM f WINDOW w AS {_W}),
v AS (SELECT *, coalesce(dt > 0 AND dt <= 2.5, false) AS valid, CASE WHEN dt > 0 THEN ds / dt END AS speed FROM s)"""
_DEAD = f"""n AS (SELECT *, lag(a0) OVER w AS p0, lag(a1) OVER w AS p1, lead(a0) OVER w AS q0, lead(a1) OVER w AS q1 FROM f WINDOW w AS {_W}),
d AS (SELECT *, (abs(a0) < 1e-6 AND abs(a1) < 1e-6) OR coalesce(abs(a0 - p0) <= 1e-6 AND abs(a1 - p1) <= 1e-6, false) OR coalesce(abs(a0 - q0) <= 1e-6 AND abs(a1 - q1) <= 1e-6, false) AS dead FROM n)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep

# --- video: events of a user and type stand for a camera's frames, an hour for a second ---


def camera_frames(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    outcome = F.when(F.col("event_id") % 11 == 0, "missing").when(F.col("event_id") % 13 == 0, "invalid").otherwise("decoded")
    decoded = outcome == "decoded"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("episode_id"), F.col("event_type").alias("camera"),
        (F.row_number().over(w) - 1).cast("long").alias("frame_index"), ((micros() - F.min(micros()).over(w)) / F.lit(3.6e9)).alias("timestamp"), outcome.alias("outcome"),
        F.when(decoded, F.abs("value")).alias("sharpness"), F.when(decoded, F.col("event_id") % 200).cast("double").alias("brightness"),
        F.when(decoded, (F.col("event_id") % 17) / 50).alias("shadow_fraction"), F.when(decoded, (F.col("event_id") % 19) / 50).alias("highlight_fraction"),
        F.when(decoded, F.col("event_id") % 23).cast("double").alias("colourfulness"), F.when(decoded & (F.row_number().over(w) > 1), F.col("event_id") % 5 < 3).alias("frozen"),
    )


_CAM = """c0 AS (SELECT CAST(user_id AS VARCHAR) AS ep, event_type AS cam, event_id AS id, value, row_number() OVER w - 1 AS i, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 3.6e9 AS t,
  CASE WHEN event_id % 11 = 0 THEN 'missing' WHEN event_id % 13 = 0 THEN 'invalid' ELSE 'decoded' END AS o FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
c1 AS (SELECT *, t - lag(t) OVER (PARTITION BY ep, cam ORDER BY i) AS gap, o = 'decoded' AS ok, o = 'decoded' AND i > 0 AND id % 5 < 3 AS fz FROM c0),
c2 AS (SELECT *, CASE WHEN gap > 0 THEN gap END AS dt, CASE WHEN gap > 1.5 / 0.01 THEN greatest(0, CAST(round_even(gap * 0.01, 0) AS BIGINT) - 1) END AS lost, count(*) FILTER (ok AND NOT fz) OVER (PARTITION BY ep, cam ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c1)"""


@query(f"WITH {_CAM} SELECT ep AS episode_id, cam AS camera, i AS frame_index, round(dt, 6) AS gap_s, lost AS missing, lost >= 3 OR dt - 1 / 0.01 >= 0.2 - 1e-9 AS significant FROM c2 WHERE lost IS NOT NULL")
def video_frame_gaps(spark, sf_dir):
    return video.frame_gaps(camera_frames(spark, sf_dir), 0.01).withColumns({"gap_s": r6("gap_s"), "missing": F.col("missing").cast("long")})


@query(
    f"""WITH {_CAM}, r AS (SELECT ep, cam, run, count(*) FILTER (fz) AS n FROM c2 GROUP BY ALL), m AS (SELECT ep, cam, max(n) AS n FROM r GROUP BY ALL)
SELECT ep AS episode_id, cam AS camera, count(*) AS expected_frames, count(*) FILTER (o = 'missing') AS missing, count(*) FILTER (o = 'invalid') AS invalid, count(*) FILTER (ok) AS decoded,
  round(min(abs(value)) FILTER (ok), 6) AS min_sharpness, round(avg(CAST(abs(value) < 100 AS INT)) FILTER (ok), 6) AS blurry_fraction,
  round(avg(CAST((id % 19) / 50 > 0.2 AS INT)) FILTER (ok), 6) AS overexposed_fraction, round(avg(CAST((id % 17) / 50 > 0.2 OR id % 200 < 32 AS INT)) FILTER (ok), 6) AS underexposed_fraction,
  round(avg(CAST(fz AS INT)) FILTER (ok AND i > 0), 6) AS frozen_fraction, any_value(m.n) AS longest_frozen_run, CASE WHEN count(dt) > 0 THEN CAST(coalesce(sum(lost), 0) AS BIGINT) END AS dropped_frames
FROM c2 JOIN m USING (ep, cam) GROUP BY ep, cam"""
)
def video_camera_quality(spark, sf_dir):
    q = video.camera_quality(camera_frames(spark, sf_dir), 0.01)
    rounded = [r6(c).alias(c) for c in ("min_sharpness", "blurry_fraction", "overexposed_fraction", "underexposed_fraction", "frozen_fraction")]
    return q.select("episode_id", "camera", "expected_frames", "missing", "invalid", "decoded", *rounded, F.col("longest_frozen_run").cast("long").alias("longest_frozen_run"), F.col("dropped_frames").cast("long").alias("dropped_frames"))



@query(
    f"""WITH {_CAM}, r AS (SELECT ep, cam, run, count(*) FILTER (fz) AS n FROM c2 GROUP BY ALL), m AS (SELECT ep, cam, max(n) AS n FROM r GROUP BY ALL),
q AS (SELECT ep, cam, min(abs(value)) FILTER (ok) AS sh, avg(CAST(abs(value) < 100 AS INT)) FILTER (ok) AS bl, avg(CAST((id % 19) / 50 > 0.2 AS INT)) FILTER (ok) AS ov, any_value(m.n) AS fr FROM c2 JOIN m USING (ep, cam) GROUP BY ep, cam)
SELECT ep AS episode_id, count(*) AS cameras, round(min(sh), 6) AS min_sharpness, round(max(bl), 6) AS blurry_fraction, round(max(ov), 6) AS overexposed_fraction, CAST(max(fr) AS BIGINT) AS max_frozen_run FROM q GROUP BY ep"""
)
def video_rollup(spark, sf_dir):
    r = video.episode_rollup(video.camera_quality(camera_frames(spark, sf_dir), 0.01))
    return r.select("episode_id", "cameras", *(r6(c).alias(c) for c in ("min_sharpness", "blurry_fraction", "overexposed_fraction")), F.col("max_frozen_run").cast("long").alias("max_frozen_run"))


def _bytes(values: Column) -> Column:
    """An array of numbers of 0 to 255 as bytes."""
    return F.encode(F.array_join(F.transform(values, lambda v: F.char(v.cast("long"))), ""), "ISO-8859-1")


@query(
    """WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(least(greatest(128 + 300 * x::DOUBLE, 0), 255)) AS DOUBLE)) AS g, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings WHERE len(embedding) = 64),
y AS (SELECT *, list_transform(g, lambda v: v * 0.299 + v * 0.587 + v * 0.114) AS y FROM p),
l AS (SELECT *, list_transform(list_filter(range(1, 65), lambda k: (k - 1) % 8 BETWEEN 1 AND 6 AND k > 8 AND k <= 56), lambda k: y[k - 8] + y[k + 8] + y[k - 1] + y[k + 1] - 4 * y[k]) AS lap, lag(g) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM y)
SELECT vec_id, round(list_avg(y) + 1e-6, 3) AS brightness, round(len(list_filter(y, lambda v: v <= 4)) / 64 + 1e-6, 4) AS shadow_fraction, round(len(list_filter(y, lambda v: v >= 254)) / 64 + 1e-6, 4) AS highlight_fraction,
  round(list_var_pop(lap) + 1e-6, 2) AS sharpness, CASE WHEN b IS NOT NULL THEN list_avg(list_transform(range(1, 65), lambda k: abs(g[k] - b[k]))) < 0.1 END AS frozen FROM l"""
)
def pixel_measures(spark, sf_dir):
    """Vectors of 64 numbers as pictures of eight rows, those of a label as a camera's frames."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    grey = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(128 + 300 * x.cast("double"), F.lit(0)), F.lit(255))))
    x = images.measure_frames(e.select("vec_id", F.lit("table").alias("episode_id"), F.col("label").cast("string").alias("camera"), F.col("vec_id").alias("frame_index"), _bytes(grey).alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width")))
    near = lambda c, n: F.round(F.col(c) + 1e-6, n).alias(c)
    return x.select("vec_id", near("brightness", 3), near("shadow_fraction", 4), near("highlight_fraction", 4), near("sharpness", 2), "frozen")


@query()
def video_motion(spark, sf_dir):
    """Stripes that move with an event's value, sixteen rows of sixteen; dense flow can't be said in SQL."""
    x = camera_frames(spark, sf_dir)
    # a row's wave is the same but for a step from row to row
    wave = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: 128 + 60 * F.sin((k + F.col("sharpness") / 40) / 2.5))
    steps = F.array(*(50 * F.cos(F.lit(k) / 3) for k in range(16)))
    grey = F.transform(F.array(wave), lambda row: F.flatten(F.transform(steps, lambda step: F.transform(row, lambda v: F.floor(v + step)))))[0]
    frames_ = x.select("episode_id", "camera", "frame_index", "timestamp", F.when(F.col("outcome") == "decoded", _bytes(grey)).alias("pixels"), F.lit(16).alias("height"), F.lit(16).alias("width"))
    m = motion.camera_motion(frames_)
    return m.select("episode_id", "camera", *(r6(c).alias(c) for c in ("mean_motion", "scene_motion_fraction")), "cut_count")


_HASH = "CAST(user_id // 3 AS BIGINT) * 2862933555777 + CAST({k} AS BIGINT) * 40503"


@query(
    f"""WITH RECURSIVE u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT u.user_id AS ep, k, xor({_HASH.format(k="k")}, CAST(CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 7 END AS BIGINT)) AS h FROM u, range(0, 4) g(k)),
d AS (SELECT a.ep AS a, b.ep AS b, avg(bit_count(xor(a.h, b.h)) / 64) AS d FROM h a JOIN h b ON a.k = b.k AND a.ep < b.ep GROUP BY ALL), l AS (SELECT a, b FROM d WHERE d <= 0.1 UNION SELECT b, a FROM d WHERE d <= 0.1),
r(ep, to_ep) AS (SELECT user_id, user_id FROM u UNION SELECT r.ep, l.b FROM r JOIN l ON l.a = r.to_ep) SELECT ep AS episode_id, min(to_ep) AS representative, ep = min(to_ep) AS kept FROM r GROUP BY ep"""
)
def perceptual_duplicates(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("keyframe")
    x = u.select("user_id", k)
    flip = F.when(F.col("user_id") % 3 == 0, 0).when(F.col("user_id") % 3 == 1, 5).otherwise(7).cast("long")
    h = (F.floor(F.col("user_id") / 3).cast("long") * F.lit(2862933555777) + F.col("keyframe").cast("long") * 40503).bitwiseXOR(flip)
    return images.duplicate_clusters(x.select(F.col("user_id").alias("episode_id"), F.lit("top").alias("camera"), "keyframe", h.alias("hash")))


# --- multi-rate streams -------------------------------------------------------------------


def _streams(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", micros())
    first = e.where("event_type = 'view'").groupBy("user_id", "us").agg(F.max("value").alias("value"))
    return e.where("event_type = 'click'").select("user_id", "event_id", "us"), first


_V = "s AS (SELECT user_id, epoch_us(ts) AS us, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL), c AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click')"
_BRACKET = f"""WITH {_V}, e AS (SELECT user_id, arg_min(value, us) AS v, min(us) AS us FROM s GROUP BY user_id),
b AS (SELECT c.*, s.us AS t0, s.value AS v0 FROM c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.us >= s.us),
a AS (SELECT b.*, s.us AS t1, s.value AS v1 FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.us <= s.us)
"""


@query(_BRACKET + "SELECT a.user_id, event_id, coalesce(v0, v1) AS value, abs(a.us - coalesce(t0, t1)) AS skew FROM a")
def asof_hold(spark, sf_dir):
    primary, source = _streams(spark, sf_dir)
    return temporal.align(primary, source, ["user_id"], "us", "value", "hold").select("user_id", "event_id", "value", "skew")


_NEAR = "CASE WHEN t0 IS NULL THEN {b} WHEN t1 IS NULL THEN {a} WHEN us - t0 <= t1 - us THEN {a} ELSE {b} END"


@query(_BRACKET + f"SELECT user_id, event_id, {_NEAR.format(a='v0', b='v1')} AS value, abs(us - {_NEAR.format(a='t0', b='t1')}) AS skew FROM a")
def asof_nearest(spark, sf_dir):
    primary, source = _streams(spark, sf_dir)
    return temporal.align(primary, source, ["user_id"], "us", "value", "nearest").select("user_id", "event_id", "value", "skew")


@query(
    _BRACKET
    + f"SELECT user_id, event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = us THEN v0 ELSE v0 + (v1 - v0) * (CAST(us - t0 AS DOUBLE) / (t1 - t0)) END, 6) AS value, abs(us - {_NEAR.format(a='t0', b='t1')}) AS skew FROM a"
)
def asof_interpolate(spark, sf_dir):
    primary, source = _streams(spark, sf_dir)
    return temporal.align(primary, source, ["user_id"], "us", "value", "interpolate").select("user_id", "event_id", r6("value").alias("value"), "skew")


@query(_BRACKET + f", n AS (SELECT user_id, event_id, abs(us - {_NEAR.format(a='t0', b='t1')}) AS skew FROM a) SELECT user_id, event_id, skew > 3600000000 AS skewed FROM n WHERE skew <= 36000000000")
def drop_skewed(spark, sf_dir):
    primary, source = _streams(spark, sf_dir)
    near = temporal.align(primary, source, ["user_id"], "us", "value", "nearest")
    return temporal.drop_skewed(near, 3_600_000_000).select("user_id", "event_id", "skewed")


@query("SELECT event_type AS topic, count(*) AS n_messages FROM events GROUP BY event_type ORDER BY 2 DESC, 1 LIMIT 1")
def primary_topic(spark, sf_dir):
    return temporal.primary_topic(table(spark, sf_dir, "events").withColumnRenamed("event_type", "topic"))


@query(
    "WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), c AS (SELECT *, CASE WHEN us - lag(us) OVER w > 86400000000 THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) "
    "SELECT event_id, user_id, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS episode FROM c"
)
def split_time_gap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", micros())
    return temporal.split_time_gap(e, ["user_id"], "us", 86_400_000_000, ["event_id"]).select("event_id", "user_id", "episode")


@query(
    "WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type <> 'error'), m AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM e), "
    "c AS (SELECT user_id, min(n) AS n FROM (SELECT m.user_id, m.us, min(r.n) AS n FROM m JOIN r ON r.user_id = m.user_id AND r.us >= m.us GROUP BY ALL) GROUP BY user_id, n HAVING min(n) > 1) "
    "SELECT r.event_id, r.user_id, (SELECT count(*) FROM c WHERE c.user_id = r.user_id AND c.n <= r.n) AS episode FROM r"
)
def split_marker(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", micros())
    return temporal.split_marker(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), ["user_id"], "us", ["event_id"]).select("event_id", "user_id", "episode")


@query(
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events) SELECT event_id, user_id, event_type FROM n WHERE n > 2 AND c - 2 >= 10"
)
def post_filters(spark, sf_dir):
    return temporal.post_filter(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], 2, 10).select("event_id", "user_id", "event_type")


# --- quality metrics ----------------------------------------------------------------------


@query(f"WITH {_F}, {_DEAD} SELECT ep AS episode_id, round(avg(CASE WHEN dead THEN 1.0 ELSE 0.0 END), 6) AS dead_fraction, count(*) FILTER (dead) AS n_dead FROM d GROUP BY ep")
def dead_actions(spark, sf_dir):
    return quality.dead_actions(frames(spark, sf_dir)).withColumn("dead_fraction", r6("dead_fraction"))


@query(f'WITH {_F}, {_DEAD}, g AS (SELECT ep, i, i - row_number() OVER {_W} AS k FROM d WHERE dead) SELECT ep AS episode_id, min(i) AS start, max(i) + 1 AS "end" FROM g GROUP BY ep, k')
def dead_runs(spark, sf_dir):
    return quality.dead_runs(frames(spark, sf_dir))


@query(f"WITH {_F}, {_STEP} SELECT ep AS episode_id, round(coalesce(sum(step), 0), 6) AS joint_path_length FROM v GROUP BY ep")
def path_length(spark, sf_dir):
    return quality.path_length(frames(spark, sf_dir)).withColumn("joint_path_length", r6("joint_path_length"))


@query(
    f"WITH {_F}, b AS (SELECT *, min(g) OVER (PARTITION BY ep) AS lo, max(g) OVER (PARTITION BY ep) AS hi FROM f), o AS (SELECT *, g > (lo + hi) / 2 AS up FROM b), "
    f"n AS (SELECT ep, t, hi - lo >= 1e-6 AND up <> lag(up) OVER {_W} AS turn FROM o), a AS (SELECT ep, count(*) FILTER (turn) AS n, max(t) - min(t) AS span FROM n GROUP BY ep) "
    "SELECT ep AS episode_id, n AS n_transitions, round(n / greatest(span, 1e-6), 6) AS gripper_chatter_rate, n / greatest(span, 1e-6) > 2.0 AS chattery FROM a"
)
def gripper_chatter(spark, sf_dir):
    return quality.gripper_chatter(frames(spark, sf_dir), F.col("gripper")).withColumn("gripper_chatter_rate", r6("gripper_chatter_rate"))


_TIME = f"y AS (SELECT ep, avg(dt) AS m, coalesce(stddev_pop(dt), 0) AS sd, count(*) FILTER (dt > 2) AS n FROM (SELECT ep, t - lag(t) OVER {_W} AS dt FROM f) GROUP BY ep)"


@query(
    f"WITH {_F}, {_TIME} SELECT ep AS episode_id, round(m, 6) AS dt_mean, round(sd, 6) AS dt_std, n AS n_gaps, round(sd / greatest(m, 1e-10), 6) AS jitter_ratio, round(CASE WHEN m > 0 THEN 1 / m ELSE 0 END, 6) AS effective_fps FROM y"
)
def timestamp_regularity(spark, sf_dir):
    x = quality.timestamp_regularity(frames(spark, sf_dir), FPS)
    return x.withColumns({c: r6(c) for c in ("dt_mean", "dt_std", "jitter_ratio", "effective_fps")})


_SAT = """b AS (SELECT *, {lo} AS lo, {hi} AS hi FROM x WINDOW p AS (PARTITION BY ep, dim)),
z AS (SELECT ep, dim, avg(CASE WHEN x <= lo + (hi - lo) * 0.05 OR x >= hi - (hi - lo) * 0.05 THEN 1.0 ELSE 0.0 END) AS fr, max(hi - lo) AS r FROM b GROUP BY ep, dim),
sat AS (SELECT ep, coalesce(avg(fr) FILTER (r > 1e-10), 0) AS o, count(*) FILTER (r > 1e-10 AND fr > 0.05) AS n FROM z GROUP BY ep)"""
_RANGE, _GIVEN = _SAT.format(lo="min(x) OVER p", hi="max(x) OVER p"), _SAT.format(lo="CASE dim WHEN 0 THEN -20.0 ELSE 0.0 END", hi="CASE dim WHEN 0 THEN 20.0 ELSE 6.0 END")
LIMITS = ((-20.0, 20.0), (0.0, 6.0))


@query(f"WITH {_F}, {_ACTION}, {_GIVEN} SELECT ep AS episode_id, round(o, 6) AS overall_saturation, n AS n_saturated_dims FROM sat")
def action_saturation(spark, sf_dir):
    x = quality.action_saturation(frames(spark, sf_dir), limits=LIMITS)
    return x.select("episode_id", r6("overall_saturation").alias("overall_saturation"), "n_saturated_dims")


@query(f"WITH {_F}, {_ACTION}, {_RANGE} SELECT ep AS episode_id, CAST(NULL AS DOUBLE) AS overall_saturation, round(o, 6) AS observed_range_edge_fraction FROM sat")
def action_range_edges(spark, sf_dir):
    x = quality.action_saturation(frames(spark, sf_dir))
    return x.select("episode_id", "overall_saturation", r6("observed_range_edge_fraction").alias("observed_range_edge_fraction"))


_ENT = """eb AS (SELECT *, min(x) OVER p AS lo, max(x) OVER p AS hi, count(*) OVER p AS n FROM x WINDOW p AS (PARTITION BY ep, dim)),
ek AS (SELECT ep, dim, n, greatest(ceil(log2(n) + 1), 2) AS bins, CASE WHEN hi - lo < 1e-10 THEN 0 ELSE least(floor((x - lo) * greatest(ceil(log2(n) + 1), 2) / (hi - lo)), greatest(ceil(log2(n) + 1), 2) - 1) END AS k FROM eb),
ec AS (SELECT ep, dim, n, bins, k, count(*) AS c FROM ek GROUP BY ALL),
eh AS (SELECT ep, dim, sum(-(CAST(c AS DOUBLE) / n) * log2(CAST(c AS DOUBLE) / n)) / max(log2(bins)) AS h FROM ec GROUP BY ep, dim),
ent AS (SELECT ep, avg(h) AS h FROM eh GROUP BY ep)"""


@query(f"WITH {_F}, {_ACTION}, {_ENT} SELECT ep AS episode_id, round(h, 6) AS mean_entropy FROM ent")
def action_entropy(spark, sf_dir):
    return quality.action_entropy(frames(spark, sf_dir)).withColumn("mean_entropy", r6("mean_entropy"))


def _grad(x: str, new: str) -> str:
    p = "(PARTITION BY ep, dim ORDER BY i)"
    return f"CASE WHEN lag({x}) OVER {p} IS NULL THEN lead({x}) OVER {p} - {x} WHEN lead({x}) OVER {p} IS NULL THEN {x} - lag({x}) OVER {p} ELSE (lead({x}) OVER {p} - lag({x}) OVER {p}) / 2 END AS {new}"


_LDLJ = f"""g1 AS (SELECT *, {_grad("x", "v")} FROM xs), g2 AS (SELECT *, {_grad("v", "a")} FROM g1), g3 AS (SELECT *, {_grad("a", "j")} FROM g2),
pf AS (SELECT ep, i, sqrt(sum(v * v)) AS speed, sum(j * j) AS jerk FROM g3 GROUP BY ep, i), pe AS (SELECT ep, count(*) AS n, max(speed) AS peak, sum(jerk) AS jerk FROM pf GROUP BY ep),
lj AS (SELECT ep, CASE WHEN n >= 4 AND peak >= 1e-10 THEN -ln(greatest(CAST((n - 1) * (n - 1) * (n - 1) AS DOUBLE) / (peak * peak) * jerk, 1e-10)) END AS ldlj FROM pe)"""
_XS = _STATE.replace("x AS (", "xs AS (", 1)


@query(f"WITH {_F}, {_XS}, {_LDLJ} SELECT ep AS episode_id, round(ldlj, 6) AS ldlj FROM lj")
def ldlj(spark, sf_dir):
    return quality.ldlj(frames(spark, sf_dir), FPS).withColumn("ldlj", r6("ldlj"))


_STATIC = """sl AS (SELECT *, coalesce(valid AND speed <= 1e-3, false) AS slow FROM v), si AS (SELECT *, i - row_number() OVER (PARTITION BY ep, slow ORDER BY i) AS isl FROM sl),
sp AS (SELECT ep, max(t) - min(t - dt) AS d FROM si WHERE slow GROUP BY ep, isl HAVING max(t) - min(t - dt) + 1e-9 >= 0.5), sd AS (SELECT ep, sum(d) AS d FROM sp GROUP BY ep),
ob AS (SELECT ep, sum(CASE WHEN valid THEN dt ELSE 0 END) AS seen FROM v GROUP BY ep), st AS (SELECT ep, CASE WHEN seen > 0 THEN coalesce(d, 0) / seen ELSE 0 END AS fr FROM ob LEFT JOIN sd USING (ep))"""


@query(f"WITH {_F}, {_STEP}, {_STATIC} SELECT ep AS episode_id, round(fr, 6) AS static_fraction FROM st")
def static_fraction(spark, sf_dir):
    return diagnostics.static_fraction(frames(spark, sf_dir), FPS).withColumn("static_fraction", r6("static_fraction"))


def _composite(limits: str | None) -> str:
    sat = "CAST(NULL AS DOUBLE)" if limits is None else "o"
    return f"""WITH {_JF}, ck AS (SELECT ep, count(*) AS n, count(a0) < count(*) AS na, coalesce(bool_or(isnan(s0)), false) AS ns, coalesce(bool_or(back), false) AS back
  FROM (SELECT *, t <= lag(t) OVER {_W} AS back FROM f) GROUP BY ep),
{_DEAD}, dd AS (SELECT ep, avg(CASE WHEN dead THEN 1.0 ELSE 0.0 END) AS dead FROM d GROUP BY ep),
tn AS (SELECT *, g > (min(g) OVER (PARTITION BY ep) + max(g) OVER (PARTITION BY ep)) / 2 AS up, max(g) OVER (PARTITION BY ep) - min(g) OVER (PARTITION BY ep) AS sw FROM f),
tu AS (SELECT *, sw >= 1e-6 AND up <> lag(up) OVER {_W} AS turn FROM tn), gr AS (SELECT ep, count(*) FILTER (turn) / greatest(max(t) - min(t), 1e-6) AS rate FROM tu GROUP BY ep),
{_ACTION}, {limits or _RANGE}, {_ENT}, {_XS}, {_LDLJ}, {_TIME}, {_STEP}, {_STATIC},
m0 AS (SELECT ck.*, dead, rate, ldlj, sd / greatest(m, 1e-10) AS jit, y.n AS gaps, 1 / m AS fps, {sat} AS sat, fr AS static, h, na OR ns AS bad, ck.n < 5 AS short
  FROM ck JOIN dd USING (ep) JOIN gr USING (ep) JOIN lj USING (ep) JOIN y USING (ep) JOIN sat USING (ep) JOIN st USING (ep) JOIN ent USING (ep)),
m1 AS (SELECT *, NOT bad AND NOT short AND NOT back AS ok, gaps = 0 AND jit <= 0.1 AS steady FROM m0), m AS (SELECT *, CASE WHEN ok AND steady THEN ldlj END AS lj FROM m1)
SELECT ep AS episode_id, CASE WHEN ok AND steady AND lj IS NOT NULL THEN round(10 * (0.15 * (1 - dead) + 0.25 / (1 + exp(-(lj + 18) / 4)) + 0.15 * CASE WHEN rate > 2 THEN greatest(0, 1 - rate / 5) ELSE 1 END
  + 0.10 * CASE WHEN jit < 0.1 THEN 1 ELSE greatest(0, 1 - jit) END + coalesce(0.10 * (1 - sat), 0) + 0.15 * (1 - static) + 0.10 * greatest(0, 1 - abs(h - 0.7) / 0.3)) / (0.90 + CASE WHEN sat IS NULL THEN 0 ELSE 0.10 END), 6) END AS overall_score,
  concat_ws(',', CASE WHEN na THEN 'nan_in_actions' END, CASE WHEN ns THEN 'nan_in_states' END, CASE WHEN NOT bad AND NOT short AND back THEN 'invalid_timestamps' END, CASE WHEN ok AND gaps > 0 THEN 'timestamp_gaps' END,
  CASE WHEN ok AND abs(fps / 1.0 - 1) > 0.1 THEN 'sample_rate_mismatch' END, CASE WHEN ok AND dead > 0.10 THEN 'dead_actions' END, CASE WHEN lj < -25 THEN 'jerky' END, CASE WHEN ok AND rate > 2 THEN 'gripper_chatter' END,
  CASE WHEN ok AND jit > 0.1 THEN 'timestamp_jitter' END, CASE WHEN ok AND sat > 0.30 THEN 'saturated' END, CASE WHEN ok AND static > 0.50 THEN 'mostly_static' END,
  CASE WHEN ok AND h < 0.20 THEN 'low_entropy' END, CASE WHEN ok AND h > 0.95 THEN 'high_entropy' END) AS flags,
  CASE WHEN bad THEN 'invalid input' WHEN short THEN 'too few frames' WHEN back THEN 'times do not increase' WHEN NOT steady THEN 'irregular times' WHEN lj IS NULL THEN 'no motion to judge' ELSE 'scored' END AS status FROM m"""


def _scored(spark, sf_dir, limits=None, stretch_rows=None):
    return quality.episode_metrics(judged_frames(spark, sf_dir), FPS, F.col("gripper"), limits, stretch_rows=stretch_rows)


@query(_composite(None))
def composite_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("episode_id", r6("overall_score").alias("overall_score"), F.concat_ws(",", "flags").alias("flags"), "status")


@query(_composite(None))
def stretched_score(spark, sf_dir):
    """The same rows, episodes cut into stretches of sixteen frames."""
    return _scored(spark, sf_dir, stretch_rows=16).select("episode_id", r6("overall_score").alias("overall_score"), F.concat_ws(",", "flags").alias("flags"), "status")


@query(_composite(_GIVEN))
def composite_score_with_limits(spark, sf_dir):
    return _scored(spark, sf_dir, LIMITS).select("episode_id", r6("overall_score").alias("overall_score"), F.concat_ws(",", "flags").alias("flags"), "status")


@query(f"WITH s AS ({_composite(None)}), u AS (SELECT unnest(string_split(flags, ',')) AS flag FROM s WHERE flags <> '') SELECT flag, count(*) AS n_episodes FROM u GROUP BY flag")
def flag_report(spark, sf_dir):
    return quality.dataset_report(_scored(spark, sf_dir)).select("flag", "n_episodes")


_STALL = f"""WITH {_F}, {_STEP}, gp AS (SELECT *, sum(CASE WHEN dt IS NOT NULL AND NOT valid THEN 1 ELSE 0 END) OVER {_W} AS gap FROM v),
tk AS (SELECT a.ep, a.i, a.t, a.dt, a.valid, a.s1, CASE WHEN b.gap = a.gap THEN abs(b.a1 - a.s1) END AS r FROM gp a ASOF LEFT JOIN gp b ON a.ep = b.ep AND a.t - 0.5 >= b.t),
tr AS (SELECT *, coalesce(valid AND r IS NOT NULL AND lag(r) OVER {_W} IS NOT NULL, false) AS sup, abs(s1 - lag(s1) OVER {_W}) / CASE WHEN dt > 0 THEN dt END AS sp, least(r, lag(r) OVER {_W}) AS lr FROM tk),
ts AS (SELECT *, coalesce(sup AND sp <= 1e-3 AND lr > 0.05, false) AS stall FROM tr), ti AS (SELECT *, i - row_number() OVER (PARTITION BY ep, stall ORDER BY i) AS isl FROM ts),
te AS (SELECT ep, max(t) - min(t - dt) AS d FROM ti WHERE stall GROUP BY ep, isl HAVING max(t) - min(t - dt) + 1e-9 >= 0.1), td AS (SELECT ep, sum(d) AS d FROM te GROUP BY ep)
SELECT ts.ep AS episode_id, round(avg(r), 6) AS tracking_mean, round(quantile_cont(r, 0.95), 6) AS tracking_p95, round(CASE WHEN sum(CASE WHEN sup THEN dt ELSE 0 END) > 0 THEN coalesce(any_value(td.d), 0) / sum(CASE WHEN sup THEN dt ELSE 0 END) END, 6) AS stall_fraction
FROM ts LEFT JOIN td ON td.ep = ts.ep GROUP BY ts.ep"""


@query(_STALL)
def tracking_stall(spark, sf_dir):
    x, _ = diagnostics.tracking(frames(spark, sf_dir), FPS, [(1, 1)], 0.5, min_seconds=0.1)
    return x.select("episode_id", *(r6(n).alias(n) for n in ("tracking_mean", "tracking_p95", "stall_fraction")))


def timed_frames(spark, sf_dir):
    """Twenty frames a second, whatever the events' times."""
    return frames(spark, sf_dir).withColumn("timestamp", F.col("frame_index") / 20.0)


@query(
    f"""WITH {_F} SELECT CAST(ep AS VARCHAR) AS episode, count(*) AS n_actions, round(min(i / 20.0), 6) AS first_s, round(sum(a0 + a1), 3) AS total FROM f WHERE i / 20.0 >= 0.5 AND i / 20.0 < 2.0 GROUP BY ep"""
)
def log_roundtrip(spark, sf_dir):
    """Episodes written as indexed logs, their action topics read back between half a second and two by chunk."""
    x = timed_frames(spark, sf_dir).withColumn("episode_id", F.lpad(F.col("episode_id").cast("string"), 12, "0"))
    path = new_path(spark, "logs")
    messages.write_episodes(x, x.select("episode_id", F.col("episode_id").alias("language_instruction")).distinct(), path)
    read = mcap.read(spark, path, "fields", topics=None).where((F.col("ts_ns") >= 500_000_000) & (F.col("ts_ns") < 2_000_000_000) & F.col("topic").startswith("/action/"))
    named = mcap.read(spark, path, "fields").where(F.col("topic").startswith("/task/")).select(F.regexp_extract("topic", messages.SUFFIX, 1).alias("k"), F.col("text").cast("long").cast("string").alias("episode"))
    total = F.aggregate("value", F.lit(0.0), lambda s, v: s + v)
    out = read.groupBy(F.regexp_extract("topic", messages.SUFFIX, 1).alias("k")).agg(F.count("*").alias("n_actions"), r6(F.min("ts_ns") / F.lit(1e9)).alias("first_s"), F.round(F.sum(total), 3).alias("total"))
    return out.join(named, "k").drop("k")


@query()
def episode_kernels(spark, sf_dir):
    return kernels.episode_kernels(timed_frames(spark, sf_dir), 20.0)


@query(
    f"""WITH {_F}, {_ACTION}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY ep, dim) AS y, count(*) OVER (PARTITION BY ep, dim) AS n FROM x),
w AS (SELECT ep, dim, n, k, pow(sum(y * cos(2 * pi() * k * i / n)), 2) + pow(sum(y * sin(2 * pi() * k * i / n)), 2) AS p FROM c, range(0, 100000) r(k) WHERE k <= n // 2 AND n >= 4 GROUP BY ALL),
s AS (SELECT ep, dim, sum(p) AS t, sum(CASE WHEN k * 20.0 / n <= 2 THEN p ELSE 0 END) AS lo, sum(CASE WHEN k * 20.0 / n > 8 THEN p ELSE 0 END) AS hi FROM w GROUP BY ep, dim)
SELECT ep AS episode_id, round(avg(CASE WHEN t > 1e-18 THEN lo / t ELSE 0 END), 5) AS psd_low, round(avg(CASE WHEN t > 1e-18 THEN (t - lo - hi) / t ELSE 0 END), 5) AS psd_mid, round(avg(CASE WHEN t > 1e-18 THEN hi / t ELSE 0 END), 5) AS psd_high FROM s GROUP BY ep"""
)
def action_spectrum(spark, sf_dir):
    x = kernels.episode_kernels(timed_frames(spark, sf_dir), 20.0)
    return x.select("episode_id", *(F.round(c, 5).alias(c) for c in ("psd_low", "psd_mid", "psd_high")))


@query(
    f"""WITH {_F}, d AS (SELECT a.ep, a.i, b.a0, b.a1, row_number() OVER (PARTITION BY a.ep, a.i ORDER BY (a.s0 - b.s0) * (a.s0 - b.s0) + (a.s1 - b.s1) * (a.s1 - b.s1), b.i) AS r FROM f a JOIN f b ON a.ep = b.ep AND a.i <> b.i),
v AS (SELECT ep, i, (var_pop(a0) + var_pop(a1)) / 2 AS v FROM d WHERE r <= 5 GROUP BY ep, i), n AS (SELECT ep, count(*) AS n FROM f GROUP BY ep)
SELECT n.ep AS episode_id, CASE WHEN n >= 7 THEN round(avg(v) + 1e-9, 5) END AS variance FROM n LEFT JOIN v ON v.ep = n.ep GROUP BY n.ep, n"""
)
def state_conditioned_variance(spark, sf_dir):
    x = kernels.episode_kernels(timed_frames(spark, sf_dir), 20.0)
    # means of multiples of 1/50 may lie on a border of rounding, which sums in another order would cross
    return x.select("episode_id", F.round(F.col("neighbour_variance") + 1e-9, 5).alias("variance"))


@query(
    f"""WITH {_F}, g AS (SELECT ep, i, CASE WHEN lag(s0) OVER w IS NULL THEN (lead(s0) OVER w - s0) / 0.05 WHEN lead(s0) OVER w IS NULL THEN (s0 - lag(s0) OVER w) / 0.05 ELSE (lead(s0) OVER w - lag(s0) OVER w) / 0.1 END AS g0,
  CASE WHEN lag(s1) OVER w IS NULL THEN (lead(s1) OVER w - s1) / 0.05 WHEN lead(s1) OVER w IS NULL THEN (s1 - lag(s1) OVER w) / 0.05 ELSE (lead(s1) OVER w - lag(s1) OVER w) / 0.1 END AS g1 FROM f WINDOW w AS {_W}),
v AS (SELECT ep, i, sqrt(g0 * g0 + g1 * g1) AS v, sum(sqrt(g0 * g0 + g1 * g1)) OVER (PARTITION BY ep) AS total, count(*) OVER (PARTITION BY ep) AS n FROM g),
b AS (SELECT ep, i, v, total, CAST(pow(2, ceil(log2(n)) + 4) AS BIGINT) AS m FROM v WHERE n >= 4),
a AS (SELECT ep, m, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / m)), 2) + pow(sum(v * sin(2 * pi() * k * i / m)), 2)) / any_value(total) AS a, k * 20.0 / m AS freq FROM b, range(0, 1000000) r(k) WHERE k <= m // 2 GROUP BY ep, m, k),
t AS (SELECT ep, least(max(freq) FILTER (a >= 0.05), 10.0) AS top FROM a GROUP BY ep),
d AS (SELECT ep, sqrt(pow((freq - lag(freq) OVER p) / top, 2) + pow(a - lag(a) OVER p, 2)) AS d FROM a JOIN t USING (ep) WHERE freq <= top AND top > 0 WINDOW p AS (PARTITION BY ep ORDER BY k)),
o AS (SELECT ep, -sum(d) AS s FROM d GROUP BY ep)
SELECT u.ep AS episode_id, round(o.s, 5) AS sparc FROM (SELECT DISTINCT ep FROM f) u LEFT JOIN o ON o.ep = u.ep"""
)
def motion_smoothness(spark, sf_dir):
    """Spectral arc length of each episode; the SQL adds up the spectrum term by term."""
    x = kernels.episode_kernels(timed_frames(spark, sf_dir), 20.0)
    return x.select("episode_id", F.round("sparc", 5).alias("sparc"))


# --- diagnostics --------------------------------------------------------------------------

_EVENT = "SELECT ep AS episode_id, '{k}' AS kind, min(i) - 1 AS start, max(i) + 1 AS \"end\", round(min(t - dt), 6) AS start_time, round(max(t), 6) AS end_time FROM (SELECT *, i - row_number() OVER (PARTITION BY ep ORDER BY i) AS isl FROM v WHERE {w}) GROUP BY ep, isl HAVING max(t) - min(t - dt) + 1e-9 >= {m}"


@query(
    f"WITH {_F}, {_STEP} "
    + " UNION ALL ".join(_EVENT.format(k=k, w=w, m=m) for k, w, m in (("timestamp_gap", "dt IS NOT NULL AND NOT valid", 0), ("held_command", "held AND valid", 0.5), ("motion_pause", "speed <= 1e-3 AND valid", 0.5)))
)
def proprio_events(spark, sf_dir):
    x = diagnostics.proprio_events(frames(spark, sf_dir), FPS)
    return x.withColumns({c: r6(c) for c in ("start_time", "end_time")})


@query(ORACLES["proprio_events"])
def stretched_events(spark, sf_dir):
    """The same events, episodes cut into stretches of sixteen frames."""
    x = diagnostics.proprio_events(frames(spark, sf_dir), FPS, stretch_rows=16)
    return x.withColumns({c: r6(c) for c in ("start_time", "end_time")})


@query(ORACLES["proprio_events"])
def quality_events(spark, sf_dir):
    """The same events by the table function."""
    functions.register(spark)
    frames(spark, sf_dir).createOrReplaceTempView("quality_frames")
    x = spark.sql(f"SELECT * FROM quality_events(TABLE(quality_frames) PARTITION BY episode_id ORDER BY (frame_index), fps => {FPS}D)")
    return x.withColumns({c: r6(c) for c in ("start_time", "end_time")})


@query(
    f"WITH {_F}, {_STEP} SELECT ep AS episode_id, round(sum(CASE WHEN valid THEN dt ELSE 0 END), 6) AS valid_duration_s, round(sum(CASE WHEN valid THEN dt ELSE 0 END) / nullif(max(t) - min(t), 0), 6) AS time_coverage, "
    "round(sum(CASE WHEN valid THEN step ELSE 0 END), 6) AS path_length FROM v GROUP BY ep"
)
def time_coverage(spark, sf_dir):
    x = diagnostics.time_coverage(frames(spark, sf_dir), FPS)
    return x.select("episode_id", *(r6(c).alias(c) for c in ("valid_duration_s", "time_coverage", "path_length")))


_REV = f"""WITH {_F}, {_STATE}, q AS (SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS d FROM x WINDOW w AS (PARTITION BY ep, dim ORDER BY i)),
k AS (SELECT *, dt > 0 AND dt <= 2.5 AS ok FROM q WHERE dt IS NOT NULL), s AS (SELECT *, CASE WHEN ok AND abs(d) > 1e-3 * dt THEN sign(d) ELSE 0 END AS sg, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY ep, dim ORDER BY i) AS gap FROM k),
c AS (SELECT *, CASE WHEN sg <> lag(sg) OVER w OR gap <> lag(gap) OVER w THEN 1 ELSE 0 END AS ch FROM s WINDOW w AS (PARTITION BY ep, dim ORDER BY i)), r AS (SELECT *, sum(ch) OVER (PARTITION BY ep, dim ORDER BY i) AS run FROM c),
l AS (SELECT ep, dim, gap, run, sg, sum(dt) AS s FROM r GROUP BY ALL HAVING sg <> 0 AND sum(dt) + 1e-9 >= 0.1), z AS (SELECT ep, dim, CASE WHEN sg <> lag(sg) OVER (PARTITION BY ep, dim, gap ORDER BY run) THEN 1 ELSE 0 END AS fl FROM l)
SELECT ep AS episode_id, dim, CAST(sum(fl) AS BIGINT) AS n_reversals FROM z GROUP BY ep, dim"""


@query(_REV)
def direction_reversals(spark, sf_dir):
    return diagnostics.direction_reversals(frames(spark, sf_dir), FPS)


@query(
    f"WITH {_F}, e AS (SELECT a.ep, greatest(abs(a.s0 - b.a0), abs(a.s1 - b.a1)) AS e FROM f a ASOF JOIN f b ON a.ep = b.ep AND a.t - 1.0 >= b.t) SELECT ep AS episode_id, round(avg(e), 6) AS tracking_mean, round(quantile_cont(e, 0.95), 6) AS tracking_p95 FROM e GROUP BY ep"
)
def tracking_error(spark, sf_dir):
    x = diagnostics.tracking_error(frames(spark, sf_dir), 1.0)
    return x.select("episode_id", r6("tracking_mean").alias("tracking_mean"), r6("tracking_p95").alias("tracking_p95"))


# --- segments and tokens ------------------------------------------------------------------


@query()
def pelt_segments(spark, sf_dir):
    return segment.segment_episodes(frames(spark, sf_dir))


_PHASE = f"""WITH {_F}, {_STEP}, u AS (SELECT *, coalesce(step, 0) AS sp, i // 10 AS seg FROM v),
lim AS (SELECT ep, CASE WHEN count(*) FILTER (sp > 1e-8) < 5 THEN 1e-6 ELSE quantile_cont(sp, 0.2) FILTER (sp > 1e-8) END AS lo, CASE WHEN count(*) FILTER (sp > 1e-8) < 5 THEN 1e-3 ELSE quantile_cont(sp, 0.7) FILTER (sp > 1e-8) END AS hi FROM u GROUP BY ep),
per AS (SELECT ep, seg, avg(sp) AS m, stddev_pop(sp) AS sd, avg(g) AS gm, arg_max(g, i) - arg_min(g, i) AS gd FROM u GROUP BY ep, seg),
lab AS (SELECT per.*, hi, CASE WHEN m < lo AND abs(gd) < 0.15 THEN 'idle' WHEN gd < -0.15 THEN 'grasping' WHEN gd > 0.15 THEN 'placing' WHEN (m > lo OR m >= hi) AND gm < 0.5 THEN 'transporting' WHEN m > lo OR m >= hi THEN 'reaching' WHEN sd < lo THEN 'fine_manipulation' ELSE 'unknown' END AS l FROM per JOIN lim USING (ep))
SELECT ep AS episode_id, seg AS segment, CASE WHEN lag(l) OVER (PARTITION BY ep ORDER BY seg) = 'placing' AND m >= hi AND l IN ('reaching', 'moving', 'unknown') THEN 'retracting' ELSE l END AS label FROM lab"""


@query(_PHASE)
def phase_labels(spark, sf_dir):
    x = frames(spark, sf_dir)
    pieces = x.groupBy("episode_id", F.floor(F.col("frame_index") / 10).cast("long").alias("segment")).agg(F.min("frame_index").alias("start"), (F.max("frame_index") + 1).alias("end"))
    return segment.label_phases(x, pieces, "state", "gripper").select("episode_id", "segment", "label")


@query(f"WITH {_F}, s AS (SELECT ep, count(DISTINCT i // 10) AS n FROM f GROUP BY ep) SELECT round(avg(n), 6) AS mean_segments, min(n) AS min_segments, max(n) AS max_segments, CAST(sum(n - 1) AS BIGINT) AS total_changepoints, list_sort(list(n))[count(*) // 2 + 1] AS median_segments FROM s")
def segment_summary(spark, sf_dir):
    pieces = frames(spark, sf_dir).select("episode_id", F.floor(F.col("frame_index") / 10).alias("segment")).distinct()
    return segment.segment_summary(pieces).withColumn("mean_segments", r6("mean_segments"))


# --- what the numbers say -----------------------------------------------------------------


@query(
    f"""WITH {_F}, d AS (SELECT ep, t - lag(t) OVER {_W} AS dt FROM f), m AS (SELECT *, median(dt) OVER (PARTITION BY ep) AS mid FROM d WHERE dt IS NOT NULL),
s AS (SELECT ep, max(mid) AS mid, CASE WHEN count(*) FILTER (dt > mid * 0.5 AND dt < mid * 2) >= 2 THEN avg(dt) FILTER (dt > mid * 0.5 AND dt < mid * 2) ELSE avg(dt) END AS step FROM m GROUP BY ep), r AS (SELECT *, 1 / step AS r FROM s)
SELECT ep AS episode_id, CASE WHEN mid > 0 AND step > 0 THEN coalesce({", ".join(f"CASE WHEN abs(r - {c}) < 2 THEN {c}.0 END" for c in inspect.COMMON_FPS)}, round(r, 1)) END AS fps FROM r"""
)
def inferred_frame_rate(spark, sf_dir):
    return inspect.frame_rate(frames(spark, sf_dir))


_REWARD = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 9) / 4.0 - 1 END"


@query(
    f"WITH e AS (SELECT user_id AS ep, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {_REWARD} AS r FROM events), l AS (SELECT ep, arg_max(struct_pack(r := r), i).r AS last, sum(r) AS total FROM e GROUP BY ep) "
    "SELECT ep AS episode_id, CASE WHEN last > 0.5 THEN true WHEN last < -0.5 THEN false WHEN total > 0.5 THEN true WHEN total < -0.5 THEN false END AS success FROM l"
)
def episode_success(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), F.row_number().over(w).alias("frame_index"), F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 9) / 4.0 - 1).alias("reward"), F.lead("event_id").over(w).isNull().alias("is_last"))
    return inspect.success(x)


@query(f"WITH {_F}, n AS (SELECT ep, count(*) AS n FROM f GROUP BY ep), k AS (SELECT ep, CAST(floor(k * (n - 1) / 6) AS BIGINT) AS i FROM n, range(0, 7) r(k) WHERE n > 7 UNION SELECT f.ep, f.i FROM f JOIN n USING (ep) WHERE n <= 7) SELECT DISTINCT ep AS episode_id, i AS frame_index FROM k")
def evenly_spaced_frames(spark, sf_dir):
    return inspect.every(frames(spark, sf_dir).select("episode_id", "frame_index"), ["episode_id"], 7, ["frame_index"])


@query(f"WITH {_F}, s AS (SELECT ep, i, row_number() OVER {_W} - 1 AS j, count(*) OVER (PARTITION BY ep) AS n FROM f WHERE i % 2 = 0) SELECT ep AS episode_id, i AS frame_index FROM s WHERE n <= 8 OR j IN (SELECT CAST(round_even(k * (s.n - 1) / 7, 0) AS BIGINT) FROM range(0, 8) r(k))")
def sampled_for_embedding(spark, sf_dir):
    return sampling.sampled_frames(frames(spark, sf_dir), 2.0, 1.0, 8).select("episode_id", "frame_index")


@query(
    "WITH c AS (SELECT user_id AS ep, 'observation.images.' || event_type AS name, max(CASE WHEN event_id % 2 = 0 THEN 640 ELSE 320 END) AS w FROM events WHERE event_id % 3 > 0 GROUP BY ALL), v AS (SELECT ep, list_sort(list(name)) AS names, count(*) AS n FROM c GROUP BY ep), "
    "o AS (SELECT DISTINCT ep, 'camera.low_resolution' AS code FROM c WHERE w < 640 UNION ALL SELECT ep, 'camera.too_few_views' FROM v WHERE n < 5 UNION ALL SELECT NULL, 'camera.inconsistent_keys' FROM (SELECT count(DISTINCT names) AS k FROM v) WHERE k > 1 "
    "UNION ALL SELECT DISTINCT user_id, 'camera.none' FROM events WHERE user_id NOT IN (SELECT ep FROM v)) SELECT ep AS episode_id, code, CASE WHEN code IN ('camera.low_resolution', 'camera.too_few_views') THEN 'info' ELSE 'warn' END AS severity FROM o"
)
def lint_cameras(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    width = F.max(F.when(F.col("event_id") % 2 == 0, 640).otherwise(320))
    cameras = e.where("event_id % 3 > 0").groupBy(F.col("user_id").alias("episode_id"), F.concat(F.lit("observation.images."), "event_type").alias("name")).agg(width.alias("width"), F.lit(480).alias("height"))
    return curation.lint_cameras(cameras, e.select(F.col("user_id").alias("episode_id")).distinct(), min_views=5)


_TOK = "WITH f AS (SELECT event_id, value AS a FROM events), "


def _tokens(spark, sf_dir, name):
    x = table(spark, sf_dir, "events").select("event_id", F.array("value").alias("action"))
    t = action_tokens.fit(x, name, "action", 16)
    y = x.withColumn("k", t.encode(F.col("action")))
    return y.select("event_id", F.get("k", 0).cast("long").alias("token"), F.round(F.get(t.decode(F.col("k")), 0), 4).alias("decoded"))


@query(_TOK + "b AS (SELECT min(a) AS lo, max(a) AS hi FROM f), k AS (SELECT event_id, lo, hi, len(list_filter(range(1, 16), lambda e: lo + e * ((hi - lo) / 16) <= a)) AS k FROM f, b) SELECT event_id, k AS token, round(lo + (k + 0.5) * ((hi - lo) / 16), 4) AS decoded FROM k")
def tokenize_uniform(spark, sf_dir):
    return _tokens(spark, sf_dir, "uniform-bins")


@query(_TOK + "b AS (SELECT quantile_cont(a, 0.01) AS lo, quantile_cont(a, 0.99) AS hi FROM f), k AS (SELECT event_id, lo, hi, len(list_filter(range(1, 16), lambda e: lo + e * ((hi - lo) / 16) <= a)) AS k FROM f, b) SELECT event_id, k AS token, round(lo + (k + 0.5) * ((hi - lo) / 16), 4) AS decoded FROM k")
def tokenize_percentile(spark, sf_dir):
    return _tokens(spark, sf_dir, "openvla-bins")


@query(_TOK + "b AS (SELECT quantile_cont(a, [" + ", ".join(str(k / 16) for k in range(17)) + "]) AS e FROM f), k AS (SELECT event_id, e, len(list_filter(e[2:16], lambda v: v <= a)) AS k FROM f, b) SELECT event_id, k AS token, round((e[k + 1] + e[k + 2]) / 2, 4) AS decoded FROM k")
def tokenize_quantile(spark, sf_dir):
    return _tokens(spark, sf_dir, "quantile-bins")


@query(_TOK + "b AS (SELECT max(abs(a)) AS s FROM f), k AS (SELECT event_id, s, CAST(greatest(0, least(15, floor((sign(a) * ln(1 + 255 * least(abs(a) / s, 1)) / ln(256) + 1) / 2 * 16))) AS BIGINT) AS k FROM f, b) SELECT event_id, k AS token, round(sign((k + 0.5) / 16 * 2 - 1) * (exp(abs((k + 0.5) / 16 * 2 - 1) * ln(256)) - 1) / 255 * s, 4) AS decoded FROM k")
def tokenize_mulaw(spark, sf_dir):
    return _tokens(spark, sf_dir, "mulaw")


@query()
def tokenizer_compare(spark, sf_dir):
    return action_tokens.compare(table(spark, sf_dir, "events").select(F.array("value").alias("action")), bins=64)


_CMP = "SELECT '{s}' AS strategy, round(avg(power(d - a, 2)), 4) AS mse, round(avg(abs(d - a)), 4) AS mae, round(max(abs(d - a)), 4) AS max_abs, round(sqrt(avg(power(d - a, 2))), 4) AS rmse, least(1.0, count(DISTINCT k) / 16) AS vocab_used FROM ({q})"


@query(
    "WITH f AS (SELECT event_id, value AS a FROM events), b AS (SELECT min(a) AS lo, max(a) AS hi, quantile_cont(a, 0.01) AS p, quantile_cont(a, 0.99) AS q FROM f), "
    "u AS (SELECT a, len(list_filter(range(1, 16), lambda e: lo + e * ((hi - lo) / 16) <= a)) AS k, lo + (k + 0.5) * ((hi - lo) / 16) AS d FROM f, b), o AS (SELECT a, len(list_filter(range(1, 16), lambda e: p + e * ((q - p) / 16) <= a)) AS k, p + (k + 0.5) * ((q - p) / 16) AS d FROM f, b) "
    + " UNION ALL ".join(_CMP.format(s=s, q=q) for s, q in (("uniform-bins", "SELECT * FROM u"), ("openvla-bins", "SELECT * FROM o")))
)
def tokenizer_errors(spark, sf_dir):
    x = action_tokens.compare(table(spark, sf_dir, "events").select(F.array("value").alias("action")), ("uniform-bins", "openvla-bins"), bins=16)
    return x.select("strategy", *(F.round(c, 4).alias(c) for c in ("mse", "mae", "max_abs")), F.round(F.get("dim_rmse", 0), 4).alias("rmse"), "vocab_used")


# --- filter, lint, statistics -------------------------------------------------------------


def episodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("episode_id"), F.col("source").alias("task"), F.col("lang").alias("robot"), F.element_at(F.split("text", "\n"), 1).alias("language_instruction"), F.col("n_chars").cast("long").alias("num_frames"), F.timestamp_seconds(F.col("doc_id") % 100).alias("ingested_at"))


def scores(spark, sf_dir):
    q = table(spark, sf_dir, "labels")
    return q.select(F.col("doc_id").alias("episode_id"), (F.col("quality") * 6.0 + F.col("doc_id") % 4).alias("overall_score"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("flags"))


@query(
    "WITH s AS (SELECT doc_id, quality * 6.0 + doc_id % 4 AS score, toxic FROM labels) SELECT d.doc_id AS episode_id, concat_ws(',', CASE WHEN d.doc_id IN (1, 2, 3) THEN 'excluded' END, CASE WHEN s.doc_id IS NOT NULL AND (score IS NULL OR score < 5) THEN 'low_quality' END, CASE WHEN s.toxic = 1 THEN 'flag:toxic' END) AS reasons, "
    "concat_ws(',', CASE WHEN d.doc_id IN (1, 2, 3) THEN 'excluded' END, CASE WHEN s.doc_id IS NOT NULL AND (score IS NULL OR score < 5) THEN 'low_quality' END, CASE WHEN s.toxic = 1 THEN 'flag:toxic' END) = '' AS kept FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"
)
def filter_with_reasons(spark, sf_dir):
    rules = curation.FilterRules(exclude=["1", "2", "3"], min_quality=5.0, exclude_flags=["toxic"])
    return curation.filter_episodes(episodes(spark, sf_dir), scores(spark, sf_dir), rules).select("episode_id", F.concat_ws(",", "reasons").alias("reasons"), "kept")


@query(
    "WITH d AS (SELECT doc_id, trim(coalesce(string_split(text, chr(10))[1], ''), ' ') AS t, n_chars FROM documents), g AS (SELECT *, trim(regexp_replace(lower(t), '[.!]+$', ''), ' ') IN ('task desc', 'task description', 'task', 'hold', 'up', 'down', 'do something', 'n/a', 'none', 'test', 'demo') AS gen FROM d) "
    "SELECT doc_id AS episode_id, 'task.missing' AS code, 'warn' AS severity FROM g WHERE t = '' UNION ALL SELECT doc_id, 'task.generic', 'warn' FROM g WHERE t <> '' AND gen UNION ALL SELECT doc_id, 'task.too_short', 'warn' FROM g WHERE t <> '' AND NOT gen AND length(t) < 25 "
    "UNION ALL SELECT doc_id, 'task.too_long', 'info' FROM g WHERE length(t) > 60 UNION ALL SELECT doc_id, 'episode.too_short', 'error' FROM g WHERE n_chars < 3"
)
def lint_rules(spark, sf_dir):
    return curation.lint_episodes(episodes(spark, sf_dir))


@query("SELECT l_returnflag AS flag, dim, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS count FROM (SELECT l_returnflag, 0 AS dim, CAST(l_quantity AS DOUBLE) AS x FROM lineitem UNION ALL SELECT l_returnflag, 1, CAST(l_discount AS DOUBLE) FROM lineitem) GROUP BY ALL")
def stats_per_dim(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("v"))
    return curation.dimension_stats(x, "v", ["flag"]).withColumns({"mean": r6("mean"), "std": r6("std")})


@query("SELECT 0 AS dim, min(x) AS min, max(x) AS max, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, count(x) AS count FROM (SELECT CAST(l_quantity AS DOUBLE) AS x FROM lineitem)")
def pooled_stats(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.array(F.col("l_quantity").cast("double")).alias("v"))
    return curation.pooled_stats(curation.dimension_stats(x, "v", ["flag"])).withColumns({"mean": F.round("mean", 5), "std": F.round("std", 5)})


@query(f"WITH {_F}, {_STATE} SELECT dim, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS count FROM x WHERE i < 10 GROUP BY dim")
def stats_first_frames(spark, sf_dir):
    return curation.dimension_stats(frames(spark, sf_dir), "state", [], 10).withColumns({c: r6(c) for c in ("min", "max", "mean", "std")})


@query("SELECT count(*) AS n_episodes, CAST(sum(n_chars) AS BIGINT) AS n_frames, min(n_chars) AS min_frames, max(n_chars) AS max_frames, round(avg(n_chars), 6) AS mean_frames, 1.0 AS language_coverage FROM documents")
def dataset_stats(spark, sf_dir):
    return curation.dataset_stats(episodes(spark, sf_dir)).withColumn("mean_frames", r6("mean_frames"))


# --- catalog ------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return V.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("event_type"), F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


_PAIRS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id), e AS (SELECT * FROM p WHERE s >= 0.35)"


def _edges(spark, sf_dir):
    return V.similar_pairs(table(spark, sf_dir, "embeddings"), 0.35, "vec_id", "embedding", ["label"], "cosine")


@query(f"WITH {_PAIRS} SELECT a AS episode_a, b AS episode_b, round(s, 5) AS similarity FROM e")
def near_dup_pairs(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("similarity", F.round("similarity", 5))


_LONG = "e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 7) * (CASE WHEN vec_id = 3 THEN 40 ELSE 1 END)) AS v FROM embeddings)"


@query(f"WITH {_LONG} SELECT a.vec_id AS episode_a, b.vec_id AS episode_b, round(list_dot_product(a.v, b.v), 4) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 20")
def dot_pairs_of_unlike_lengths(spark, sf_dir):
    """Products of 20 or more among vectors of one to seven times their length, one of them forty times longer."""
    scale = (1 + F.col("vec_id") % 7) * F.when(F.col("vec_id") == 3, 40).otherwise(1)
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * scale))
    return V.similar_pairs(e, 20.0, "vec_id", "v", ["label"], "dot").withColumn("similarity", F.round("similarity", 4))


@query("SELECT lpad(CAST(a.vec_id AS VARCHAR), 12, '0') AS episode_a, lpad(CAST(b.vec_id AS VARCHAR), 12, '0') AS episode_b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35")
def edges_in_two_runs(spark, sf_dir):
    """A catalog gets its vectors in two commits; the second run searches the kept index with the new ones only."""
    c = Catalog.init(spark, new_path(spark, "catalog"))
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("episode_id"), F.lit("table").alias("model_id"), F.lit("episode").alias("level"), F.col("label").cast("string").alias("camera"), F.lit("none").alias("pooling"), F.size("embedding").alias("dim"), F.col("embedding").alias("vector"), F.current_timestamp().alias("computed_at"), "vec_id")
    for some in (F.col("vec_id") % 10 != 0, F.col("vec_id") % 10 == 0):
        c.commit({"embeddings": rows.where(some).drop("vec_id")})
        c.compute_edges("table", 0.35, "cosine")
    return c.table("dedup_edges").select("episode_a", "episode_b")


@query(
    """WITH h AS (SELECT vec_id AS e, list_transform(range(0, len(embedding) // 32), lambda k: list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[32 * k + i] > 0 THEN (1::UBIGINT << (i - 1))::HUGEINT ELSE 0 END))::BIGINT) AS hs FROM embeddings),
p AS (SELECT a.e AS a, b.e AS b, list_sum(list_transform(range(1, len(a.hs) + 1), lambda k: bit_count(xor(a.hs[k], b.hs[k])))) / (64.0 * len(a.hs)) AS d FROM h a JOIN h b ON a.e < b.e)
SELECT a, b, round(d, 6) AS distance FROM p WHERE d <= 0.15"""
)
def signatures_by_signs(spark, sf_dir):
    """Pairs of signatures within 15 % of the bits: the signs of each 32 components of a vector are the low half of a hash."""
    e = table(spark, sf_dir, "embeddings")
    word = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 32).cast("int") - 1), lambda k: F.slice("embedding", k * 32 + 1, 32))).alias("keyframe", "part")
    bits = F.aggregate(F.transform("part", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v)
    x = e.select(F.col("vec_id").alias("episode_id"), F.lit("all").alias("camera"), word).select("episode_id", "camera", "keyframe", bits.alias("hash"))
    return images.signature_pairs(x, 0.15).withColumn("distance", r6("distance"))


def _losers(policy):
    def run(spark, sf_dir):
        return dup_losers(_edges(spark, sf_dir), scores(spark, sf_dir), episodes(spark, sf_dir), policy)

    run.__name__ = f"dup_losers_{policy.replace('-', '_')}"
    return run


_LOSE = f"WITH {_PAIRS}, q AS (SELECT doc_id, quality * 6.0 + doc_id % 4 AS s FROM labels), x AS (SELECT e.a, e.b, {{la}} AS la, {{lb}} AS lb FROM e LEFT JOIN q qa ON qa.doc_id = a LEFT JOIN q qb ON qb.doc_id = b LEFT JOIN documents da ON da.doc_id = a LEFT JOIN documents db ON db.doc_id = b) SELECT DISTINCT CASE WHEN la > lb THEN b WHEN lb > la THEN a ELSE greatest(a, b) END AS episode_id FROM x"
for _policy, _la, _lb in (("higher-quality", "coalesce(qa.s, -1)", "coalesce(qb.s, -1)"), ("longer", "coalesce(da.n_chars, 0)", "coalesce(db.n_chars, 0)"), ("first", "db.doc_id % 100", "da.doc_id % 100")):
    query(_LOSE.format(la=_la, lb=_lb))(_losers(_policy))


@query(ORACLES["dup_losers_higher_quality"].replace("SELECT DISTINCT", ", l AS (SELECT DISTINCT", 1).replace("FROM x", "FROM x) SELECT d.doc_id AS episode_id, CASE WHEN l.episode_id IS NOT NULL THEN 'rejected' ELSE 'approved' END AS label FROM documents d LEFT JOIN l ON l.episode_id = d.doc_id WHERE d.lang = 'en'", 1))
def curate_labels(spark, sf_dir):
    lost = QUERIES["dup_losers_higher_quality"](spark, sf_dir).withColumn("lost", F.lit(True))
    chosen = episodes(spark, sf_dir).where("robot = 'en'").select("episode_id")
    return chosen.join(lost, "episode_id", "left").select("episode_id", F.when(F.col("lost"), "rejected").otherwise("approved").alias("label"))


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 5) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10")
def vector_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    like = V.mean_vector(e.where("vec_id = 7"), ["vec_id"], "embedding").first()["embedding"]
    return V.search(e, list(like), 10, "vec_id", "embedding", "label").select("vec_id", F.round("score", 5).alias("score"))


@query("WITH q AS (SELECT doc_id, quality * 6.0 + doc_id % 4 AS s FROM labels) SELECT source AS task, count(*) AS episodes, CAST(sum(n_chars) AS BIGINT) AS frames, round(min(s), 6) AS min_score, round(avg(s), 6) AS avg_score, round(median(s), 6) AS median_score, round(max(s), 6) AS max_score FROM documents LEFT JOIN q USING (doc_id) GROUP BY source")
def catalog_stats(spark, sf_dir):
    x = episodes(spark, sf_dir).join(scores(spark, sf_dir), "episode_id", "left")
    s = "overall_score"
    return x.groupBy("task").agg(F.count("*").alias("episodes"), F.sum("num_frames").alias("frames"), r6(F.min(s)).alias("min_score"), r6(F.avg(s)).alias("avg_score"), r6(F.median(s)).alias("median_score"), r6(F.max(s)).alias("max_score"))


QUERIES |= RELATIONAL
ORACLES |= RELATIONAL_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and flags of every episode."""
    return composite_score(spark, sf_dir)
