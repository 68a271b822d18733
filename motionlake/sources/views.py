"""Motion tables as views of the analytic tables: frames, detections, track points, manifest.

The event log gives track points (a user is a track, its event order the sequence)
and detections (three to a frame); parts give a video manifest; embeddings give small
gray frames. All views are narrow projections, so scans read only what they need.
A video is five users, 250 events or 50 frames, so videos grow in number with the
tables and not in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Users, events and frames of a video.
USERS, EVENTS, FRAMES = 5, 250, 50


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, track_id, seq (from 0), x, y."""
    named = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / USERS).alias("video_id"), F.col("user_id").alias("track_id"), "ts", "event_id", F.col("value").alias("x"), _k().cast("double").alias("y"))
    order = Window.partitionBy("video_id", "track_id").orderBy("ts", "event_id")  # the partitioning that track operators want
    return named.select("video_id", "track_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "x", "y")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_no, det_id, x, y, w, h in whole pixels."""
    video = F.floor(F.col("event_id") / EVENTS)
    place = F.row_number().over(Window.partitionBy(video).orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(
        video.alias("video_id"), F.floor((place - 1) / 3).alias("frame_no"), F.col("event_id").alias("det_id"),
        F.floor("value").alias("x"), _k().cast("long").alias("y"), (20 + F.col("event_id") % 40).alias("w"), (20 + F.col("event_id") % 30).alias("h"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, series_name, activity, distortion, fps, duration_s, width, height."""
    key = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("video_id"), F.col("p_name").alias("series_name"), F.col("p_type").alias("activity"), F.col("p_brand").alias("distortion"),
        F.col("p_size").cast("double").alias("fps"), (F.col("p_retailprice") / 10).alias("duration_s"), (640 + 320 * key).alias("width"), (480 + 120 * key).alias("height"),
    )


def frame_video() -> Column:
    """The video of a frame of ``frames``."""
    return F.floor(F.col("frame_no") / FRAMES)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_no and an 8 x 8 gray frame, row by row: pixels array<bigint>."""
    gray = F.transform("embedding", lambda e: F.floor(F.least(F.greatest((e.cast("double") + 1.0) * 127.5, F.lit(0.0)), F.lit(255.0))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), gray.alias("pixels"))


#: The same views for the SQL engine, by name, for use in WITH.
VIEW_SQL = {
    "track_points": """track_points AS (
  SELECT user_id // 5 AS video_id, user_id AS track_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         value AS x, CAST(CAST(json_extract_string(props, '$.k') AS INT) AS DOUBLE) AS y FROM events)""",
    "detections": """detections AS (
  SELECT video_id, CAST(floor(CAST(rn - 1 AS DOUBLE) / 3) AS BIGINT) AS frame_no, det_id, x, y, w, h
  FROM (SELECT event_id // 250 AS video_id, event_id AS det_id,
               row_number() OVER (PARTITION BY event_id // 250 ORDER BY ts, event_id) AS rn,
               CAST(floor(value) AS BIGINT) AS x, CAST(json_extract_string(props, '$.k') AS BIGINT) AS y,
               20 + event_id % 40 AS w, 20 + event_id % 30 AS h FROM events) q)""",
    "manifest": """manifest AS (
  SELECT p_partkey AS video_id, p_name AS series_name, p_type AS activity, p_brand AS distortion,
         CAST(p_size AS DOUBLE) AS fps, p_retailprice / 10 AS duration_s,
         640 + 320 * (p_partkey % 3) AS width, 480 + 120 * (p_partkey % 3) AS height FROM part)""",
    "pixels": """pixels AS (
  SELECT vec_id AS frame_no, CAST(i - 1 AS BIGINT) // 8 AS r, CAST(i - 1 AS BIGINT) % 8 AS c,
         CAST(floor(least(greatest((CAST(e AS DOUBLE) + 1.0) * 127.5, 0), 255)) AS BIGINT) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))""",
}
