"""Readers and writers of the pipeline's files: manifests, box texts, frames, results, configurations."""

from __future__ import annotations

import json
import os
import subprocess
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sheets import read_xlsx

#: The columns that a manifest must have, and how others are recognised.
REQUIRED = ("Activity", "Distortion", "Name of Video Series")
ROLES = (("name", ("name", "video")), ("duration", ("duration",)), ("fps", ("fps", "rate")), ("frames", ("nframes", "frame count", "frames")), ("width", ("width",)), ("height", ("height",)), ("activity", ("activity",)), ("distortion", ("distortion",)))
DEFAULTS = {"duration": 0.0, "fps": 30.0, "frames": 0, "width": 1920, "height": 956}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from a workbook, CSV (with a header; all columns are strings, which video_info
    reads as numbers), JSON lines or Parquet, by the path's ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read
    df = read_xlsx(spark, path) if kind == "xlsx" else reader.option("header", True).csv(path) if kind == "csv" else reader.json(path) if kind in ("json", "jsonl") else reader.parquet(path)
    if lacking := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"the manifest lacks {lacking}")
    return df


def roles_of(columns: list[str]) -> dict[str, str]:
    """Role -> column, by parts of the lower-cased name; the first role that fits a column takes it."""
    found: dict[str, str] = {}
    for c in columns:
        for role, parts in ROLES:
            if role not in found and any(p in c.lower() for p in parts):
                found[role] = c
                break
    return found


def video_info(manifest: DataFrame) -> DataFrame:
    """name, duration, fps, frames, width, height, activity, distortion; defaults for what is missing or 0."""
    roles = roles_of(manifest.columns)
    cols = [F.col(f"`{roles[r]}`").alias(r) for r in ("name", "activity", "distortion") if r in roles]
    for r, d in DEFAULTS.items():
        v = F.expr(f"try_cast(`{roles[r]}` as double)") if r in roles else F.lit(None).cast("double")
        cols.append(F.coalesce(F.when(v > 0, v), F.lit(float(d))).alias(r))
    info = manifest.select(*cols)
    return info.withColumn("frames", F.when(F.col("frames") > 0, F.col("frames")).otherwise(F.floor(F.col("fps") * F.col("duration"))).cast("long"))


def read_boxes(spark: SparkSession, path: str, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """file, frame_no, x, y, w, h of texts with one box a line (comma or white space between numbers).

    Each line is a frame; blank lines, comments and lines without four numbers give no box.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("frame_no", "line"))
    parts = F.split(F.trim("line"), r"[,\s]+")
    number = lambda i: F.expr(f"try_cast(get(parts, {i}) as double)")
    rows = texts.where(~F.trim("line").startswith("#")).withColumn("parts", parts).select("file", F.col("frame_no").cast("long").alias("frame_no"), *(number(i).alias(c) for i, c in enumerate(("x", "y", "w", "h")))).na.drop()
    return rows.select("file", "frame_no", *(F.floor(F.col(c) * (scale_x if c in "xw" else scale_y)).alias(c) for c in ("x", "y", "w", "h")))


def first_match(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Of each video's files (video_id, file), the one that fits the earliest SQL LIKE pattern; of
    equals the first by name. An underscore stands for itself."""
    rank = F.coalesce(*(F.when(F.col("file").like(p.replace("_", "\\_")), i) for i, p in enumerate(patterns)), F.lit(None))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("rank", "file"))
    return files.withColumn("rank", rank).where("rank is not null").withColumn("place", place).where("place = 1").select("video_id", "file")


#: Endings of a video's box text beside its name, the first that is there wins.
TRUTH_ENDINGS = ("_gt.txt", ".txt", "_groundtruth.txt", "_bbox.txt")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, file and whether it lies right in the folder, of all files below ``root``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    within = F.regexp_replace("path", r"^[a-zA-Z][\w+.-]*:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), (~F.substring_index(within, base, -1).contains("/")).alias("top"))


def find_truth(videos: DataFrame, files: DataFrame) -> DataFrame:
    """video_id and path of the box text of each of ``videos`` (video_id, name) among ``files`` (``listing``).

    Right in the folder: the name without its ending and one of ``TRUTH_ENDINGS``, then a
    file whose name has it and later "_gt.txt", then any that has it; then these two anywhere
    below. Of equals the first by file and path. A name within a name is found by an equal
    join on the parts of file names that are as long as some video's name.
    """
    stems = videos.select("video_id", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem")).where("stem <> ''")
    ends = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(e).alias("end")) for i, e in enumerate(TRUTH_ENDINGS))))
    exact = stems.select("video_id", ends.alias("e")).select("video_id", "e.rank", "e.end").join(stems, "video_id").withColumn("want", F.concat("stem", "end"))
    exact = exact.join(files.where("top").select("path", "file"), F.col("file") == F.col("want")).select("video_id", "rank", "file", "path")
    left = stems.join(exact.select("video_id").distinct(), "video_id", "left_anti")
    sizes = F.broadcast(left.select(F.length("stem").alias("size")).distinct())  # lengths of names, at most a few hundred
    parts = files.join(sizes, F.length("file") >= F.col("size")).select("path", "file", "top", "size", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("file") - F.col("size") + 1), lambda i: F.substring(F.col("file"), i, F.col("size"))))).alias("part"))
    after = F.expr("substring(file, instr(file, stem) + length(stem))").endswith("_gt.txt")
    near = left.join(parts, F.col("part") == F.col("stem")).select("video_id", (4 + F.when(after, 0).otherwise(1) + F.when(F.col("top"), 0).otherwise(2)).alias("rank"), "file", "path")
    best = F.min(F.struct("rank", "file", "path"))
    return exact.unionByName(near).groupBy("video_id").agg(best.alias("b")).select("video_id", F.col("b.path").alias("path"))


def truth_boxes(spark: SparkSession, root: str, videos: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """video_id, frame_no, x, y, w, h from the box texts of ``videos`` (video_id, name, width, height) below
    ``root``, scaled from each video's size to ``width`` and ``height``; only texts that were found are read."""
    chosen = find_truth(videos, listing(spark, root)).join(videos.select("video_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "video_id")
    texts = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("at"), "value")
    plain = lambda c: F.regexp_replace(F.url_decode(c), r"^[a-zA-Z][\w+.-]*:/*", "/")
    lines = chosen.join(texts, plain(F.col("path")) == plain(F.col("at"))).select("video_id", "_w", "_h", F.posexplode(F.split("value", "\r?\n")).alias("frame_no", "line"))
    number = lambda i: F.expr(f"try_cast(get(parts, {i}) as double)")
    rows = lines.where(~F.trim("line").startswith("#")).withColumn("parts", F.split(F.trim("line"), r"[,\s]+")).select("video_id", F.col("frame_no").cast("long").alias("frame_no"), "_w", "_h", *(number(i).alias(c) for i, c in enumerate(("x", "y", "w", "h")))).na.drop(subset=["x", "y", "w", "h"])
    scale = {"x": F.lit(width) / F.col("_w"), "w": F.lit(width) / F.col("_w"), "y": F.lit(height) / F.col("_h"), "h": F.lit(height) / F.col("_h")}
    whole = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    return rows.select("video_id", "frame_no", *(whole(F.col(c) * k).cast("long").alias(c) for c, k in scale.items()))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """video_id (folder name's digits), frame_no (file name's digits), height, width, pixels of binary
    gray maps (P5); other files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pgm").load(path)
    head = F.split(F.regexp_extract(F.decode(F.substring("content", 1, 64), "ISO-8859-1"), r"^P5\s(\d+\s\d+)\s255\s", 1), r"\s")
    start = F.length(F.regexp_extract(F.decode(F.substring("content", 1, 64), "ISO-8859-1"), r"^(P5\s\d+\s\d+\s255\s)", 1))
    rows = raw.select(F.regexp_extract("path", r"(\d+)\D*/[^/]*$", 1).cast("long").alias("video_id"), F.regexp_extract("path", r"(\d+)\.pgm$", 1).cast("long").alias("frame_no"), "content", head.alias("size"), start.alias("start"))
    return rows.where("start > 0").select("video_id", "frame_no", F.get("size", F.lit(1)).cast("int").alias("height"), F.get("size", F.lit(0)).cast("int").alias("width"), F.expr("substring(content, start + 1)").alias("pixels"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def git_commit(folder: str = ".") -> str:
    """The short hash of the folder's commit, or "unknown"."""
    try:
        said = subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return "unknown"
    return said.stdout.strip() or "unknown"


def write_run(spark: SparkSession, folder: str, config: dict[str, Any], counts: dict[str, Any], now: datetime | None = None) -> str:
    """Write config_snapshot.yaml and run_meta.json (commit, time, counts) to ``folder``'s next run folder; its path.

    The folder may be in any store that Spark reads; runs are told by their names.
    """
    import yaml

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    run = f"{folder.rstrip('/')}/{next_run_id(taken)}"
    meta = {"git_commit": git_commit(), "timestamp": (now or datetime.now(timezone.utc)).isoformat(), **counts}
    for name, text in (("config_snapshot.yaml", yaml.safe_dump(config, sort_keys=True)), ("run_meta.json", json.dumps(meta, sort_keys=True))):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{run}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()
    return run


def next_run_id(names: list[str]) -> str:
    """run_001 and so on: one more than the largest of the names."""
    taken = [int(n[4:]) for n in names if n.startswith("run_") and n[4:].isdigit()]
    return f"run_{max(taken, default=0) + 1:03d}"


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Deep merge: mappings key by key, all else (lists too) replaced; ``extends`` is dropped."""
    out = {k: v for k, v in base.items() if k != "extends"}
    for k, v in over.items():
        if k != "extends":
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(name: str, folder: str, overrides: dict[str, Any] | None = None, seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """A YAML configuration with its ``extends`` chain; a cycle is an error, a missing parent is passed over."""
    import yaml

    if name in seen:
        raise ValueError(f"configurations extend each other: {' > '.join((*seen, name))}")
    with open(os.path.join(folder, f"{name}.yaml"), encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    parent = own.get("extends")
    if parent and os.path.exists(os.path.join(folder, f"{parent}.yaml")):
        own = merged(load_config(parent, folder, None, (*seen, name)), own)
    return merged(own, overrides or {})
