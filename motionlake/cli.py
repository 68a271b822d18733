"""Command line: list components and queries, or run one query over a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import catalog, configured
from .registry import CATEGORIES, available
from .sources import files


def run_configs(given: argparse.Namespace) -> int:
    """Feature vectors, run records and, with a manifest, trained models of each configuration, in run folders under --out."""
    if not given.frames or not (given.out or given.diagnose):
        print("a configuration needs --frames, and --out or --diagnose")
        return 1
    spark = SparkSession.builder.getOrCreate()
    frames = spark.read.parquet(given.frames) if given.frames.endswith(".parquet") else files.read_frames(spark, given.frames)
    if given.sample:
        some = frames.select("video_id").distinct().orderBy(F.xxhash64("video_id"), "video_id").limit(given.n)
        frames = frames.join(some, "video_id", "left_semi")
    known = spark.read.parquet(given.known) if given.known else None
    labels = video_labels(spark, given.manifest) if given.manifest else None
    for name in given.config or [n for n in configured.names() if n.startswith("group_")]:
        over = {"detection": {"type": given.detection_source}} if given.detection_source else {}
        config = configured.load(name, over)
        if config.get("data_path") == "clip" or (config["detection"]["type"] == "ground_truth" and known is None):
            print(f"{name}: left out ({'clip models are not built' if config.get('data_path') == 'clip' else 'no --known boxes'})")
            continue
        vectors = configured.video_vectors(frames, config, known)
        if given.diagnose:
            vectors.select("video_id", "indicator_tracks_present", "meta_n_traj_tracks").orderBy("video_id").show(50)
            continue
        run = files.write_run(spark, given.out, config, {"config": name, "n_videos": frames.select("video_id").distinct().count()})
        vectors.write.json(f"{run}/features")
        print(run)
        for target in ("activity", "distortion") if given.target == "both" else (given.target,):
            if labels is not None:
                said = configured.train(spark.read.schema(vectors.schema).json(f"{run}/features"), labels, config, target, run)
                print(f"{target}: {said.get('error') or said['models']}")
    return 0


def video_labels(spark: SparkSession, path: str) -> DataFrame:
    """video_id, activity and distortion of a manifest; without a column video_id the last number in a video's name is its id."""
    manifest = files.read_manifest(spark, path)
    info = files.video_info(manifest)
    if "video_id" in manifest.columns:
        return manifest.select(F.col("video_id").cast("long").alias("video_id"), F.col("Activity").alias("activity"), F.col("Distortion").alias("distortion"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return info.select(F.regexp_extract(stem, r"(\d+)\D*$", 1).try_cast("long").alias("video_id"), "activity", "distortion").where("video_id is not null")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="motionlake", description=__doc__)
    p.add_argument("query", nargs="?", help="a registered query")
    p.add_argument("--tables", help="the folder of the Parquet tables")
    p.add_argument("--out", help="write JSON lines to this folder instead of showing rows")
    p.add_argument("--list-queries", action="store_true")
    p.add_argument("--list-components", action="store_true")
    p.add_argument("--list-configs", action="store_true")
    p.add_argument("--config", action="append", default=[], help="run a configuration over --frames; may be given several times")
    p.add_argument("--all-groups", action="store_true", help="run every group_* configuration")
    p.add_argument("--frames", help="a folder of gray frames (video/frame.pgm), or a Parquet table of frames")
    p.add_argument("--known", help="a Parquet table of known boxes, for detection from ground truth")
    p.add_argument("--manifest", help="labels of the videos (.xlsx, .csv, .json, .parquet); with them the configuration's models are trained")
    p.add_argument("--target", "-t", choices=["activity", "distortion", "both"], default="activity", help="what the models learn to tell")
    p.add_argument("--detection-source", choices=["mog2", "ground_truth"])
    p.add_argument("--sample", action="store_true", help="take --n videos only, chosen by a hash of their number")
    p.add_argument("--n", type=int, default=5)
    p.add_argument("--diagnose", action="store_true", help="show each video's number of frames and features only")
    given = p.parse_args(args)
    if given.list_configs:
        print("\n".join(configured.names()))
        return 0
    if given.config or given.all_groups:
        return run_configs(given)
    if given.list_queries:
        print("\n".join(sorted(catalog.QUERIES)))
    if given.list_components:
        print("\n".join(f"{c}: {', '.join(available(c))}" for c in CATEGORIES))
    if given.list_queries or given.list_components:
        return 0
    if not given.query or not given.tables or given.query not in catalog.QUERIES:
        p.print_usage()
        return 1
    rows = catalog.QUERIES[given.query](SparkSession.builder.getOrCreate(), given.tables)
    if given.out:
        rows.write.mode("error").json(given.out)
    else:
        rows.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
