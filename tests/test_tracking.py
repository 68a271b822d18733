"""Trackers, detectors and files on small made inputs; batch and stream agree."""

import numpy as np
import plain_trackers
import pytest

from motionlake import registry
from motionlake.operators import tracking, vision
from motionlake.sources import files
from motionlake.streaming import events
from motionlake.streaming.trackers import track_stream

SCHEMA = "video_id long, frame_no long, det_id long, x long, y long, w long, h long"


def moving(frames, tracks=2, video=0, gap=()):
    return [(video, f, t, 10 + 3 * f, 20 + 200 * t, 40, 40) for f in frames for t in range(tracks) if f not in gap]


@pytest.mark.parametrize("kind", sorted(tracking.TRACKERS))
def test_two_straight_tracks(spark, kind):
    rows = tracking.track(spark.createDataFrame(moving(range(40)), SCHEMA), kind).collect()
    assert len(rows) == 80 and {(r.det_id, r.track_id) for r in rows} == {(0, 0), (1, 1)}
    points = tracking.alive(tracking.track(spark.createDataFrame(moving(range(40)), SCHEMA), kind))
    assert {(r["track_id"], r["count"]) for r in points.groupBy("track_id").count().collect()} == {(0, 40), (1, 40)}


def wandering(seed, frames=60, boxes=4):
    """Boxes on bent paths that cross, come and go; with looks for three scales."""
    rng = np.random.default_rng(seed)
    out = {}
    for b in range(boxes):
        x, y, dx, dy = rng.uniform(20, 300), rng.uniform(20, 300), rng.uniform(-6, 6), rng.uniform(-6, 6)
        w, h, look = int(rng.integers(25, 60)), int(rng.integers(25, 60)), rng.uniform(0, 1, 9)
        for f in range(int(rng.integers(0, 10)), frames):
            x, y, dx, dy = x + dx, y + dy, dx + rng.normal(0, 0.7), dy + rng.normal(0, 0.7)
            if rng.random() < 0.85 and not (b == 0 and 20 <= f < 55):
                looks = {s: np.round(look + rng.normal(0, 0.05, 9), 6) for s in (0.95, 1.0, 1.05)}
                out.setdefault(f, []).append(([int(x), int(y), w + int(rng.integers(-2, 3)), h + int(rng.integers(-2, 3))], looks))
    return out


@pytest.mark.parametrize("kind", sorted(tracking.TRACKERS))
@pytest.mark.parametrize("seed", range(3))
def test_trackers_match_plain_ones(spark, kind, seed):
    frames = wandering(seed)
    for scales in ((1.0,), (0.95, 1.0, 1.05)) if kind == "tfcr" else ((1.0,),):
        rows = [(7, f, j, *b, [float(v) for s in scales for v in looks[s]]) for f, here in frames.items() for j, (b, looks) in enumerate(here)]
        df = spark.createDataFrame(rows, SCHEMA + ", look array<double>")
        how = {"scales": scales} if kind == "tfcr" else {}
        got = sorted((r.frame_no, r.det_id, r.track_id, r.hits) for r in tracking.track(df, kind, **how).collect())
        assert got == sorted(plain_trackers.run(kind, frames, scales=scales)), scales


def test_all_trackers_in_one_pass_are_the_same(spark):
    rows = [(v, f, j, *b) for v in range(3) for f, here in wandering(v).items() for j, (b, _) in enumerate(here)]
    df = spark.createDataFrame(rows, SCHEMA)
    together = tracking.track_all(df)
    for kind in tracking.TRACKERS:
        one = sorted(map(tuple, tracking.track(df, kind).collect()))
        assert one == sorted(map(tuple, together.where(f"tracker = '{kind}'").drop("tracker").collect())), kind


def test_frames_go_on_over_batches(spark):
    rows = [(v, f, j, *b) for v in range(2) for f, here in wandering(v).items() for j, (b, _) in enumerate(here)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, tracking.track(df, "sort").collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, tracking.track(df, "sort").collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("missing,ids", [(30, 1), (31, 2)])
def test_a_gap_of_more_than_thirty_frames_ends_a_track(spark, missing, ids):
    rows = [(0, 0, 0, 10, 10, 40, 40), (0, missing + 1, 0, 10, 10, 40, 40)]
    assert len({r.track_id for r in tracking.track(spark.createDataFrame(rows, SCHEMA), "iou_hungarian").collect()}) == ids


def test_overlap_must_exceed_the_threshold():
    t = tracking.Overlap(above=1 / 3)
    assert t.update(0, np.array([[0, 0, 10, 10]], float)) == ([0], [1])
    assert t.update(1, np.array([[5, 0, 10, 10]], float)) == ([1], [1])


def test_trajectories_are_capped(spark):
    tracked = tracking.track(spark.createDataFrame(moving(range(305), 1), SCHEMA), "centroid")
    points = tracking.alive(tracked).collect()
    assert len(points) == 300 and min(p.seq for p in points) == 0 and max(p.x for p in points) == 10 + 3 * 304 + 20


def test_few_hits_give_no_track(spark):
    assert tracking.alive(tracking.track(spark.createDataFrame(moving(range(2), 1), SCHEMA), "sort"), min_hits=3).count() == 0


def test_empty_and_null_rows(spark):
    assert tracking.track(spark.createDataFrame([], SCHEMA), "sort").count() == 0
    assert tracking.track(spark.createDataFrame([(None, 1, 1, 1, 1, 1, 1), (0, 1, 1, 1, 1, 1, None)], SCHEMA), "sort").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = moving(range(12), 3, 0, (5,)) + moving(range(12), 2, 1)
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([r for r in rows if i * 4 <= r[1] < i * 4 + 4], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    want = {tuple(r) for r in tracking.track(spark.createDataFrame(rows, SCHEMA), "iou_hungarian").collect()}
    stream = track_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)))
    run = stream.writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("tracked").collect()} == want


def test_windows_stream_equals_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = {tuple(r) for r in events.tumbling_counts(table).collect()}
    source = tmp_path / "events"
    table.coalesce(1).write.parquet(str(source))
    stream = events.tumbling_counts(spark.readStream.schema(table.schema).parquet(str(source)))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == want


def test_cascade_switches_twice_without_detections():
    c = vision.Cascade()
    for _ in range(25):
        c.count += 1
        c.settle(0)
    assert [(f, a, b) for f, a, b in c.switches] == [(10, "mog2", "dense_flow"), (20, "dense_flow", "frame_diff")]
    busy = vision.Cascade()
    for _ in range(25):
        busy.count += 1
        busy.settle(1)
    assert busy.active == "mog2"


def test_detectors_find_a_moving_square(spark):
    rows = []
    for f in range(12):
        frame = np.full((64, 64), 100, np.uint8)
        frame[20:40, 5 + 3 * f : 25 + 3 * f] = 200
        rows.append((0, f, 64, 64, bytearray(frame.tobytes())))
    frames = spark.createDataFrame(rows + [(0, 99, 64, 64, bytearray(b"short"))], "video_id long, frame_no long, height int, width int, pixels binary")
    for kind in ("mog2", "frame_diff", "cascaded_fallback"):
        found = [r for r in vision.detect(frames, kind, least_area=20).collect() if r.frame_no]
        assert found and all(18 <= r.y <= 40 for r in found), kind
    # The mixture knows nothing before the first frame, so all of that is foreground, but for what closing takes off the border.
    assert [tuple(r)[3:8] for r in vision.detect(frames, "mog2", least_area=20).where("frame_no = 0").collect()] == [(2, 2, 60, 60, 3600)]


def test_files(spark, tmp_path):
    (tmp_path / "gt.txt").write_text("1,2,3,4\n# none\n\n5 6 7 8 9\n1,2\na,b,c,d\n10, 20, 30, 40")
    got = [tuple(r)[1:] for r in files.read_boxes(spark, str(tmp_path / "gt.txt"), 2.0, 1.0).orderBy("frame_no").collect()]
    assert got == [(0, 2, 2, 6, 4), (3, 10, 6, 14, 8), (6, 20, 20, 60, 40)]
    (tmp_path / "m.csv").write_text("Activity,Distortion,Name of Video Series,Nframes,Frame Rate (FPS),Duration (s)\nPO,Pri,a.mp4,100,10,10\nPW,Exp,b.mp4,,0,\n")
    info = {r["name"]: r for r in files.video_info(files.read_manifest(spark, str(tmp_path / "m.csv"))).collect()}
    assert info["a.mp4"]["frames"] == 100 and info["b.mp4"]["fps"] == 30.0 and info["b.mp4"]["width"] == 1920
    (tmp_path / "bad.csv").write_text("Activity\nx\n")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "bad.csv"))
    assert files.next_run_id(["run_001", "run_009", "other"]) == "run_010" and files.next_run_id([]) == "run_001"


def test_frames_from_files(spark, tmp_path):
    (tmp_path / "v7").mkdir()
    (tmp_path / "v7" / "f003.pgm").write_bytes(b"P5\n3 2\n255\n" + bytes([10, 13, 32, 255, 0, 7]))
    (tmp_path / "v7" / "f004.pgm").write_bytes(b"junk")
    row = files.read_frames(spark, str(tmp_path)).collect()
    assert [(r.video_id, r.frame_no, r.height, r.width, bytes(r.pixels)) for r in row] == [(7, 3, 2, 3, bytes([10, 13, 32, 255, 0, 7]))]


def test_configurations(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: [1, 2]}\nb: 2\n")
    (tmp_path / "child.yaml").write_text("extends: base\na: {y: [3]}\n")
    (tmp_path / "loop.yaml").write_text("extends: loop\n")
    (tmp_path / "lone.yaml").write_text("extends: nowhere\nc: 1\n")
    assert files.load_config("child", str(tmp_path), {"b": 5}) == {"a": {"x": 1, "y": [3]}, "b": 5}
    assert files.load_config("lone", str(tmp_path)) == {"c": 1}
    with pytest.raises(ValueError):
        files.load_config("loop", str(tmp_path))


def test_registry():
    with pytest.raises(KeyError):
        registry.build("tracker", "no such tracker")
    with pytest.raises(KeyError):
        registry.register("colour", "x")
    registry.register("preprocessor", "test_only")(lambda: 1)
    with pytest.raises(ValueError):
        registry.register("preprocessor", "test_only")
    assert registry.build("preprocessor", "test_only") == 1


def test_preprocessing(spark):
    from motionlake.functions import images
    from motionlake.operators import preprocess

    rng = np.random.default_rng(0)
    sharp = rng.integers(0, 255, (24, 32)).astype(np.uint8)
    rows = [(0, 0, 24, 32, bytearray(sharp.tobytes())), (0, 1, 24, 32, bytearray(bytes([20]) * 768)), (0, 2, 24, 32, bytearray(bytes([220]) * 768)), (0, 3, 24, 32, bytearray(b"x")), (0, 4, None, None, None)]
    frames = spark.createDataFrame(rows, "video_id long, frame_no long, height int, width int, pixels binary")
    got = {r["frame_no"]: r for r in preprocess.preprocess(frames, height=48, width=64).collect()}
    assert sorted(got) == [0, 1, 2] and got[0]["distortion_type"] == "pristine" and not got[0]["enhanced"]
    assert got[1]["distortion_type"] == got[2]["distortion_type"] == "blurry+exposure" and got[1]["enhanced"] and len(got[1]["pixels"]) == 48 * 64
    for how in ({"for_blur": "wiener", "for_exposure": "bilateral"}, {"for_blur": "none", "for_exposure": "none"}):
        assert preprocess.preprocess(frames, height=24, width=32, **how).count() == 3
    assert [r["blur_score"] for r in preprocess.preprocess(frames, "passthrough").collect()] == [None] * 3
    assert preprocess.preprocess(frames, "standard", height=24, width=32).where("brightness is not null").count() == 3
    flat = np.full((9, 9), 7, np.uint8)
    assert (images.to_bytes(images.gaussian(flat)) == 7).all() and (images.resized(flat, 4, 20) == 7).all() and (images.wiener(flat) == 7).all() and (images.bilateral(flat) == 7).all()
    assert (images.stretched(flat) == 7).all() and images.laplacian_variance(flat) == 0 and (images.gamma(np.array([0, 255], np.uint8)) == [0, 255]).all()


def test_flow_of_a_shifted_scene(spark):
    from motionlake.operators import frames as frame_ops
    from motionlake.operators import preprocess

    scene = np.random.default_rng(2).integers(0, 255, (32, 96)).astype(np.uint8)
    rows = [(0, f, 32, 48, bytearray(np.ascontiguousarray(scene[:, 2 * f : 2 * f + 48]).tobytes())) for f in range(6)]
    frames = spark.createDataFrame(rows, "video_id long, frame_no long, height int, width int, pixels binary")
    vectors = preprocess.flow_vectors(frames)
    inner = vectors.where("x > 8 and x < 40").select("dx", "dy").distinct().collect()
    assert [tuple(r) for r in inner] == [(-2.0, 0.0)]
    pooled = frame_ops.flow_pool(vectors).collect()[0]
    assert pooled["flow_mean_mag"] > 1.5 and pooled["flow_hof_mean_4"] > 0.5
    assert preprocess.keypoints(frames).count() > 0


def test_appearance_tracker_follows_overlap(spark):
    rows = moving(range(20))
    looks = spark.createDataFrame([(*r, [float(r[2])] + [0.0] * 8) for r in rows], SCHEMA + ", look array<double>")
    assert {(r.det_id, r.track_id) for r in tracking.track(looks, "tfcr").collect()} == {(0, 0), (1, 1)}


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from motionlake import cli

    assert cli.main(["--list-queries", "--list-components"]) == 0
    assert "trajectory_video" in (said := capsys.readouterr().out) and "tracker: centroid" in said
    assert cli.main([]) == 1 and cli.main(["no such query", "--tables", sf_dir]) == 1
    assert cli.main(["class_distribution", "--tables", sf_dir, "--out", str(tmp_path / "o")]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() == 10


def test_ground_truth_joins_on_the_frame_number(spark):
    frames = spark.createDataFrame([(0, 0), (0, 5), (0, 9)], "video_id long, frame_no long")
    known = spark.createDataFrame([(0, 5, 1, 2, 3, 4), (0, 5, 9, 9, 9, 9), (0, 6, 1, 1, 1, 1)], "video_id long, frame_no long, x long, y long, w long, h long")
    assert [tuple(r)[:8] for r in vision.ground_truth(frames, known).collect()] == [(0, 5, 0, 1, 2, 3, 4, 12)]


def test_adaptive_background():
    a = vision.Adaptive(least_area=4)
    frame = np.full((64, 64), 100, np.uint8)
    for f in range(10):
        moved = frame.copy()
        moved[20:30, 3 * f : 3 * f + 10] = 160
        a.mask(moved)
        a.feedback([], 0)
    said = a.diagnostics()
    assert said["n_frames"] == 10 and 0 < said["avg_mask_quality"] <= 1 and said["avg_track_quality"] == pytest.approx(np.mean([0.8**i for i in range(10)]))
    a.feedback([30, 60], 1)
    assert a.prior == pytest.approx(0.8 * 0.8**10 + 0.2 * 0.5)


def plain_mixture(values, threshold=16.0, history=20):
    """Raw marks (0, 127, 255) of one pixel's values by a mixture of Gaussians, told pixel by pixel."""
    modes, out = [], []  # [weight, mean, variance], the heaviest first
    for count, v in enumerate(values):
        rate = 1 / min(2 * (count + 1), history)
        total, background, shadow, own = 0.0, False, False, None
        kept = []
        for mode in modes:
            weight = (1 - rate) * mode[0] - rate * 0.05
            d2 = (v - mode[1]) ** 2
            heavy = total < 0.9
            total += weight
            if own is None:
                background |= heavy and d2 < threshold * mode[2]
            if heavy and mode[1] > 0 and 0.5 <= v / mode[1] <= 1:
                shadow = True
            if own is None and d2 < 9 * mode[2]:
                weight += rate
                own = weight
                mode = [weight, mode[1] + rate / weight * (v - mode[1]), min(max(mode[2] + rate / weight * (d2 - mode[2]), 4.0), 75.0)]
            else:
                mode = [weight, mode[1], mode[2]]
            kept.append(mode)
        out.append(0 if background else 127 if shadow else 255)
        modes = [m for m in kept if m[0] >= rate * 0.05]
        if own is None:
            modes = modes[:4]
            modes = [[m[0] * (1 - rate), *m[1:]] for m in modes] + [[rate if modes else 1.0, float(v), 15.0]]
        mass = sum(m[0] for m in modes)
        modes = sorted(([m[0] / mass, *m[1:]] for m in modes), key=lambda m: -m[0])
    return out


def test_mixture_matches_a_plain_one():
    rng = np.random.default_rng(5)
    model = vision.Background(adaptive=False)
    levels = rng.choice([40, 90, 160, 230], (80, 6, 7), p=[0.1, 0.1, 0.5, 0.3])
    frames = np.clip(levels + rng.integers(-6, 7, levels.shape), 0, 255).astype(np.uint8)
    marks = []
    for f in frames:
        marks.append(model.classified(f.astype(float), 16.0))
        model.learn(f.astype(float))
    for r in range(6):
        for c in range(7):
            assert [int(m[r, c]) for m in marks] == plain_mixture(frames[:, r, c].tolist()), (r, c)


def test_shadows_count_by_weight():
    raw = np.zeros((20, 20), np.uint8)
    raw[5:12, 5:12] = 255
    raw[8, 8] = 127  # within the foreground
    raw[14:19, 14:19] = 127
    none, some, whole = (vision.foreground(raw, w, close=0) for w in (0.0, 0.5, 1.0))
    assert not none[15:18, 15:18].any() and not some[15:18, 15:18].any() and whole[15:18, 15:18].all()
    assert some[8, 8] and some[5:12, 5:12].all()


def moving_squares(spark, videos=2, frames=12):
    rows = []
    for v in range(videos):
        for f in range(frames):
            frame = np.full((64, 64), 100, np.uint8)
            frame[20:40, 5 + 3 * f : 25 + 3 * f] = 200
            rows.append((v, f, 64, 64, bytearray(frame.tobytes())))
    return spark.createDataFrame(rows, "video_id long, frame_no long, height int, width int, pixels binary")


def test_detector_hears_of_the_tracks(spark):
    """One pass is as detector, tracker and feedback step by step, with one frame's lag."""
    found = vision.detect_and_track(moving_squares(spark), "adaptive_mog2", "centroid", least_area=20)
    said = {r["video_id"]: r for r in vision.adaptive_diagnostics(found).collect()}
    state, tracker, rows = vision.Adaptive(), tracking.Centroid(), []
    for r in sorted(moving_squares(spark, 1).collect(), key=lambda r: r.frame_no):
        _, seen = vision.stepped(state, np.frombuffer(bytes(r.pixels), np.uint8).reshape(64, 64), 20)
        ids, hits = tracker.update(r.frame_no, np.array([b[:4] for b in seen], float).reshape(-1, 4))
        state.feedback(tracker.hits.tolist(), int((tracker.missed == 0).sum()))
        rows += [(r.frame_no, t, n) for t, n in zip(ids, hits, strict=True)]
    assert rows and state.prior < 1
    for v in (0, 1):
        assert {k: said[v][k] for k in vision.DIAGNOSTICS} == pytest.approx(state.diagnostics())
        assert sorted((r.frame_no, r.track_id, r.hits) for r in found.where(f"video_id = {v} and track_id is not null").collect()) == sorted(rows)
    mean = vision.diagnostics_means(vision.adaptive_diagnostics(found)).first()
    assert mean["n_videos"] == 2 and mean["avg_track_quality"] == pytest.approx(state.diagnostics()["avg_track_quality"])
    shown = vision.overlay(found).collect()
    assert len(shown) == 2 * len(rows) and all(r.label == f"ID {r.track_id}" for r in shown)
    assert {(r.video_id, r.track_id) for r in shown if r.is_longest} == {(v, max(rows, key=lambda x: (x[2], -x[1]))[1]) for v in (0, 1)}


def test_switch_log(spark):
    rows = [(0, f, 16, 16, bytearray(bytes([100]) * 256)) for f in range(25)]
    frames = spark.createDataFrame(rows, "video_id long, frame_no long, height int, width int, pixels binary")
    log = vision.switch_log(vision.detect_and_track(frames, "cascaded_fallback", "centroid", least_area=1000))
    assert sorted(map(tuple, log.collect())) == [(0, 10, "mog2", "dense_flow"), (0, 20, "dense_flow", "frame_diff")]
    assert vision.switch_log(vision.detect_and_track(frames.where("false"), "cascaded_fallback")).count() == 0


def test_keypoints_of_each_kind():
    from motionlake.functions import images
    from motionlake.operators import preprocess

    square = np.full((40, 40), 50, np.uint8)
    square[12:28, 12:28] = 200
    corners = images.strong_corners(square, 4)
    assert len(corners) == 4 and all(min(abs(x - a) for a in (12, 27)) <= 1 and min(abs(y - b) for b in (12, 27)) <= 1 for x, y in corners)
    dot = np.full((21, 21), 50, np.uint8)
    dot[10, 10] = 200
    assert (10, 10) in images.ring_corners(dot) and not images.ring_corners(np.full((21, 21), 9, np.uint8)) and not images.ring_corners(dot[:5])
    points = preprocess.frame_keypoints(square)
    assert {p[2] for p in points} >= {"corner", "grid"} and len({(x // 5, y // 5) for x, y, _ in points}) == len(points)
    assert len([p for p in preprocess.frame_keypoints(np.random.default_rng(0).integers(0, 255, (80, 90)).astype(np.uint8)) if p[2] == "ring"]) <= 50


def test_dense_descriptors(spark):
    from motionlake.operators import preprocess

    rng = np.random.default_rng(3)
    scene = rng.integers(0, 255, (40, 120)).astype(np.uint8)
    rows = [(0, f, 40, 60, bytearray(np.ascontiguousarray(scene[:, 3 * f : 3 * f + 60]).tobytes())) for f in range(3)] + [(1, f, 40, 60, bytearray(bytes(2400))) for f in range(2)] + [(2, 0, 40, 60, None)]
    out = preprocess.dense_descriptors(spark.createDataFrame(rows, "video_id long, frame_no long, height int, width int, pixels binary")).collect()
    assert sorted((r.video_id, r.frame_no) for r in out) == [(0, 1), (0, 2), (1, 1)]
    for r in out:
        flat = r.video_id == 1
        for kind in ("hog", "hof", "mbhx", "mbhy"):
            assert sum(r[f"dense_{kind}_bin_{i}"] for i in range(9)) == pytest.approx(0 if flat else 1, abs=1e-3), kind
        assert (r["dense_keypoint_density"] == 0) == flat and r["dense_texture_variance"] >= 0
        if not flat:
            assert r["dense_hof_bin_4"] > 0.5 and r["dense_flow_magnitude_mean"] > 1.5  # it moves to the left by three


def test_configurations_run(spark):
    from motionlake.plans import configured

    frames, small = moving_squares(spark), {"preprocessing": {"frame_resize": [64, 64]}, "detection": {"min_contour_area": 20}}
    for name in configured.names():
        config = configured.load(name, small)
        assert config["tracking"]["max_disappeared"] == 30 and "extends" not in config
    known = spark.createDataFrame([(0, f, 5 + 3 * f, 20, 20, 20) for f in range(12)], "video_id long, frame_no long, x long, y long, w long, h long")
    wide = {}
    for name in ("group_a", "group_e", "group_j", "legacy_centroid", "dataset_analysis"):
        rows = configured.video_vectors(frames, configured.load(name, small), known if name == "group_e" else None)
        wide[name] = len(rows.columns)
        assert sorted(r["video_id"] for r in rows.collect()) == [0, 1], name
    assert wide["group_a"] == 1 + 14 * 3 + 8 + 2 and wide["group_e"] == 1 + 45 * 3 + 8 + 2 and wide["dataset_analysis"] == 1 + 8 + 2
    with pytest.raises(ValueError):
        configured.build_detector({"detection": {"type": "ground_truth"}})
    with pytest.raises(KeyError):
        configured.build_features({"features": {"modules": ["no such"]}})


def test_configured_models_are_trained(spark, tmp_path):
    """models.active, targets, training and smoothing of a configuration."""
    import random

    from motionlake.plans import configured

    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, float(i % 2) + rng.gauss(0, 0.1), rng.gauss(0, 1)) for i in range(40)], "video_id long, a double, b double")
    labels = spark.createDataFrame([(i, "run" if i % 2 else "walk", None) for i in range(45)], "video_id long, activity string, distortion string")
    over = {"models": {"active": ["knn", {"name": "exact_tree", "params": {"max_depth": 1}}]}, "training": {"cv_folds": 2}, "smoothing": {"enabled": True, "method": "ema"}}
    config = configured.load("group_a", over)
    got = configured.train(vectors, labels, config, "activity", str(tmp_path / "run"))
    assert set(got["models"]) == {"knn", "exact_tree", "__smoothed__"} and all(m["cv_accuracy_mean"] > 0.9 for m in got["models"].values())
    assert configured.train(vectors, labels, config, "distortion") == {"viable": False, "error": "no samples"}
    assert not configured.train(vectors, labels, {"targets": ["distortion"]}, "activity")["viable"]


def test_feedback_and_looks_are_wired(spark):
    """The adaptive background model runs with its tracker, the tracker by appearance gets looks."""
    from motionlake.operators import preprocess, vision
    from motionlake.plans import configured

    frames, small = moving_squares(spark), {"preprocessing": {"frame_resize": [64, 64]}, "detection": {"min_contour_area": 20}}
    config = configured.load("group_i", small)
    ready = configured.build_preprocessor(config)(frames).select("video_id", "frame_no", "height", "width", "pixels")
    got = sorted(tuple(r) for r in configured.build_tracked(config)(ready).select("video_id", "frame_no", "det_id", "track_id").collect())
    how = {"threshold": 16, "history": 20, "relaxed": 10, "floor": 8, "enough": 0.4, "ema": 0.8}
    want = vision.detect_and_track(ready, "adaptive_mog2", "iou_hungarian", 20, how, {"max_gap": 30, "above": 0.3}).where("note is null")
    assert got == sorted(tuple(r) for r in want.select("video_id", "frame_no", "det_id", "track_id").collect())
    config = configured.load("group_j", small)
    boxes = configured.build_detector(config)(ready)
    want = tracking.track(preprocess.appearance(ready, boxes), "tfcr", max_gap=30, above=0.3)
    assert sorted(map(tuple, configured.build_tracked(config)(ready).collect())) == sorted(map(tuple, want.collect()))


def test_run_records(spark, tmp_path, capsys):
    import json

    import yaml

    from motionlake import cli

    for want in ("run_001", "run_002"):
        run = files.write_run(spark, str(tmp_path), {"a": {"b": [1]}}, {"n": 3})
        assert run.endswith(want) and yaml.safe_load((tmp_path / want / "config_snapshot.yaml").read_text()) == {"a": {"b": [1]}}
        meta = json.loads((tmp_path / want / "run_meta.json").read_text())
        assert meta["n"] == 3 and meta["git_commit"] and meta["timestamp"]
    assert files.git_commit("/no/such/folder") == "unknown"
    moving_squares(spark).write.parquet(str(tmp_path / "frames.parquet"))
    assert cli.main(["--config", "group_a", "--frames", str(tmp_path / "frames.parquet"), "--out", str(tmp_path)]) == 0
    assert spark.read.json(str(tmp_path / "run_003" / "features")).count() == 2
    assert cli.main(["--config", "group_c", "--config", "group_e", "--frames", str(tmp_path / "frames.parquet"), "--diagnose"]) == 0
    # With labels the models of a configuration are trained, each target in its turn.
    labels = spark.createDataFrame([(f"video {i}.mp4", "walk", "Fo") for i in range(2)], "`Name of Video Series` string, Activity string, Distortion string")
    labels.write.json(str(tmp_path / "labels.json"))
    assert cli.main(["--config", "group_a", "--frames", str(tmp_path / "frames.parquet"), "--manifest", str(tmp_path / "labels.json"), "--target", "both", "--out", str(tmp_path)]) == 0
    assert "activity: too few samples" in (said := capsys.readouterr().out) and "distortion: too few samples" in said
    assert cli.main(["--config", "group_a"]) == 1 and cli.main(["--list-configs"]) == 0 and "group_j" in capsys.readouterr().out


def test_models_persist_and_tell_chances(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassificationModel

    from motionlake.operators import models

    rows = spark.createDataFrame([(i, float(i % 7), float(i % 2), None if i == 3 else "ab"[i % 2]) for i in range(40)], "video_id long, f0 double, f1 double, label string")
    top = models.importances(rows, ["f0", "f1"], "label", "video_id", models.decision_tree()).collect()
    assert [(r.feature, r.place) for r in top] == [("f1", 1), ("f0", 2)] and top[0].importance == pytest.approx(1.0)
    chance = models.probabilities(rows, ["f0", "f1"], "label", "video_id", models.decision_tree()).collect()
    assert len(chance) == 2 * 39 and {r.probability for r in chance if (r.id % 2 == 0) == (r.label == "a")} == {1.0}
    hard = models.probabilities(rows, ["f0", "f1"], "label", "video_id", models.linear_svm()).where("probability = 1.0").collect()
    assert len(hard) == 39
    ready, labels = models.prepared(rows, ["f0", "f1"], "label", "video_id")
    models.save(models.decision_tree().fit(ready), labels, ["f0", "f1"], str(tmp_path / "m"), spark)
    again, names, features = models.load(DecisionTreeClassificationModel, str(tmp_path / "m"), spark)
    assert names == ["a", "b"] and features == ["f0", "f1"]
    assert again.transform(ready).where("prediction <> label").count() == 0
    said = models.out_of_fold(rows, ["f0", "f1"], "label", "video_id", models.decision_tree)
    assert said.count() == 39 and models.fold_scores(said).first()["accuracy_mean"] == 1.0
