"""The registered queries as SQL over the same tables (functions of the SQL engine where dialects differ)."""

from __future__ import annotations

import re

from ..functions import kernels, tables
from ..operators import shapes, tracks
from ..sources.views import VIEW_SQL

PI = "pi()"


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def query(views: str, ctes: str, final: str) -> str:
    parts = [VIEW_SQL[v] for v in views.split()] + ([ctes] if ctes else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


def skew(v: str, n: str) -> str:
    m = f"avg({v})"
    third = f"(avg(({v})*({v})*({v})) - 3*{m}*avg(({v})*({v})) + 2*{m}*{m}*{m})"
    return f"CASE WHEN {n} > 2 THEN {third} / pow(stddev_pop({v}), 3) ELSE 0.0 END"


STEPS = """steps AS (
  SELECT *, (accel - lag(accel) OVER w) * 10.0 AS jerk FROM (
    SELECT *, (speed - lag(speed) OVER w) * 10.0 AS accel,
           least(abs(angle - lag(angle) OVER w), 2 * pi() - abs(angle - lag(angle) OVER w)) AS turn FROM (
      SELECT *, sqrt(dx * dx + dy * dy) AS speed, atan2(dy, dx) AS angle FROM (
        SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lag(x) OVER w AS px, lag(y) OVER w AS py FROM track_points
        WINDOW w AS (PARTITION BY video_id, track_id ORDER BY seq)))
    WINDOW w AS (PARTITION BY video_id, track_id ORDER BY seq))
  WINDOW w AS (PARTITION BY video_id, track_id ORDER BY seq))"""
NET = "sqrt(pow(arg_max(x, seq) - arg_min(x, seq), 2) + pow(arg_max(y, seq) - arg_min(y, seq), 2))"
HEADING = "((degrees(angle) % 360) + 360) % 360"
TRAJ = f"""traj AS (
  SELECT video_id, track_id, n / 10.0 AS track_duration_sec, path / (n / 10.0) AS path_speed_px_s, net / (n / 10.0) AS net_displacement_speed_px_s,
         CASE WHEN path > 0 THEN net / path ELSE 0.0 END AS straightness, mean_speed_px_s, max_speed_px_s, std_speed_px_s, skew_speed, kurt_speed,
         mean_direction_deg, direction_std_deg, bbox_area, CAST(0 AS DOUBLE) AS mean_flow_magnitude, CAST(0 AS DOUBLE) AS mean_flow_angle_deg
  FROM (SELECT video_id, track_id, CAST(count(*) AS DOUBLE) AS n, sum(speed) AS path, {NET} AS net, avg(speed * 10) AS mean_speed_px_s, max(speed * 10) AS max_speed_px_s,
               stddev_pop(speed * 10) AS std_speed_px_s, {skew("speed * 10", "count(speed)")} AS skew_speed,
               CASE WHEN count(speed) > 2 THEN kurtosis_pop(speed * 10) ELSE 0.0 END AS kurt_speed, avg({HEADING}) AS mean_direction_deg, stddev_pop({HEADING}) AS direction_std_deg,
               (max(x) - min(x)) * (max(y) - min(y)) AS bbox_area
        FROM steps GROUP BY video_id, track_id) WHERE n >= 2)"""
LEN = "lens AS (SELECT video_id, track_id, count(*) AS len FROM track_points GROUP BY video_id, track_id)"
COLS = lambda names: ", ".join(r(n, n) for n in names)
OUT = f"""det AS (SELECT video_id, count(*) AS n_det, max(frame_no) + 1 AS n_frames FROM detections GROUP BY video_id),
{LEN},
trk AS (SELECT video_id, count(*) AS n_tracks, max(len) AS longest, CAST(sum(len) AS BIGINT) AS points FROM lens GROUP BY video_id),
outcomes AS (
  SELECT m.*, n_det, n_frames, n_tracks, longest, points,
         CASE WHEN n_frames IS NULL THEN 'file_missing' WHEN coalesce(n_det, 0) = 0 THEN 'detection_failure' WHEN longest < 30 THEN 'track_too_short'
              WHEN coalesce(n_tracks, 0) = 0 THEN 'tracking_failure' WHEN coalesce(n_valid, 0) = 0 THEN 'feature_failure' END AS reason
  FROM manifest m LEFT JOIN det USING (video_id) LEFT JOIN trk USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS n_valid FROM lens WHERE len >= 5 GROUP BY video_id) v USING (video_id))"""
KNN = """vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (
  SELECT q.vec_id AS id, b.vec_id AS other, b.label, list_distance(q.v, b.v) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v), b.vec_id) AS place
  FROM vec q JOIN vec b ON q.vec_id <> b.vec_id QUALIFY place <= 5),
votes AS (
  SELECT id, label AS predicted FROM (SELECT id, label, count(*) AS n FROM near GROUP BY id, label)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1),
judged AS (SELECT id, predicted, e.label AS truth FROM votes JOIN embeddings e ON e.vec_id = id)"""
MODELS = """long AS (
  SELECT id, truth, own, dim, CAST(v AS DOUBLE) AS v FROM (
    SELECT vec_id AS id, label AS truth, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS own, embedding FROM embeddings),
  LATERAL (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim)),
models(model, low, high) AS (VALUES ('all', 0, 64), ('first', 0, 32), ('last', 32, 64)),
means AS (SELECT k AS fold, truth AS predicted, dim, avg(v) AS m FROM long, range(5) f(k) WHERE own <> k GROUP BY 1, 2, 3),
far AS (
  SELECT model, id, truth, own, fold, predicted, sum((v - m) * (v - m)) AS d FROM long JOIN means USING (dim) JOIN models ON dim >= low AND dim < high {which}
  GROUP BY ALL),
said AS (SELECT model, id, truth, fold, own = fold AS held_out, predicted AS label FROM far QUALIFY row_number() OVER (PARTITION BY model, id, fold ORDER BY d, predicted) = 1)"""
SAID, SAID_ALL = MODELS.format(which="WHERE own = fold"), MODELS.format(which="")
MIRROR = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > 7 THEN 14 - ({e}) ELSE {e} END"


def taps(name: str, weights: list[tuple[int, int, int]]) -> str:
    rows = ", ".join(str(w) for w in weights)
    return f"""{name} AS (
  SELECT p.frame_no, p.r, p.c, CAST(sum(q.v * t.k) AS BIGINT) AS v FROM pixels p, (VALUES {rows}) t(dr, dc, k), pixels q
  WHERE q.frame_no = p.frame_no AND q.r = {MIRROR("(p.r + t.dr)")} AND q.c = {MIRROR("(p.c + t.dc)")}
  GROUP BY p.frame_no, p.r, p.c)"""


LAPLACE = taps("lap", [(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)])
GRADIENT = taps("gx", [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]) + ",\n" + taps("gy", [(-1, -1, -1), (-1, 0, -2), (-1, 1, -1), (1, -1, 1), (1, 0, 2), (1, 1, 1)])
QUALITY = f"""{LAPLACE},
{GRADIENT},
quality AS (
  SELECT * FROM (SELECT frame_no, avg(v) AS brightness FROM pixels GROUP BY frame_no)
  JOIN (SELECT frame_no, var_pop(v) AS laplacian_var FROM lap GROUP BY frame_no) USING (frame_no)
  JOIN (SELECT gx.frame_no, avg(sqrt(CAST(gx.v * gx.v + gy.v * gy.v AS DOUBLE))) AS tenengrad FROM gx JOIN gy USING (frame_no, r, c) GROUP BY gx.frame_no) USING (frame_no)
  JOIN (SELECT frame_no, avg(d) AS brenner FROM (SELECT frame_no, abs(v - lag(v) OVER (PARTITION BY frame_no, r ORDER BY c)) AS d FROM pixels) GROUP BY frame_no) USING (frame_no))"""
POOL_BINS = """
SELECT video_id, bin, {mean}, {std} FROM (
  SELECT f.frame_no // 50 AS video_id, CAST(b.bin AS BIGINT) AS bin, coalesce(h.n, 0) / (t.n + 1e-7) AS share
  FROM (SELECT DISTINCT frame_no FROM hist) f CROSS JOIN (SELECT unnest(range({n})) AS bin) b
  LEFT JOIN hist h ON h.frame_no = f.frame_no AND h.bin = b.bin
  JOIN (SELECT frame_no, sum(n) AS n FROM hist GROUP BY frame_no) t ON t.frame_no = f.frame_no) GROUP BY video_id, bin"""
LBP = """ring AS (SELECT * FROM (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,1),(4,1,1),(5,1,0),(6,1,-1),(7,0,-1)) t(b, dr, dc)),
code AS (
  SELECT p.frame_no, p.r, p.c, CAST(sum(CASE WHEN p.v >= q.v THEN 1 << b ELSE 0 END) AS INT) AS code
  FROM pixels p, ring, pixels q WHERE q.frame_no = p.frame_no AND q.r = (p.r - dr + 8) % 8 AND q.c = (p.c - dc + 8) % 8
  GROUP BY p.frame_no, p.r, p.c),
hist AS (
  SELECT frame_no, CASE WHEN bit_count(xor(code, (code >> 1) | ((code & 1) << 7))) <= 2 THEN bit_count(code) ELSE 9 END AS bin, CAST(count(*) AS DOUBLE) AS n
  FROM code GROUP BY 1, 2)"""
DIFF = """diff AS (
  SELECT frame_no // 50 AS video_id, frame_no, abs(v - lag(v) OVER (PARTITION BY frame_no // 50, r, c ORDER BY frame_no)) AS d FROM pixels),
change AS (
  SELECT video_id, frame_no, avg(d) AS mean_change, greatest(25, CAST(floor(quantile_cont(d, CAST(0.75 AS DOUBLE)) * CAST(1.5 AS DOUBLE)) AS BIGINT)) AS threshold, list(d) AS ds
  FROM diff WHERE d IS NOT NULL GROUP BY video_id, frame_no)"""
WINDOWED = "events_at AS (SELECT *, CAST(epoch(ts) AS BIGINT) AS sec FROM events)"
FLOW = f"""vecs AS (
  SELECT video_id, seq AS frame_no, sqrt(dx * dx + dy * dy) AS mag, least(CAST(floor((CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END) / (pi() / 4)) AS BIGINT), 7) AS bin
  FROM steps WHERE dx IS NOT NULL),
per AS (SELECT video_id, frame_no, avg(mag) AS mag, count_if(mag > 1) / count(*) AS moving, {", ".join(f"count_if(bin = {b} AND mag > 1) AS c{b}" for b in range(8))} FROM vecs GROUP BY video_id, frame_no),
shared AS (SELECT video_id, mag, moving, abs(mag - lag(mag) OVER (PARTITION BY video_id ORDER BY frame_no)) AS jerk, {", ".join(f"c{b} / ({' + '.join(f'c{i}' for i in range(8))} + 1e-7) AS h{b}" for b in range(8))} FROM per),
pooled AS (SELECT video_id, avg(mag) AS flow_mean_mag, stddev_pop(mag) AS flow_std_mag, max(mag) AS flow_max_mag, avg(moving) AS flow_prop_moving, coalesce(avg(jerk), 0) AS flow_jerk,
  {", ".join(f"avg(h{b}) AS flow_hof_mean_{b}, stddev_pop(h{b}) AS flow_hof_std_{b}" for b in range(8))} FROM shared GROUP BY video_id)"""
FLOW_MASS = "(" + " + ".join(f"flow_hof_mean_{b}" for b in range(8)) + " + 1e-7)"
FLOW_ENTROPY = "-(" + " + ".join(f"CASE WHEN flow_hof_mean_{b} > 0 THEN flow_hof_mean_{b} / {FLOW_MASS} * ln(flow_hof_mean_{b} / {FLOW_MASS} + 1e-12) ELSE 0 END" for b in range(8)) + ")"

SQL: dict[str, str] = {
    "trajectory_track": query("track_points", f"{STEPS},\n{TRAJ}", f"SELECT video_id, track_id, {COLS(tracks.TRAJECTORY)} FROM traj"),
    "trajectory_video": query("track_points", f"{STEPS},\n{TRAJ}", "SELECT video_id, count(*) AS n_valid_tracks, " + ", ".join(r(f"{f}({n})", f"{n}_{s}") for n in tracks.TRAJECTORY for s, f in (("mean", "avg"), ("max", "max"), ("std", "stddev_pop"))) + " FROM traj GROUP BY video_id"),
    "circular_motion": query("track_points", f"""{STEPS},
mid AS (SELECT video_id, track_id, avg(cos(angle)) AS c, avg(sin(angle)) AS s FROM steps WHERE angle IS NOT NULL GROUP BY video_id, track_id)""", f"""
SELECT video_id, track_id, {r("any_value(atan2(s, c))", "circular_mean_rad")}, {r("1 - any_value(sqrt(c * c + s * s))", "circular_variance")}, {r("any_value(sqrt(c * c + s * s))", "direction_concentration")},
       {r("stddev_pop(atan2(sin(angle - atan2(s, c)), cos(angle - atan2(s, c))))", "angular_dispersion")}
FROM steps JOIN mid USING (video_id, track_id) WHERE angle IS NOT NULL GROUP BY video_id, track_id"""),
    "kinematics": query("track_points", STEPS, "SELECT video_id, track_id, " + ", ".join([f"{r(f'avg({c})', f'mean_{u}')}, {r(f'stddev_pop({c})', f'std_{u}')}, {r(f'max(abs({c}))', f'max_{u}')}, {r(skew(c, f'count({c})'), f'skew_{c}')}" for c, u in (("accel", "accel_px_s2"), ("jerk", "jerk_px_s3"))]) + " FROM steps GROUP BY video_id, track_id HAVING count(jerk) >= 2"),
    "shape_curvature": query("track_points", STEPS, f"""
SELECT video_id, track_id, {r("avg(turn)", "mean_curvature")}, {r("stddev_pop(turn)", "std_curvature")}, {r("sum(turn) / (count(*) / 10.0)", "turning_rate_rad_s")},
       {r(f"CASE WHEN sum(speed) > 0 THEN {NET} / sum(speed) ELSE 0 END", "path_efficiency")} FROM steps GROUP BY video_id, track_id HAVING count(*) >= 4"""),
    "dense_trajectory": query("track_points", STEPS, f"""
SELECT video_id, track_id, {r("count(*)", "dense_traj_length")}, {r(NET, "dense_traj_displacement")}, {r("avg(speed)", "dense_traj_mean_speed")}, {r("stddev_pop(speed)", "dense_traj_std_speed")},
       {r("avg(angle)", "dense_traj_direction_mean")}, {r("stddev_pop(angle)", "dense_traj_direction_std")} FROM steps GROUP BY video_id, track_id HAVING count(*) >= 15"""),
    "interaction": query("track_points", f"""{STEPS},
full_ AS (SELECT *, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM steps),
seen AS (
  SELECT a.video_id, a.track_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, abs(a.speed - b.speed) * 10 AS rel,
         coalesce(sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) < 100, false) AS was_near
  FROM full_ a JOIN full_ b ON a.video_id = b.video_id AND a.seq = b.seq AND a.track_id <> b.track_id WHERE a.n >= 15 AND b.n >= 2)""", f"""
SELECT video_id, track_id, {r("avg(d)", "mean_pairwise_distance")}, {r("min(d)", "min_pairwise_distance")}, {r("stddev_pop(d)", "std_pairwise_distance")}, {r("coalesce(avg(rel), 0)", "mean_relative_speed_px_s")},
       {r("coalesce(max(rel), 0)", "max_relative_speed_px_s")}, {r("count_if(d < 100) / count(*)", "proximity_duration_ratio")}, {r("count_if(d < 100 AND NOT was_near) / (count(*) / 10.0)", "proximity_event_rate_s")}
FROM seen GROUP BY video_id, track_id"""),
    "temporal_context": query("track_points", LEN, f"""
SELECT video_id, {r("count(*)", "temporal_n_tracks")}, {r("count_if(len >= 15)", "temporal_n_long_tracks")}, {r("stddev_pop(len)", "temporal_spread")}, {r("any_value((sx + sy) / 2)", "temporal_spatial_spread")},
       {r("count_if(len >= 15) * (count_if(len >= 15) - 1) / 2", "temporal_overlap_count")}, {r("sum(len) / any_value(f)", "temporal_tracks_per_frame")}, {r("avg(len)", "temporal_mean_track_len")}, {r("max(len)", "temporal_max_track_len")}
FROM lens JOIN (SELECT video_id, stddev_pop(x) AS sx, stddev_pop(y) AS sy, max(seq) + 1 AS f FROM track_points GROUP BY video_id) USING (video_id) GROUP BY video_id"""),
    "tracker_metrics": query("track_points", """per AS (SELECT video_id, track_id, count(*) AS len, max(seq) AS last FROM track_points GROUP BY video_id, track_id),
lens AS (SELECT *, max(last) OVER (PARTITION BY video_id) - last AS disappeared, max(last) OVER (PARTITION BY video_id) + 1 AS frames FROM per)""", "SELECT video_id, count(*) AS n_tracks, " + ", ".join([r("avg(len)", "mean_track_length"), r("quantile_cont(len, CAST(0.5 AS DOUBLE))", "median_track_length"), r("stddev_pop(len)", "std_track_length"), "max(len) AS max_track_length", "min(len) AS min_track_length", r("sum(len) / (count(*) * max(frames))", "track_coverage"), r("count(*) / max(frames)", "tracks_per_frame")] + [f"count_if(len >= {t})::BIGINT AS tracks_ge_{t}_frames, {r(f'count_if(len >= {t}) / count(*) * 100', f'tracks_ge_{t}_pct')}" for t in (15, 30, 45, 60, 90)] + ["count_if(disappeared > 0)::BIGINT AS tracks_with_gaps", r("1 - count_if(disappeared > 0) / count(*)", "track_continuity")]) + " FROM lens GROUP BY video_id"),
    "length_percentiles": query("track_points", LEN, "SELECT " + ", ".join(r(f"quantile_cont(len, CAST({p / 100} AS DOUBLE))", f"percentile_{p}") for p in (10, 25, 50, 75, 90)) + " FROM lens"),
    "length_retention": query("track_points", LEN + """,
kept AS (
  SELECT CAST(t AS BIGINT) AS threshold, count_if(len >= t)::BIGINT AS retained_tracks, count_if(len >= t) / count(*) * 100 AS retention_rate, coalesce(avg(CASE WHEN len >= t THEN len END), 0) AS mean_len
  FROM lens, range(5, 101, 5) q(t) GROUP BY t)""", f"""
SELECT threshold, retained_tracks, {r("retention_rate", "retention_rate")}, {r("mean_len", "mean_length_retained")},
       coalesce(threshold = (SELECT min(threshold) FROM kept WHERE threshold IN (30, 45, 60) AND retention_rate >= 80), false) AS recommended FROM kept"""),
    "length_histogram": query("track_points", LEN, """
SELECT least(CAST(floor((len - low) / greatest((high - low) / CAST(30 AS DOUBLE), 1e-12)) AS BIGINT), 29) AS bin, count(*) AS n
FROM lens, (SELECT min(len) AS low, max(len) AS high FROM lens) GROUP BY 1"""),
    "track_confidence": query("track_points", LEN, f"SELECT video_id, {r('avg(least(len / CAST(15 AS DOUBLE), 1))', 'confidence')} FROM lens GROUP BY video_id"),
    "trajectory_cap": query("track_points", "", f"SELECT video_id, track_id, seq, {r('x', 'x')}, {r('y', 'y')} FROM track_points QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY seq DESC) <= 20"),
    "ema_track_quality": query("track_points", "w AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY seq DESC) - 1 AS k FROM track_points)", f"SELECT video_id, track_id, {r('pow(CAST(0.8 AS DOUBLE), count(*)) + CAST(0.2 AS DOUBLE) * sum(pow(CAST(0.8 AS DOUBLE), k) * y / 100)', 'quality')} FROM w GROUP BY video_id, track_id"),
    "detection_stats": query("detections", """per AS (
  SELECT video_id, frame_no, count_if(w * h >= 1500) AS n FROM detections GROUP BY video_id, frame_no)""", f"""
SELECT video_id, count(*) AS n_frames, {r("avg(n)", "mean_per_frame")}, {r("stddev_pop(n)", "std_per_frame")}, max(n)::BIGINT AS max_per_frame, count_if(n = 0)::BIGINT AS zero_frames, sum(n)::BIGINT AS total FROM per GROUP BY video_id"""),
    "iou_pairs": query("detections", """pairs AS (
  SELECT a.video_id, a.frame_no, a.det_id AS det_a, b.det_id AS det_b,
         greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s
  FROM detections a JOIN detections b ON a.video_id = b.video_id AND a.frame_no + 1 = b.frame_no)""", f"SELECT video_id, frame_no, det_a, det_b, {r('i / CAST(s - i AS DOUBLE)', 'iou')} FROM pairs WHERE i / CAST(s - i AS DOUBLE) > CAST(0.3 AS DOUBLE)"),
    "centroid_distance_topk": query("detections", """c AS (SELECT *, x + w // 2 AS cx, y + h // 2 AS cy FROM detections),
pairs AS (
  SELECT a.video_id, a.frame_no, a.det_id AS det_a, b.det_id AS det_b, sqrt(CAST((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS DOUBLE)) AS distance
  FROM c a JOIN c b ON a.video_id = b.video_id AND a.frame_no + 1 = b.frame_no)""", f"""
SELECT video_id, frame_no, det_a, det_b, {r("distance", "distance")}, row_number() OVER (PARTITION BY video_id, frame_no, det_a ORDER BY distance, det_b) AS place FROM pairs QUALIFY place <= 2"""),
    "bbox_normalise": query("detections manifest", "", "SELECT video_id, det_id, " + ", ".join(f"(2000000 * {c} + {s}) // (2 * {s}) / CAST(1000000 AS DOUBLE) AS n{c}" for c, s in (("x", "width"), ("y", "height"), ("w", "width"), ("h", "height"))) + " FROM detections JOIN manifest USING (video_id)"),
    "frame_sampling": query("detections", "", "SELECT * FROM detections WHERE frame_no % 5 = 0"),
    "clip_indices": query("detections", "n AS (SELECT video_id, max(frame_no) + 1 AS n_frames FROM detections GROUP BY video_id)", """
SELECT video_id, n_frames, CAST(i AS BIGINT) AS slot, CAST(CASE WHEN n_frames >= 16 THEN floor(i * (n_frames - 1) / CAST(15 AS DOUBLE)) ELSE least(i, n_frames - 1) END AS BIGINT) AS frame_no FROM n, range(16) t(i)"""),
    "resolution_stats": query("manifest", "k AS (SELECT * FROM manifest WHERE width > 0 AND height > 0)", "SELECT count(DISTINCT (width, height)) AS unique_count, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, {r(f'avg({c})', f'mean_{c}')}, {r(f'stddev_pop({c})', f'std_{c}')}" for c in ("width", "height")) + """, count(DISTINCT (width, height)) = 1 AS all_same,
       (SELECT width FROM k GROUP BY width, height ORDER BY count(*) DESC, width, height LIMIT 1) AS common_width, (SELECT height FROM k GROUP BY width, height ORDER BY count(*) DESC, width, height LIMIT 1) AS common_height FROM k"""),
    "fps_duration_stats": query("manifest", "", "SELECT " + ", ".join(f"{r(f'min({c}) FILTER ({c} > 0)', f'min_{c}')}, {r(f'max({c}) FILTER ({c} > 0)', f'max_{c}')}, {r(f'avg({c}) FILTER ({c} > 0)', f'mean_{c}')}, {r(f'stddev_pop({c}) FILTER ({c} > 0)', f'std_{c}')}, count(DISTINCT {c}) FILTER ({c} > 0) = 1 AS same_{c}" for c in ("fps", "duration_s")) + " FROM manifest"),
    "min_length_report": query("manifest", "", f"SELECT {r('30 / (avg(fps) FILTER (fps > 0))', 'seconds')}, {r('30 / ((avg(fps) FILTER (fps > 0)) * (avg(duration_s) FILTER (duration_s > 0))) * 100', 'percent_of_video')} FROM manifest"),
    "sampling_steps": query("manifest", "n AS (SELECT video_id, CAST(floor(fps * duration_s) AS BIGINT) AS frames FROM manifest)", """
SELECT video_id, frames, CASE WHEN frames > 100 THEN greatest(1, frames // 100) ELSE 1 END::BIGINT AS step,
       least(30, greatest(10, CAST(floor(frames * CAST(0.6 AS DOUBLE)) AS BIGINT)))::BIGINT AS reference_len FROM n"""),
    "group_manifest": query("manifest", "", "SELECT activity, distortion, count(*) AS n, min(series_name) AS first_name, max(series_name) AS last_name FROM manifest GROUP BY activity, distortion"),
    "group_names": query("manifest", "", "SELECT activity, series_name AS name, row_number() OVER (PARTITION BY activity ORDER BY series_name, video_id) AS place FROM manifest"),
    "distinct_distortions": query("manifest", "", "SELECT DISTINCT distortion FROM manifest WHERE distortion IS NOT NULL"),
    "group_sample": query("manifest", "", f"SELECT video_id, series_name, activity, distortion, {r('fps', 'fps')}, {r('duration_s', 'duration_s')}, width, height FROM manifest QUALIFY row_number() OVER (PARTITION BY activity, distortion ORDER BY video_id) <= 2"),
    "missing_videos_anti": query("manifest detections", "", "SELECT video_id, series_name FROM manifest WHERE video_id NOT IN (SELECT video_id FROM detections)"),
    "existing_videos_semi": query("manifest detections", "", "SELECT video_id, series_name FROM manifest WHERE video_id IN (SELECT video_id FROM detections)"),
    "manifest_left_join": query("manifest detections", "n AS (SELECT video_id, count(DISTINCT frame_no) AS n_frames FROM detections GROUP BY video_id)", f"""
SELECT video_id, n_frames, {r("n_frames", "meta_num_frames")}, {r("CASE WHEN fps > 0 THEN fps ELSE 10 END", "meta_fps")}, {r("coalesce(duration_s, n_frames / greatest(CASE WHEN fps > 0 THEN fps ELSE 10 END, 1))", "meta_duration_sec")}
FROM n LEFT JOIN manifest USING (video_id)"""),
    "failure_reason": query("manifest detections track_points", OUT, "SELECT video_id, n_det, n_frames, n_tracks, longest, reason FROM outcomes"),
    "detector_stats_by_group": query("manifest detections track_points", OUT, f"""
SELECT distortion, count(*) AS total, count_if(reason IS NULL)::BIGINT AS successful, count_if(reason IS NOT NULL)::BIGINT AS failed, coalesce(count_if(reason = 'file_missing'), 0)::BIGINT AS file_missing,
       coalesce(count_if(reason = 'detection_failure'), 0)::BIGINT AS failure_detection, coalesce(count_if(reason = 'track_too_short'), 0)::BIGINT AS failure_track_too_short, coalesce(sum(n_tracks), 0)::BIGINT AS n_tracks_total,
       coalesce(sum(n_frames), 0)::BIGINT AS n_frames_total, {r("CASE WHEN sum(n_tracks) > 0 THEN sum(points) / sum(n_tracks) ELSE 0 END", "mean_track_length")}, {r("count_if(reason IS NULL) / count(*) * 100", "success_rate")}
FROM outcomes GROUP BY distortion"""),
    "failures_by_class": query("manifest detections track_points", OUT, """
SELECT activity, count(*) AS n_failed, string_agg(CASE WHEN place <= 3 THEN CAST(video_id AS VARCHAR) END, ',' ORDER BY video_id) AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY activity ORDER BY video_id) AS place FROM outcomes WHERE reason IS NOT NULL) GROUP BY activity"""),
    "run_summary": query("manifest detections track_points", OUT, f"""
SELECT count(*) AS n_videos, count_if(reason IS NULL)::BIGINT AS n_successful, count_if(reason IS NOT NULL)::BIGINT AS n_failed, count(DISTINCT activity) AS n_activities, count(DISTINCT distortion) AS n_distortions, {r("count_if(reason IS NULL) / count(*) * 100", "success_rate")} FROM outcomes"""),
    "failure_taxonomy": query("manifest detections track_points", OUT, "SELECT series_name, activity, distortion, reason FROM outcomes WHERE reason IS NOT NULL"),
    "clip_dataset": query("manifest detections", """picked AS (
  SELECT video_id, activity AS label FROM manifest WHERE video_id IN (SELECT video_id FROM detections) AND activity IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY activity ORDER BY video_id) <= 3)""", "SELECT video_id, label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM picked"),
    "augmentation_plan": query("manifest", "u AS (SELECT video_id, " + ", ".join(f"CAST('0x' || substr(md5(video_id || ':0:{n}'), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS {n}" for n in ("top", "left_", "flip", "brightness", "contrast")).replace(":0:left_", ":0:left") + " FROM manifest)", f"""
SELECT video_id, CAST(floor(top * 17) AS BIGINT) AS top, CAST(floor(left_ * 17) AS BIGINT) AS "left", flip < 0.5 AS flip, {r("0.8 + 0.4 * brightness", "brightness")}, {r("0.8 + 0.4 * contrast", "contrast")} FROM u"""),
    "ground_truth_boxes": query("detections", "", """
SELECT video_id, frame_no, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.w * b.h AS area
FROM (SELECT video_id, frame_no, min({'x': x, 'y': y, 'w': w, 'h': h}) AS b FROM detections WHERE det_id % 3 = 0 AND frame_no % 2 = 0 GROUP BY video_id, frame_no)"""),
    "ground_truth_files": query("manifest", """listed AS (
  SELECT video_id, series_name || e AS file FROM (
    SELECT video_id, series_name, unnest(['.txt', CASE WHEN video_id % 2 = 0 THEN '_groundtruth.csv' END, CASE WHEN video_id % 3 = 0 THEN '_gt.txt' END, CASE WHEN video_id % 5 = 0 THEN '_a_gt.txt' END, '.mp4']) AS e FROM manifest)
  WHERE e IS NOT NULL AND (video_id % 7 > 0 OR e = '.mp4')),
ranked AS (SELECT *, CASE WHEN file LIKE '%\\_gt.txt' ESCAPE '\\' THEN 0 WHEN file LIKE '%groundtruth%' THEN 1 WHEN file LIKE '%.txt' THEN 2 END AS rank FROM listed)""", "SELECT video_id, file FROM ranked WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY rank, file) = 1"),
    "class_distribution": "SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY label",
    "class_weights": f"""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
SELECT toxic::BIGINT AS toxic, n, {r("(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)", "balanced")}, {r("(1 / n) / (SELECT sum(1 / n) FROM c)", "inverse")}, {r("(SELECT max(n) FROM c) / n", "to_largest")} FROM c""",
    "training_viability": """SELECT sum(n)::BIGINT AS samples, count(*) AS classes, min(n) AS smallest,
  CASE WHEN sum(n) < count(*) * 3 THEN 'too few samples' WHEN min(n) < 3 THEN 'rare classes' WHEN sum(n) < count(*) * 5 THEN 'too few for folds' ELSE 'OK' END AS message
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""",
    "label_encode": "SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer",
    "stratified_folds": """SELECT fold, label::BIGINT AS label, count(*) AS n, sum(vec_id)::BIGINT AS ids
FROM (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings) GROUP BY fold, label""",
    "stratified_holdout": """SELECT vec_id, label::BIGINT AS label,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) <= ceil(count(*) OVER (PARTITION BY label) * CAST(0.2 AS DOUBLE)) AND count(*) OVER (PARTITION BY label) > 1 AS held_out FROM embeddings""",
    "zscore": f"""WITH long AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT id, CAST(dim AS BIGINT) AS dim, {r("(v - avg(v) OVER (PARTITION BY dim)) / CASE WHEN stddev_pop(v) OVER (PARTITION BY dim) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY dim) END", "z")} FROM long""",
    "knn": query("", KNN, f"SELECT id, other, {r('distance', 'distance')}, place FROM near"),
    "knn_vote": query("", KNN, "SELECT id, predicted::BIGINT AS predicted, truth::BIGINT AS truth FROM judged"),
    "confusion_matrix": query("", KNN, "SELECT truth::BIGINT AS truth, predicted::BIGINT AS predicted, count(*) AS n FROM judged GROUP BY truth, predicted"),
    "weighted_f1": query("", KNN + """,
cls AS (
  SELECT t.c, support, hit, coalesce(called, 0) AS called
  FROM (SELECT truth AS c, count(*) AS support, count_if(truth = predicted) AS hit FROM judged GROUP BY truth) t
  LEFT JOIN (SELECT predicted AS c, count(*) AS called FROM judged GROUP BY predicted) p USING (c)),
pr AS (SELECT *, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS p, hit / support AS q FROM cls)""", f"""
SELECT {r("sum(hit) / sum(support)", "accuracy")}, {r("sum(p * support) / sum(support)", "precision")}, {r("sum(q * support) / sum(support)", "recall")}, {r("sum(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END * support) / sum(support)", "f1")} FROM pr"""),
    "cv_summary": query("", SAID_ALL, f"""
SELECT model, {r("avg(accuracy) FILTER (held_out)", "accuracy_mean")}, {r("stddev_pop(accuracy) FILTER (held_out)", "accuracy_std")}, {r("avg(accuracy) FILTER (NOT held_out)", "train_mean")}, {r("stddev_pop(accuracy) FILTER (NOT held_out)", "train_std")},
       {r("avg(accuracy) FILTER (NOT held_out) - avg(accuracy) FILTER (held_out)", "overfit_gap")}
FROM (SELECT model, fold, held_out, avg(CAST(label = truth AS INT)) AS accuracy FROM said GROUP BY 1, 2, 3) GROUP BY model"""),
    "majority_vote": query("", SAID, """
SELECT id, label::BIGINT AS predicted FROM (SELECT id, label, count(*) AS n FROM said GROUP BY id, label) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1"""),
    "ema_vote": query("", SAID + """,
acc AS (SELECT model, avg(CAST(label = truth AS INT)) AS accuracy FROM said GROUP BY model),
wt AS (SELECT model, round(pow(CAST(0.7 AS DOUBLE), row_number() OVER (ORDER BY accuracy, model) - 1), 9) AS weight FROM acc)""", """
SELECT id, label::BIGINT AS predicted FROM (SELECT id, label, sum(weight) AS n FROM said JOIN wt USING (model) GROUP BY id, label) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1"""),
    "top_features": f"""WITH long AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
cls AS (SELECT dim, label, count(*) AS n, avg(v) AS m FROM long GROUP BY dim, label)
SELECT CAST(dim AS BIGINT) AS dim, {r("b / w", "ratio")} FROM (
  SELECT dim, sum(n * pow(m - mean, 2)) / sum(n) AS b, any_value(var) AS w FROM cls JOIN (SELECT dim, avg(v) AS mean, var_pop(v) AS var FROM long GROUP BY dim) USING (dim) GROUP BY dim)
ORDER BY b / w DESC, dim LIMIT 10""",
    "frame_quality": query("pixels", QUALITY, f"SELECT frame_no, {COLS(('brightness', 'laplacian_var', 'tenengrad', 'brenner'))} FROM quality"),
    "distortion_label": query("pixels", QUALITY, f"""
SELECT frame_no, CASE WHEN laplacian_var < 100 AND (brightness < 60 OR brightness > 195) THEN 'blurry+exposure' WHEN laplacian_var < 100 THEN 'blurry' WHEN brightness < 60 THEN 'underexposed' WHEN brightness > 195 THEN 'overexposed' ELSE 'pristine' END AS distortion_type,
       laplacian_var < 100 AS is_blurry, {r("1 - least(laplacian_var / 500, 1)", "blur_score")} FROM quality"""),
    "diagnostic_pool": query("pixels", QUALITY, "SELECT frame_no // 50 AS video_id, " + ", ".join(r(f"{f}({c})", f"diag_{n}_{s}") for n, c in (("laplacian", "laplacian_var"), ("tenengrad", "tenengrad"), ("brenner", "brenner")) for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + f""", {r("avg(brightness)", "diag_brightness_mean")}, {r("var_pop(brightness)", "diag_brightness_var")}, {r("max(brightness) - min(brightness)", "diag_dynamic_range")}, {r("count_if(laplacian_var < 50) / count(*)", "diag_low_contrast_ratio")} FROM quality GROUP BY 1"""),
    "lbp_uniform": query("pixels", LBP, POOL_BINS.format(n=10, mean=r("avg(share)", "mean"), std=r("stddev_pop(share)", "std"))),
    "orientation_hist": query("pixels", GRADIENT + """,
hist AS (
  SELECT frame_no, least(CAST(floor(atan2(abs(gy.v), abs(gx.v)) / (pi() / 6)) AS BIGINT), 5) AS bin, sum(sqrt(CAST(gx.v * gx.v + gy.v * gy.v AS DOUBLE))) AS n FROM gx JOIN gy USING (frame_no, r, c) GROUP BY 1, 2)""", POOL_BINS.format(n=6, mean=r("avg(share)", "mean"), std=r("stddev_pop(share)", "std"))),
    "frame_diff_threshold": query("pixels", DIFF, f"SELECT video_id, frame_no, {r('mean_change', 'mean_change')}, threshold, len(list_filter(ds, lambda v: v > threshold))::BIGINT AS moving FROM change"),
    "rolling_flow_threshold": query("pixels", DIFF, f"""
SELECT video_id, frame_no, {r("mean_change", "mean_change")}, {r("CASE WHEN count(mean_change) OVER w >= 5 THEN greatest(2, avg(mean_change) OVER w + CAST(0.5 AS DOUBLE) * stddev_pop(mean_change) OVER w) ELSE 2 END", "adaptive")}
FROM change WINDOW w AS (PARTITION BY video_id ORDER BY frame_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""),
    "mask_score": query("detections", """blobs AS (
  SELECT video_id, frame_no, sum(w * h) / CAST(307200 AS DOUBLE) AS coverage, count(*) AS n_blobs, quantile_cont(w * h, CAST(0.5 AS DOUBLE)) AS median_area FROM detections WHERE w * h >= 500 GROUP BY video_id, frame_no),
scored AS (
  SELECT *, CASE WHEN coverage < 0.0005 OR coverage > 0.25 THEN 0 ELSE least(greatest(least(greatest(1 - abs(coverage - 0.02) / 0.23, 0), 1) * least(greatest(1 - n_blobs / CAST(30 AS DOUBLE), 0), 1) * tanh(median_area / 307200 / CAST(0.002 AS DOUBLE)), 0), 1) END AS score FROM blobs)""", f"""
SELECT video_id, frame_no, {r("coverage", "coverage")}, n_blobs, {r("median_area", "median_area")}, {r("score", "score")}, {r("CASE WHEN score >= 0.4 THEN 16 ELSE least(greatest(16 - 6 * (1 - score / CAST(0.4 AS DOUBLE)), 8), 16) END", "threshold")} FROM scored"""),
    "flow_pool": query("track_points", f"{STEPS},\n{FLOW}", "SELECT video_id, " + COLS(["flow_mean_mag", "flow_std_mag", "flow_max_mag", "flow_prop_moving", "flow_jerk", *(f"flow_hof_{s}_{b}" for b in range(8) for s in ("mean", "std"))]) + f", {r(FLOW_ENTROPY, 'flow_dir_entropy')} FROM pooled"),
    "tumbling_event_counts": query("", WINDOWED, "SELECT sec - sec % 86400 AS start, event_type, count(*) AS n FROM events_at GROUP BY 1, 2"),
    "sliding_event_values": query("", WINDOWED, f"""
SELECT sec - sec % 86400 - back AS start, count(*) AS n, {r("avg(value)", "mean_value")}, {r("max(value)", "max_value")} FROM events_at, (VALUES (0), (86400)) t(back) GROUP BY 1"""),
    "session_events": query("", """marked AS (
  SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events),
runs AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)""", "SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM runs GROUP BY user_id, run"),
}
#: The registered components, told anew.
_NAMES = {
    "preprocessor": "passthrough standard distortion_aware", "detector": "frame_diff mog2 adaptive_mog2 dense_flow cascaded_fallback ground_truth", "tracker": "centroid iou_hungarian sort tfcr",
    "feature": "trajectory circular_motion kinematics shape hull wavelet interaction", "model": "decision_tree random_forest boosted_trees linear_svm",
}
SQL["components"] = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}')" for c, own in _NAMES.items() for n in own.split()) + ") t(category, name)"
SQL["hull_features"] = query("track_points", """sized AS (SELECT video_id, track_id, count(*) AS n FROM track_points GROUP BY video_id, track_id HAVING count(*) >= 4),
p AS (SELECT DISTINCT video_id, track_id, CAST(round(x * 100) AS BIGINT) AS x, CAST(round(y * 100) AS BIGINT) AS y FROM track_points),
-- An edge has all points on its left, and those on its line between its ends.
edge AS (
  SELECT a.video_id, a.track_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.video_id = b.video_id AND a.track_id = b.track_id AND (a.x <> b.x OR a.y <> b.y)
  JOIN p c ON c.video_id = a.video_id AND c.track_id = a.track_id
  GROUP BY ALL HAVING bool_and(CASE WHEN (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) THEN (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0
                                    ELSE (b.x - a.x) * (c.y - a.y) > (b.y - a.y) * (c.x - a.x) END)),
hull AS (SELECT video_id, track_id, sum(ax * by_ - bx * ay) / CAST(20000 AS DOUBLE) AS area, sum(sqrt(CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE))) / 100 AS around FROM edge GROUP BY video_id, track_id)""", f"""
SELECT video_id, track_id, {r("coalesce(area, 0)", "convex_hull_area")}, {r("CASE WHEN around > 0 THEN 4 * pi() * area / (around * around) ELSE 0 END", "compactness")} FROM sized LEFT JOIN hull USING (video_id, track_id)""")


def _wavelet_level(before: str, name: str) -> str:
    """One level of a db4 decomposition: rows (track, n, i, a, d) from rows (track, n, i, a), mirrored at both ends."""
    taps = ", ".join(f"({j}, {low!r}::DOUBLE, {high!r}::DOUBLE)" for j, (low, high) in enumerate(zip(kernels.DB4.tolist(), kernels.DB4_HIGH.tolist(), strict=True)))
    place = "(2 * m.i + 1 - j)"
    mirrored = f"CASE WHEN {place} < 0 THEN -1 - {place} WHEN {place} >= b.n THEN 2 * b.n - 1 - {place} ELSE {place} END"
    return f"""{name} AS (
  SELECT video_id, track_id, (n + 7) // 2 AS n, i, sum(a * low) AS a, sum(a * high) AS d FROM (
    SELECT b.video_id, b.track_id, b.n, m.i, low, high, {mirrored} AS k
    FROM (SELECT DISTINCT video_id, track_id, n FROM {before}) b, LATERAL (SELECT unnest(range((b.n + 7) // 2)) AS i) m, (VALUES {taps}) t(j, low, high)) q
  JOIN (SELECT video_id, track_id, i AS k, a FROM {before}) s USING (video_id, track_id, k) GROUP BY video_id, track_id, n, i)"""


SQL["wavelet_features"] = query("track_points", f"""{STEPS},
v AS (SELECT video_id, track_id, seq - 1 AS i, speed * 10 AS a, count(*) OVER w AS len FROM steps WHERE seq > 0 WINDOW w AS (PARTITION BY video_id, track_id)),
sized AS (SELECT DISTINCT video_id, track_id, len, CAST(pow(2, ceil(log2(greatest(len, 8)))) AS BIGINT) AS n FROM v WHERE len >= 14),
padded AS (
  SELECT z.video_id, z.track_id, z.n, z.i, a FROM (
    SELECT video_id, track_id, n, len, i, CASE WHEN i % (2 * (len - 1)) < len THEN i % (2 * (len - 1)) ELSE 2 * (len - 1) - i % (2 * (len - 1)) END AS k FROM sized, LATERAL (SELECT unnest(range(n)) AS i)) z
  JOIN v ON v.video_id = z.video_id AND v.track_id = z.track_id AND v.i = z.k),
{_wavelet_level("padded", "one")},
{_wavelet_level("one", "two")},
{_wavelet_level("two", "three")},
e AS (
  SELECT video_id, track_id, e0, e1, e2, e3 FROM (SELECT video_id, track_id, sum(a * a) AS e0, sum(d * d) AS e1 FROM three GROUP BY video_id, track_id)
  JOIN (SELECT video_id, track_id, sum(d * d) AS e2 FROM two GROUP BY video_id, track_id) USING (video_id, track_id) JOIN (SELECT video_id, track_id, sum(d * d) AS e3 FROM one GROUP BY video_id, track_id) USING (video_id, track_id)),
t AS (SELECT *, e0 + e1 + e2 + e3 AS total FROM e)""", f"""
SELECT video_id, track_id, {", ".join(f"round({c}, 2) AS dwt_energy_{n}" for c, n in (("e0", "approx"), ("e1", "detail1"), ("e2", "detail2"), ("e3", "detail3"), ("total", "total")))},
       {r("-(" + " + ".join(f"e{i} / (total + 1e-10) * ln(e{i} / (total + 1e-10) + 1e-10)" for i in range(4)) + ")", "dwt_entropy")} FROM t""")
SQL["sql_track_features"] = f"SELECT video_id, track_id, {', '.join(tables.MOTION)} FROM ({SQL['trajectory_track']})"
_OVERLAPS = """pairs AS (
  SELECT a.video_id, a.frame_no, a.det_id AS det_a, b.det_id AS det_b,
         greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s,
         CAST((a.x + a.w // 2 - b.x - b.w // 2) AS DOUBLE) AS dx, CAST((a.y + a.h // 2 - b.y - b.h // 2) AS DOUBLE) AS dy
  FROM detections a JOIN detections b ON a.video_id = b.video_id AND a.frame_no + 1 = b.frame_no)"""
SQL["sql_boxes"] = query("detections", _OVERLAPS, f"SELECT video_id, frame_no, det_a, det_b, {r('i / CAST(s - i AS DOUBLE)', 'iou')}, {r('sqrt(dx * dx + dy * dy)', 'distance')} FROM pairs WHERE i / CAST(s - i AS DOUBLE) > CAST(0.3 AS DOUBLE)")
SQL["settled_matches"] = query("detections", _OVERLAPS, f"""
SELECT video_id, frame_no, det_id, next_det, {r('iou', 'iou')} FROM (
  SELECT video_id, frame_no, det_a AS det_id, det_b AS next_det, i / CAST(s - i AS DOUBLE) AS iou,
         count(*) OVER (PARTITION BY video_id, frame_no, det_a) AS na, count(*) OVER (PARTITION BY video_id, frame_no, det_b) AS nb FROM pairs WHERE i > 0)
WHERE na = 1 AND nb = 1 AND iou > CAST(0.3 AS DOUBLE)""")
SQL["shape_features"] = f"SELECT * FROM ({SQL['shape_curvature']}) c JOIN ({SQL['hull_features']}) h USING (video_id, track_id)"

def _unrounded(name: str) -> str:
    """A query of the above with its numbers as they are, to go on with."""
    plain = SQL[name].replace("round(CAST(", "(CAST(").replace(" AS DOUBLE), 6) + 0.0 AS ", " AS DOUBLE)) + 0.0 AS ")
    return re.sub(r"round\((e\d|total), 2\)", r"\1", plain)


_POOLED = [("trajectory_track", tracks.TRAJECTORY), ("circular_motion", tracks.CIRCULAR), ("kinematics", tracks.KINEMATICS), ("shape_features", shapes.SHAPE), ("wavelet_features", shapes.WAVELET), ("interaction", tracks.INTERACTION)]


def _vector(families: list[tuple[str, list[str]]]) -> str:
    """All families' features pooled per video, temporal context, metadata and indicators; from the queries above."""
    names = [n for _, own in families for n in own]
    per = f"({_unrounded(families[0][0])}) f0" + "".join(f" FULL JOIN ({_unrounded(q)}) f{i} USING (video_id, track_id)" for i, (q, _) in enumerate(families) if i)
    pooled = ", ".join(f"coalesce({f}({n}), 0) AS {n}_{s}" for n in names for s, f in (("mean", "avg"), ("max", "max"), ("std", "stddev_pop")))
    kept = ", ".join(f"round({n}_{s}, 0) AS {n}_{s}" if n.startswith("dwt_energy") else r(f"{n}_{s}", f"{n}_{s}") for n in names for s in ("mean", "max", "std"))
    temporal = ["temporal_n_tracks", "temporal_n_long_tracks", "temporal_spread", "temporal_spatial_spread", "temporal_overlap_count", "temporal_tracks_per_frame", "temporal_mean_track_len", "temporal_max_track_len"]
    rate = "CASE WHEN fps > 0 THEN fps ELSE 10 END"
    return query("track_points manifest", f"""per AS (SELECT * FROM {per}),
pooled AS (SELECT video_id, count(*) AS valid, {pooled} FROM per GROUP BY video_id),
seen AS (SELECT video_id, max(seq) + 1 AS n_frames FROM track_points GROUP BY video_id)""", f"""
SELECT video_id, {kept}, {", ".join(r(n, n) for n in temporal)}, {r("valid", "meta_n_traj_tracks")}, {r("1", "indicator_tracks_present")},
       {r("n_frames", "meta_num_frames")}, {r(rate, "meta_fps")}, {r(f"coalesce(duration_s, n_frames / greatest({rate}, 1))", "meta_duration_sec")}
FROM seen JOIN pooled USING (video_id) JOIN ({_unrounded("temporal_context")}) t USING (video_id) LEFT JOIN manifest USING (video_id)""")


SQL["video_vector_a"], SQL["video_vector_all"] = _vector(_POOLED[:1]), _vector(_POOLED)
_WIDE = f"""c AS (
  SELECT video_id, {", ".join(f"{f}({n}) AS {n}_{s}" for n in tracks.CURVATURE for s, f in (("mean", "avg"), ("max", "max"), ("std", "stddev_pop")))}, count(*) AS n_valid_tracks FROM ({_unrounded("shape_curvature")}) GROUP BY video_id),
wide AS (SELECT *, 1 AS feature_count FROM c JOIN ({_unrounded("temporal_context")}) t USING (video_id)),
long AS (
  SELECT video_id, key, value FROM (UNPIVOT (SELECT video_id, CAST(COLUMNS(* EXCLUDE (video_id)) AS DOUBLE) FROM wide) ON COLUMNS(* EXCLUDE (video_id)) INTO NAME key VALUE value)
  WHERE NOT (video_id % 3 = 1 AND key LIKE 'temporal%')),
keys AS (SELECT DISTINCT key FROM long WHERE key <> 'feature_count')"""
SQL["feature_keys"] = f"WITH {_WIDE}\nSELECT key, row_number() OVER (ORDER BY key) AS place FROM keys"
SQL["missing_feature_keys"] = f"WITH {_WIDE}\nSELECT video_id, key FROM (SELECT DISTINCT video_id FROM long), keys EXCEPT SELECT video_id, key FROM long"
SQL["feature_matrix"] = f"WITH {_WIDE}\nSELECT video_id, " + ", ".join(r(f"coalesce(max(CASE WHEN key = '{k}' THEN value END), 0)", k) for k in ("mean_curvature_mean", "mean_curvature_max", "path_efficiency_mean", "temporal_n_tracks", "temporal_mean_track_len")) + " FROM long GROUP BY video_id"
SQL["preprocess_passthrough"] = """SELECT vec_id // 50 AS video_id, vec_id::BIGINT AS frame_no, 32 AS height, 32 AS width, NULL::DOUBLE AS blur_score, NULL::DOUBLE AS brightness, NULL::DOUBLE AS laplacian_var,
       NULL::DOUBLE AS tenengrad, NULL::DOUBLE AS brenner, NULL::VARCHAR AS distortion_type, false AS enhanced FROM embeddings"""
#: Frame by frame: of a frame's three boxes and all living tracks the nearest pair is taken, then the next, three times.
SQL["track_centroid"] = f"""WITH RECURSIVE {VIEW_SQL["detections"]},
frames AS (SELECT video_id, frame_no, list({{'det': det_id, 'x': x + w // 2, 'y': y + h // 2}} ORDER BY det_id) AS boxes FROM detections GROUP BY video_id, frame_no),
run AS (
  SELECT video_id, frame_no, boxes, list_transform(boxes, lambda b, j: {{'id': j - 1, 'hits': 1::BIGINT}}) AS named, list_transform(boxes, lambda b, j: {{'id': j - 1, 'x': b.x, 'y': b.y, 'missed': 0::BIGINT, 'hits': 1::BIGINT}}) AS tracks, len(boxes) AS fresh
  FROM frames WHERE frame_no = 0
  UNION ALL
  SELECT video_id, frame_no, boxes, named,
         list_filter(list_concat(
           list_transform(tracks, lambda t, i: CASE WHEN list_contains(rows, i) THEN {{'id': t.id, 'x': boxes[cols[list_position(rows, i)]].x, 'y': boxes[cols[list_position(rows, i)]].y, 'missed': 0::BIGINT, 'hits': t.hits + 1}}
                                                 ELSE {{'id': t.id, 'x': t.x, 'y': t.y, 'missed': t.missed + 1, 'hits': t.hits}} END),
           list_transform(list_filter(list_transform(boxes, lambda b, j: {{'id': named[j].id, 'x': b.x, 'y': b.y, 'missed': 0::BIGINT, 'hits': 1::BIGINT, 'j': j}}), lambda t: NOT list_contains(cols, t.j)),
                          lambda t: {{'id': t.id, 'x': t.x, 'y': t.y, 'missed': t.missed, 'hits': t.hits}})), lambda t: t.missed <= 30) AS tracks,
         fresh + len(boxes) - len(cols) AS fresh
  FROM (
    SELECT *, list_transform(boxes, lambda b, j: CASE WHEN list_contains(cols, j) THEN {{'id': tracks[rows[list_position(cols, j)]].id, 'hits': tracks[rows[list_position(cols, j)]].hits + 1}}
                                              ELSE {{'id': fresh + j - 1 - len(list_filter(cols, lambda c: c < j)), 'hits': 1::BIGINT}} END) AS named
    FROM (
      SELECT *, list_transform(picks, lambda e: e.i) AS rows, list_transform(picks, lambda e: e.j) AS cols FROM (
        SELECT *, list_filter([one, two, list_aggregate(list_filter(after, lambda e: two IS NOT NULL AND e.i <> two.i AND e.j <> two.j), 'min')], lambda e: e IS NOT NULL) AS picks FROM (
          SELECT *, list_aggregate(after, 'min') AS two FROM (
            SELECT *, list_filter(pairs, lambda e: e.i <> one.i AND e.j <> one.j) AS after FROM (
              SELECT *, list_aggregate(pairs, 'min') AS one FROM (
                SELECT f.video_id, f.frame_no, f.boxes, r.tracks, r.fresh,
                       flatten(list_transform(r.tracks, lambda t, i: list_transform(f.boxes, lambda b, j: {{'d': (t.x - b.x) * (t.x - b.x) + (t.y - b.y) * (t.y - b.y), 'i': i, 'j': j}}))) AS pairs
                FROM run r JOIN frames f ON f.video_id = r.video_id AND f.frame_no = r.frame_no + 1))))))))
SELECT video_id, frame_no, b.det AS det_id, n.id::BIGINT AS track_id, n.hits::INT AS hits, b.x::BIGINT AS cx, b.y::BIGINT AS cy FROM (SELECT video_id, frame_no, unnest(boxes) AS b, unnest(named) AS n FROM run)"""
_LIVING = f"""{VIEW_SQL["detections"]},
tracked AS ({SQL["track_centroid"]}),
track_points AS (
  SELECT t.video_id, t.track_id, row_number() OVER (PARTITION BY t.video_id, t.track_id ORDER BY frame_no) - 1 AS seq, CAST(cx AS DOUBLE) AS x, CAST(cy AS DOUBLE) AS y
  FROM tracked t JOIN (SELECT video_id, track_id, max(frame_no) AS last FROM tracked GROUP BY ALL) USING (video_id, track_id) JOIN (SELECT video_id, max(frame_no) AS until FROM detections GROUP BY ALL) USING (video_id)
  WHERE until - last <= 30)"""
_OF_LIVING = {q: SQL[q].replace(VIEW_SQL["track_points"], _LIVING) for q in ("trajectory_video", "temporal_context")}
SQL["tracked_video_features"] = f"""SELECT * FROM ({_OF_LIVING["trajectory_video"]}) a JOIN ({_OF_LIVING["temporal_context"]}) b USING (video_id)
JOIN ({SQL["detection_stats"].replace("count_if(w * h >= 1500)", "count(*)")}) c USING (video_id)"""
