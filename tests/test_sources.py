"""Workbooks, box texts found below a folder, and trackers over a stream in event time."""

import zipfile
from datetime import datetime

import pytest

from motionlake.operators import tracking
from motionlake.sources import files, sheets
from motionlake.streaming.ordered import track_ordered

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, tables):
    """A workbook of {sheet: rows}; texts are shared, but for those that begin with '='; dates have style 1."""
    shared = []

    def cell(v, at):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, datetime):
            return f'<c r="{at}" s="1"><v>{(v - datetime(1899, 12, 30)).total_seconds() / 86400}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v}</v></c>'
        if v.startswith("="):
            return f'<c r="{at}" t="inlineStr"><is><t>{v[1:]}</t></is></c>'
        shared.append(v)
        return f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        for k, rows in enumerate(tables.values(), 1):
            lines = "".join(f'<row r="{r}">' + "".join(cell(v, f"{chr(65 + c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {NS}><sheetData>{lines}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(tables) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" for t in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')


HEAD = ["Name of Video Series", "Activity", "Distortion", "FPS", "Frames", "Seen", "Good", None]


def test_workbook(spark, tmp_path):
    day = datetime(2024, 5, 6, 12, 30)
    rows = [HEAD, ["clip 1.mp4", "walk", "=Pri", 29.5, 300, day, True, "dropped"], [None] * 7, ["clip 2.mp4", None, "Fo", 30, 0, day, False]]
    workbook(tmp_path / "m.xlsx", {"info": rows, "other": [["x"], [1]]})
    df = files.read_manifest(spark, str(tmp_path / "m.xlsx"))
    assert dict(df.dtypes) == {"Name of Video Series": "string", "Activity": "string", "Distortion": "string", "FPS": "double", "Frames": "bigint", "Seen": "timestamp", "Good": "boolean"}
    assert [tuple(r) for r in df.collect()] == [("clip 1.mp4", "walk", "Pri", 29.5, 300, day, True), ("clip 2.mp4", None, "Fo", 30.0, 0, day, False)]
    assert [r["fps"] for r in files.video_info(df).collect()] == [29.5, 30.0]
    assert [r["x"] for r in sheets.read_xlsx(spark, str(tmp_path / "m.xlsx"), "other").collect()] == [1]
    workbook(tmp_path / "bad.xlsx", {"s": [["Activity"], ["walk"]]})
    with pytest.raises(ValueError, match="lacks"):
        files.read_manifest(spark, str(tmp_path / "bad.xlsx"))
    with pytest.raises(Exception, match="no sheet"):
        sheets.read_xlsx(spark, str(tmp_path / "m.xlsx"), "none").collect()


def test_workbooks_of_a_folder(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"s": [["n", "t"], [1, "x"]]})
    workbook(tmp_path / "b.xlsx", {"s": [["t", "n", "more"], ["y", 2.5, 3]]})
    assert [tuple(r) for r in sheets.read_xlsx(spark, str(tmp_path)).collect()] == [(1.0, "x"), (2.5, "y")]


def test_box_texts_are_found(spark, tmp_path):
    root = tmp_path / "gt"
    (root / "deep er").mkdir(parents=True)
    for name in ("a.txt", "a_gt.txt", "b_bbox.txt", "b_groundtruth.txt", "old c x_gt.txt", "c notes.md", "deep er/d_gt.txt", "deep er/d.txt", "deep er/e.log", "f_gt.txt.bak"):
        (root / name).write_text(f"# {name}\n10, 20, 30 40\n\n-3 1 2 bad\n-3 1 2 4\n")
    names = ["a.mp4", "b.mp4", "c.mp4", "d.avi", "e.mp4", "f.mp4", "g.mp4", ".mp4"]
    videos = spark.createDataFrame([(i, n, 1280, 960) for i, n in enumerate(names)], "video_id long, name string, width int, height int")
    got = {r["video_id"]: r["path"].rsplit("/gt/", 1)[1] for r in files.find_truth(videos, files.listing(spark, str(root))).collect()}
    # Names of one letter also stand within those of files right in the folder, which come first.
    assert got == {0: "a_gt.txt", 1: "b_groundtruth.txt", 2: "old c x_gt.txt", 3: "old c x_gt.txt", 4: "c notes.md", 5: "f_gt.txt.bak", 6: "a_gt.txt"}
    own = spark.createDataFrame([(0, "d_.mp4"), (1, "zz.mp4"), (2, "d_gt.mp4")], "video_id long, name string")
    got = {r["video_id"]: r["path"].rsplit("/", 1)[1] for r in files.find_truth(own, files.listing(spark, str(root))).collect()}
    assert got[2] == "d_gt.txt" and 1 not in got
    boxes = files.truth_boxes(spark, str(root), videos.where("video_id < 3")).orderBy("video_id", "frame_no").collect()
    assert [(r["video_id"], r["frame_no"], r["x"], r["y"], r["w"], r["h"]) for r in boxes] == [row for i in range(3) for row in ((i, 1, 5, 10, 15, 20), (i, 4, -1, 0, 1, 2))]


def boxes(n=30):
    return [(v, f, d, 10 * f + 100 * d + v, 5 * f, 20, 20) for v in range(2) for f in range(n) if f % 11 != 7 for d in range(2)]


@pytest.mark.parametrize("kind", ["iou_hungarian", "centroid"])
def test_stream_in_event_time_equals_batch(spark, tmp_path, kind):
    """Frames come in shuffled parts; a late row is told apart, and no row is lost."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rows = boxes()
    stamped = [(*r, datetime.fromtimestamp(1_700_000_000 + r[1])) for r in rows]
    schema = "video_id long, frame_no long, det_id long, x long, y long, w long, h long, ts timestamp"
    parts = [sorted((r for r in stamped if 8 * k <= r[1] < 8 * k + 8), key=lambda r: (-r[1], r[2])) for k in range(4)]
    parts = [parts[0][::2] + parts[1][1::2], parts[0][1::2] + parts[1][::2], parts[2] + parts[3]]
    end = [(v, 1000, 0, 0, 0, 1, 1, datetime.fromtimestamp(1_700_000_000 + 1000)) for v in range(2)]
    late = [(0, 29, 9, 1, 1, 1, 1, datetime.fromtimestamp(1_700_000_000 + 990))]
    source = tmp_path / "in"
    for k, part in enumerate([*parts, end, late, end]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(source))
    try:
        run = track_ordered(stream, kind, "20 seconds").writeStream.format("memory").queryName(f"ordered_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        got = [tuple(r) for r in spark.table(f"ordered_{kind}").collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = tracking.track(spark.createDataFrame(rows, "video_id long, frame_no long, det_id long, x long, y long, w long, h long"), kind)
    want = sorted(tuple(r) for r in batch.collect())
    on_time = sorted(r[:-1] for r in got if not r[-1] and r[1] < 1000)
    assert on_time == want
    assert {(r[0], r[1], r[2]) for r in got if r[-1]} <= {(0, 29, 9)}
