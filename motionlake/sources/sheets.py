"""Spreadsheet manifests (.xlsx): the zipped XML of workbooks, read by Spark's own file readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reuse import written

#: The built-in number formats of dates, and the day that serial dates count from.
DATES = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
EPOCH = datetime(1899, 12, 30)
_CELL = re.compile(r"([A-Z]+)\d+")
#: What a column's kinds of cells make: the first type that holds them all.
TYPES = [({"int"}, "bigint"), ({"int", "double"}, "double"), ({"bool"}, "boolean"), ({"date"}, "timestamp")]


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _texts(book: zipfile.ZipFile, name: str, item: str) -> list[str]:
    """The text of each ``item`` of a part; none if the part isn't there."""
    if name not in book.namelist():
        return []
    with book.open(name) as f:
        return ["".join(t.text or "" for t in e.iter() if _tag(t) == "t") for _, e in iterparse(f) if _tag(e) == item]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    own, styles = set(DATES), set()
    with book.open("xl/styles.xml") as f:
        for _, e in iterparse(f):
            if _tag(e) == "numFmt" and re.search(r"[dyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "")).lower()):
                own.add(int(e.get("numFmtId")))
            elif _tag(e) == "cellXfs":
                styles = {i for i, x in enumerate(e) if int(x.get("numFmtId", 0)) in own}
    return styles


def _sheet(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part of the sheet of that name, or of the first one."""
    with book.open("xl/workbook.xml") as f:
        named = [(e.get("name"), next(v for k, v in e.attrib.items() if k.endswith("}id"))) for _, e in iterparse(f) if _tag(e) == "sheet"]
    with book.open("xl/_rels/workbook.xml.rels") as f:
        parts = {e.get("Id"): e.get("Target") for _, e in iterparse(f) if _tag(e) == "Relationship"}
    found = [i for n, i in named if sheet is None or n == sheet]
    if not found:
        raise ValueError(f"no sheet {sheet}; there are {[n for n, _ in named]}")
    part = parts[found[0]]
    return part.lstrip("/") if part.startswith("/") else f"xl/{part}"


def cells(data: bytes, sheet: str | None = None) -> Iterator[list[tuple[str, str] | None]]:
    """The rows of a sheet: of each cell its kind (int, double, bool, date or string) and text, None where empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared, dates = _texts(book, "xl/sharedStrings.xml", "si"), _date_styles(book)
        with book.open(_sheet(book, sheet)) as f:
            for _, row in iterparse(f):
                if _tag(row) != "row":
                    continue
                out: list[tuple[str, str] | None] = []
                for c in row:
                    place = 0
                    for letter in (_CELL.match(c.get("r", "")) or [None, ""])[1]:
                        place = 26 * place + ord(letter) - 64
                    out += [None] * ((place - 1 if place else len(out)) - len(out))
                    out.append(_value(c, shared, dates))
                yield out
                row.clear()


def _value(c, shared: list[str], dates: set[int]) -> tuple[str, str] | None:
    kind = c.get("t", "n")
    text = "".join(t.text or "" for t in c.iter() if _tag(t) == ("t" if kind == "inlineStr" else "v"))
    if text == "" or kind == "e":
        return None
    if kind == "s":
        return "string", shared[int(text)]
    if kind == "b":
        return "bool", "true" if text == "1" else "false"
    if kind != "n":
        return "string", text
    if int(c.get("s", 0)) in dates:
        return "date", (EPOCH + timedelta(days=float(text))).isoformat(sep=" ", timespec="microseconds")
    number = float(text)
    return ("int", str(int(number))) if number.is_integer() and abs(number) < 2**53 else ("double", repr(number))


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of a workbook, or of all workbooks of a folder, below their first row, which names the columns.

    Whole columns of whole numbers are bigint, of numbers double, of truth values boolean,
    of dates timestamp, all else string; an empty cell is null, a row of empty cells is
    left out, a column without a name too. Workbooks may lie in any store that Spark reads; each is
    one task's. All must have the first one's columns, in any order; others' are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = cells(data, sheet)
                head = [c[1].strip() if c else "" for c in next(rows, [])]
                out: list[tuple] = [(name, 0, i, "head", h) for i, h in enumerate(head) if h]
                for n, row in enumerate(rows, 1):
                    out += [(name, n, i, *c) for i, c in enumerate(row) if c and i < len(head) and head[i]]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))], ["file", "n", "place", "kind", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    long = written(files.mapInArrow(run, "file string, n long, place int, kind string, value string"), "cells")
    heads = long.where("n = 0").select("file", "place", F.col("value").alias("column"))
    named = long.where("n > 0").join(heads, ["file", "place"])
    first = heads.where(F.col("file") == (heads.agg(F.min("file")).first()[0] or "")).orderBy("place").collect()  # one row a column
    kinds = {r["column"]: set(r["kinds"]) for r in named.groupBy("column").agg(F.collect_set("kind").alias("kinds")).collect()}
    columns = list(dict.fromkeys(r["column"] for r in first))
    if not columns:
        raise ValueError(f"no workbook with a row of names in {path}")
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column")).cast("int")
    wide = named.withColumn("column", place).groupBy("file", "n").pivot("column", list(range(1, len(columns) + 1))).agg(F.first("value"))
    typed = [F.col(f"`{i}`").cast(next((t for of, t in TYPES if kinds.get(c) and kinds[c] <= of), "string")).alias(c) for i, c in enumerate(columns, 1)]
    return wide.orderBy("file", "n").select(*typed)
