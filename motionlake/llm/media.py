"""Media columns: interleaved sequences of text and media references.

HTML is parsed into an ordered sequence of text and media-reference structs; a
reference keeps its position and its caption. Media are stored once for each digest, as
bytes; a join on the digest resolves references, and moves only what was read from
the stored bytes (sizes, checks, features), never the bytes themselves.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, table

#: Elements without shown text, what a head may hold, elements that end a run of text, and media elements.
HIDDEN = {"script", "style", "noscript", "template", "title", "head"}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
BLOCK = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
MEDIA = {"img", "audio", "video", "source", "embed"}
WIDTH = 64
COPIES = 200_000  # ids and digests, about 25 MB
_BLANK = re.compile(r"\s+")
_ITEM = "position int, kind string, text string, ref string, digest string, caption string"
_ITEM_TYPE = pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "digest", "caption"))])


class _Reader(HTMLParser):
    """Collects items: dicts with kind, text, ref and caption in the page's order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []  # text since the last item
        self.caption: list[str] | None = None  # text of the figcaption that is open
        self.figures: list[list] = []  # of each open figure, its first item's place and its caption
        self.hidden: list[str] = []
        self.inside: list[str] = []  # elements opened in the noscript that is open

    def read(self, page: str | None) -> list[dict]:
        self.feed(page or "")
        self.close()
        self.flush()
        while self.figures:
            self.end_figure()
        return self.items

    def flush(self) -> None:
        text = _BLANK.sub(" ", "".join(self.run)).strip()
        self.run.clear()
        if text:
            self.items.append({"kind": "text", "text": text})

    def end_figure(self) -> None:
        begin, caption = self.figures.pop()
        for item in self.items[begin:]:
            if item["kind"] == "media" and caption:
                item["caption"] = caption

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "body" or "head" in self.hidden and self.hidden[-1] in ("head", "noscript") and tag not in IN_HEAD:
            self.hidden.clear()  # what can't stand in a head ends it
        if tag in HIDDEN:
            self.hidden.append(tag)
            if tag == "noscript":
                self.inside.clear()
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.caption = []
        elif tag in BLOCK or tag in MEDIA:
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")
        if tag in BLOCK:
            self.inside.append(tag)
        if tag == "figure":
            self.figures.append([len(self.items), None])
        given = dict(attrs)
        if tag in MEDIA and given.get("src"):
            self.items.append({"kind": "media", "ref": given["src"].strip(), "caption": given.get("alt") or given.get("title")})

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN and self.hidden:
            self.hidden.pop()

    def handle_endtag(self, tag) -> None:
        if self.hidden and self.hidden[-1] == "noscript" and tag in BLOCK:
            if tag in self.inside:
                del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
            else:
                self.hidden.pop()  # it ends with the element around it
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        elif tag == "figcaption" and self.caption is not None:
            if self.figures:
                self.figures[-1][1] = _BLANK.sub(" ", "".join(self.caption)).strip()
            self.caption = None
        elif tag in BLOCK and self.caption is None:
            self.flush()
            if tag == "figure" and self.figures:
                self.end_figure()

    def handle_data(self, data) -> None:
        if self.hidden == ["head"] and data.strip():
            self.hidden.clear()
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def data_bytes(ref: str) -> bytes | None:
    """The bytes of a data: reference, None if it isn't one or can't be decoded."""
    if not ref[:5].lower() == "data:" or "," not in ref:
        return None
    head, _, body = ref.partition(",")
    raw = unquote_to_bytes(body)
    try:
        return base64.b64decode(raw) if head.lower().endswith(";base64") else raw
    except (binascii.Error, ValueError):
        return None


def parse_html(page: str | None) -> list[dict]:
    """Items of a page in order: kind, text, ref, digest, caption and position from 0.

    A media item's caption is its figure's figcaption, else its alt, else its title.
    The digest is known here for ``sha256:`` and ``data:`` references only.
    """
    out = []
    for position, item in enumerate(_Reader().read(page)):
        ref, digest = item.get("ref"), None
        if ref and ref.startswith("sha256:"):
            digest = ref[7:].lower()
        elif ref and (raw := data_bytes(ref)) is not None:
            digest, ref = hashlib.sha256(raw).hexdigest(), "data:"
        out.append({"position": position, "kind": item["kind"], "text": item.get("text"), "ref": ref, "digest": digest, "caption": item.get("caption")})
    return out


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Return doc_id and items, an array of (position, kind, text, ref, digest, caption).

    A null or empty page has no items; broken HTML is read as far as it goes; an open
    head ends at the first element or text that can't stand in it, an open noscript with
    the element around it; repeated rows repeat; an empty table gives no rows; other columns are not read.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_html(p) for p in batch.column(1).to_pylist()], pa.list_(_ITEM_TYPE))], ["doc_id", "items"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html")).mapInArrow(run, f"doc_id {kind}, items array<struct<{_ITEM.replace(' ', ':').replace(',:', ',')}>>")


def inline_media(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Return digest and media (bytes) of the ``data:`` references of pages, each digest once.

    Null and empty pages and references that can't be decoded have none.
    """
    bound_batches(pages.sparkSession, rows=500, mb=4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, bytes] = {}
            for page in batch.column(0).to_pylist():
                for item in _Reader().read(page):
                    if item["kind"] == "media" and (raw := data_bytes(item["ref"])) is not None:
                        found[hashlib.sha256(raw).hexdigest()] = raw
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["digest", "media"])

    return pages.select(html_col).mapInArrow(run, "digest string, media binary").groupBy("digest").agg(F.first("media").alias("media"))


def resolved(sequences_: DataFrame, known: DataFrame) -> DataFrame:
    """One row per media reference: doc_id, n_items (of its page), position, ref, caption and
    the columns of ``known`` (one row per digest) for its digest.

    ``known``'s columns are null where the digest is null or not known; pages without
    media have no row, repeated pages repeat theirs, and an empty table gives none.
    """
    refs = sequences_.select("doc_id", F.size("items").alias("n_items"), F.explode("items").alias("item")).where("item.kind = 'media'").select("doc_id", "n_items", "item.position", "item.ref", "item.caption", "item.digest")
    return refs.join(known, "digest", "left")


def page_sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: doc_id, n_items, n_media, n_chars (of all text items) and texts_sha256
    (of the text items joined by LF); a null or empty page has no items."""
    items = F.col("items")
    texts = F.transform(F.filter(items, lambda i: i["kind"] == "text"), lambda i: i["text"])
    joined = F.array_join(texts, "\n")
    return sequences(pages, id_col, html_col).select("doc_id", F.size(items).alias("n_items"), (F.size(items) - F.size(texts)).alias("n_media"), F.length(joined).alias("n_chars"), F.sha2(joined, 256).alias("texts_sha256"))


def gray_map(text: Column) -> Column:
    """A text's UTF-8 bytes, padded by 0 to a positive multiple of 64, as a binary gray
    map of 8-bit samples, 64 to a row; its comment tells the number of text bytes."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    rows = F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("int")
    samples = F.rpad(raw, rows * WIDTH, F.lit(b"\0"))
    head = F.concat(F.lit("P5\n# "), n.cast("string"), F.lit(f"\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(head, samples)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts as media, each digest once: digest (sha256 of the stored form) and media.

    A null text is stored as an empty one. Of equal texts that of the smallest id is
    written, ids before null; only a row that is repeated as a whole, id and text, is
    written as often. An empty table writes none; other columns are not read. The other
    copies' ids are broadcast if they are ``COPIES`` at most, else joined by a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), gray_map(F.col(text_col)).alias("media")).select("doc_id", F.sha2("media", 256).alias("digest"), "media")
    named = materialize(rows.select("doc_id", "digest"), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    several = materialize(named.groupBy(F.col("digest").alias("d")).agg(first, F.count("*").alias("n")).where("n > 1"), "several")
    copies = named.join(several, F.col("digest") == F.col("d")).where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("doc_id", "digest").distinct()
    copies = materialize(copies, "copies")
    if copies.count() <= COPIES:
        copies = F.broadcast(copies)
    return materialize(rows.join(copies, rows["doc_id"].eqNullSafe(copies["doc_id"]) & (rows["digest"] == copies["digest"]), "left_anti").select("digest", "media"), "media")


def read_gray_map(media: bytes) -> tuple[int, np.ndarray]:
    """Text bytes and samples (rows of 64) of a stored gray map."""
    magic, comment, shape, most, samples = media.split(b"\n", 4)
    width, height = map(int, shape.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not a binary gray map of 8-bit samples")
    return int(comment[2:]), np.frombuffer(samples, np.uint8).reshape(height, width)


def describe(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits, and mean change between neighbours of a row."""
    count = np.bincount(samples.ravel(), minlength=256)
    share = count / samples.size
    level = np.arange(256)
    mean = float(share @ level)
    deviation = float(np.sqrt(max(share @ (level * level) - mean * mean, 0.0)))
    entropy = float(-(share[count > 0] * np.log2(share[count > 0])).sum())
    change = sum(int(np.abs(np.diff(part.astype(np.int16), axis=1)).sum()) for part in np.array_split(samples, -(-len(samples) // 4096))) / (len(samples) * (WIDTH - 1))
    return f"mean={mean:.6f};sd={deviation:.6f};entropy={entropy:.6f};change={change:.6f}"


def features(stored: DataFrame) -> DataFrame:
    """One row per digest, from the stored bytes: n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature.

    Media that are no gray maps of ``gray_map``'s kind raise a ValueError; null media and
    an empty table give no rows, a digest that is stored again gives one.
    """
    bound_batches(stored.sparkSession)
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = media.as_py()
                n, samples = read_gray_map(media)
                payload = samples.tobytes()
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    read = stored.where("media is not null").select("digest", "media").mapInArrow(run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.groupBy("digest").agg(*(F.first(n).alias(n) for n in names[1:]))


def document_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An HTML page (doc_id, html) for each text: its lines as paragraphs and, after the
    first one, a figure that refers to the stored text by digest and has the id as caption.

    A null text is an empty line, a null id an empty caption; repeated rows repeat.
    """
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    figure = F.concat(F.lit('</p><figure><img src="sha256:'), F.sha2(gray_map(F.col(text_col)), 256), F.lit('" alt="text"><figcaption>'), named, F.lit("</figcaption></figure>"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    lines = F.split(text, "\n")
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    return docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lit("<article><p>"), F.get(lines, F.lit(0)), figure, F.array_join(rest, ""), F.lit("</article>")).alias("html"))


def op3_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = materialize(features(store(docs)), "features")
    out = resolved(sequences(document_pages(docs), "doc_id"), known)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "position", "caption")


def media_digests(spark, sf_dir: str) -> DataFrame:
    """The columns of op3_media that SQL can state."""
    return op3_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256", "caption")


def media_pages(spark, sf_dir: str) -> DataFrame:
    """What the table of web pages holds as interleaved sequences."""
    return page_sequences(table(spark, sf_dir, "pages")).withColumnRenamed("doc_id", "page_id")


MEDIA_DIGESTS_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
n AS (SELECT doc_id, raw, octet_length(raw) AS n, greatest(1, CAST(ceil(octet_length(raw) / 64.0) AS BIGINT)) AS h FROM b),
p AS (SELECT doc_id, n, h, raw || unhex(repeat('00', CAST(h * 64 - n AS BIGINT))) AS payload FROM n),
m AS (SELECT doc_id, n, h, payload, encode('P5' || chr(10) || '# ' || n || chr(10) || '64 ' || h || chr(10) || '255' || chr(10)) || payload AS media FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(h * 64 AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256,
       CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256, CAST(doc_id AS VARCHAR) AS caption
FROM m
"""
