"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is normalised, cut at content-defined places into chunks, and each chunk
gets a short identifier. The identifiers are verified: the distinct chunk contents
behind each are counted, and where two contents share one, an ordinal tells them
apart. A document is then its recipe, the ordered list of identifiers, and two
documents are equal exactly if their recipes are. Chunk text moves once, repeated
chunks are dropped before the shuffle, and whole documents never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, unused

#: A chunk ends after one of these four-letter shapes (about one place in 600 in
#: Latin script), but not within its first 64 characters nor beyond 4,100.
CHUNK = r"(?s).{60,4096}?(?:[aeo][nrst][dg][aeiou]|([^\x00-\x7F]).\1)|.{1,4096}"
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: str = CHUNK, id_bits: int = 64) -> DataFrame:
    """Return id, n_chars, text_sha256 and recipe (array of verified identifiers).

    A null or blank text has the empty recipe. ``id_bits`` shortens the raw
    identifiers, to make collisions likely in tests; results do not depend on it.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), normalised(F.col(text_col)).alias("norm"))
    ident = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - id_bits)
    cut = raw.withColumn("chunks", F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all("norm", F.lit(chunk), F.lit(0))))
    out = cut.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), F.transform("chunks", ident).alias("recipe"))
    contents = cut.select(F.explode("chunks").alias("chunk")).select(ident(F.col("chunk")).alias("id"), "chunk").distinct()
    shared = materialize(contents.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "collisions")
    if shared.isEmpty():
        return materialize(out, "recipes")
    # Identifiers that stand for several contents: an ordinal is added, by a join on the content.
    several = contents.join(shared, "id", "left_semi").withColumn("sha", F.sha2("chunk", 256))
    place = F.row_number().over(Window.partitionBy("id").orderBy("sha")) - 1
    ordinal = materialize(several.select("chunk", place.alias("k")), "ordinals")
    numbered = cut.withColumn("row", F.monotonically_increasing_id())
    pieces = numbered.select("n_chars", "doc_id", F.sha2("norm", 256).alias("text_sha256"), "row", F.posexplode_outer("chunks").alias("pos", "chunk"))
    named = pieces.join(ordinal, "chunk", "left").select("row", "doc_id", "n_chars", "text_sha256", F.when(F.col("chunk").isNotNull(), F.struct("pos", ident(F.col("chunk")).alias("id"), F.coalesce("k", F.lit(0)).alias("k"))).alias("piece"))
    lists = named.groupBy("row", "doc_id", "n_chars", "text_sha256").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return materialize(lists.select("doc_id", "n_chars", "text_sha256", F.flatten(F.transform("pieces", lambda p: F.array(p["id"], p["k"].cast("long")))).alias("recipe")), "recipes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting space, tab, LF, VT, FF and CR. Of
    equal texts the row with most characters before that stays, then the smallest
    id. Null texts count as empty; an empty table gives no rows; a null id comes
    after all others; repeated rows (same id and text) count in group_size and
    share their id's result. Other columns of ``docs`` are not read.
    """
    rows = recipes(docs, id_col, text_col, **how)
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    groups = materialize(rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size")).select("recipe", F.col("best.doc_id").alias("keep_id"), "group_size"), "groups")
    return rows.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows once.

    Whole rows move once, to meet the ids that stay. Only rows without an id or with
    one that several rows have (seldom any) move again, and are told apart by text.
    Null texts are copies of empty ones. An empty table stays empty; other columns,
    whatever their names, are passed on.
    """
    groups = materialize(exact_groups(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"), "kept")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")).where("kept")
    ids = materialize(ids.select("doc_id", ((F.col("rows") > 1) | F.col("doc_id").isNull()).alias("odd")), "kept_ids")

    def of(which: str) -> DataFrame:
        some = ids.where(which)
        return docs.join(some, docs[id_col].eqNullSafe(some["doc_id"]), "left_semi")

    if ids.where("odd").isEmpty():
        return of("true")
    sha, place = unused(docs, "sha"), unused(docs, "place")
    odd = of("odd").withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    kept = groups.where("kept").select("doc_id", "text_sha256").distinct()
    odd = odd.join(kept, odd[id_col].eqNullSafe(kept["doc_id"]) & (odd[sha] == kept["text_sha256"]), "left_semi")
    longest = Window.partitionBy(F.col(id_col), sha).orderBy(F.desc(F.length(F.col(text_col))))
    odd = odd.withColumn(place, F.row_number().over(longest)).where(F.col(place) == 1)
    return of("not odd").unionByName(odd.drop(place, sha))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""
