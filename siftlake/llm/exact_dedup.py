"""Operator 10: exact deduplication by content-defined chunk recipes. Built-in functions only.

A normalised text is cut where its own content says so, chunks are deduplicated to identifiers, and
documents are compared by their ordered identifier lists. Chunk text moves once, after duplicates of a
chunk are folded in the task that read them; documents themselves never move. An identifier is a 64-bit
hash that has been verified: every hash is checked to stand for one chunk text, and where two texts share
a hash, the lists of the documents concerned get an ordinal beside it.

Defined cases: null text counts as empty; an empty text has the empty list, so all empty texts are equal.
Null ids are allowed and lose against any other id. Of rows that share the largest id of their group (repeated ids, or
repeated rows) one is kept: the one with the larger hash of its raw text, and of equal rows any.
Columns of the input other than id and text are not read and cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, quoted, text_hash, text_of, without

#: Chunks have at least MIN_CHUNK and at most MAX_CHUNK characters, but for the last one of a text.
MIN_CHUNK, MAX_CHUNK = 512, 4096
#: A chunk ends after two characters of this class (one in four of the codes up to 0x24F).
_CUT_CLASS = "[" + "".join(f"\\u{c:04x}" for c in range(0x20, 0x250) if c % 4 == 1) + "]"
CHUNK = f"(?s).{{{MIN_CHUNK - 2},{MAX_CHUNK - 2}}}?{_CUT_CLASS}{_CUT_CLASS}|.{{1,{MAX_CHUNK}}}"


def normalised(text: str | Column) -> Column:
    """A-Z to lower case and nothing else; null is empty."""
    t = text_of(text)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase)
    )


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each distinct chunk once: (h, chunk, uses)."""
    pieces = docs.select(F.explode(chunks(normalised(text_col))).alias("chunk"))
    return pieces.groupBy(F.xxhash64("chunk").alias("h"), "chunk").agg(F.count(F.lit(1)).alias("uses"))


def ambiguous_hashes(store: DataFrame) -> DataFrame:
    return store.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h")


def ambiguous_chunks(store: DataFrame) -> DataFrame:
    """Chunks whose hash stands for more than one text, with an ordinal: (h, chunk, ordinal). Almost always empty."""
    order = Window.partitionBy("h").orderBy("chunk")
    return store.join(ambiguous_hashes(store), "h").select("h", "chunk", F.row_number().over(order).alias("ordinal"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """(id, raw, recipe, ordinals, text_sha256) for each row; raw is the text_hash of the text as it is. ordinals is null but
    where a chunk's hash is ambiguous."""
    id_col, text_col = quoted(id_col), quoted(text_col)
    lists = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("raw"), normalised(text_col).alias("t")).select(
        "id", "raw", F.transform(chunks(F.col("t")), lambda c: F.xxhash64(c)).alias("recipe"), F.sha2("t", 256).alias("text_sha256")
    )
    none = F.lit(None).cast(T.ArrayType(T.StringType()))
    if not verify:
        return lists.withColumn("ordinals", none)
    store = chunk_store(docs, text_col)
    if ambiguous_hashes(store).isEmpty():
        return lists.withColumn("ordinals", none)
    clash = materialize(ambiguous_chunks(store), "chunk-clash")
    located = (
        docs.select(normalised(text_col).alias("t"))
        .select(F.sha2("t", 256).alias("text_sha256"), F.posexplode(chunks(F.col("t"))).alias("at", "chunk"))
        .withColumn("h", F.xxhash64("chunk"))
        .join(clash, ["h", "chunk"])
        .groupBy("text_sha256")
        .agg(F.array_sort(F.collect_set(F.format_string("%010d:%d", "at", "ordinal"))).alias("ordinals"))
    )
    return lists.join(located, "text_sha256", "left").select("id", "raw", "recipe", "text_sha256", "ordinals")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, raw, keep_id, keep_raw, group_size, kept, text_sha256).

    Only lists and ids are shuffled by the list. Groups of two or more are few rows and stand alone as a
    table, so the join back is one whose hot side the engine may split."""
    lists = materialize(recipes(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "recipes")
    shared = (
        lists.groupBy("recipe", "ordinals")
        .agg(F.max(F.struct("id", "raw", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    shared = materialize(shared, "recipe-groups").withColumnsRenamed({"recipe": "g_recipe", "ordinals": "g_ordinals"})
    same = (F.col("recipe") == F.col("g_recipe")) & F.col("ordinals").eqNullSafe(F.col("g_ordinals"))
    alone = F.col("group_size").isNull()
    return lists.join(shared, same, "left").select(
        "id",
        "raw",
        F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.when(alone, F.col("raw")).otherwise(F.col("top.raw")).alias("keep_raw"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("top.row"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, text_sha256). Texts that are equal after
    lower-casing A-Z form a group, of which one row with the largest id stays."""
    return marked(docs, id_col, text_col).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of each group that stays, with all its columns. Texts stay where they are unless many rows go."""
    rows = materialize(marked(docs, id_col, text_col).where("group_size > 1").select("id", "raw", "keep_id", "keep_raw", "kept"), "exact-shared")
    of_kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw"))
    dropped = materialize(rows.where(~of_kept).select("id", "raw").distinct(), "exact-dropped")
    once = materialize(rows.where(of_kept).groupBy("id", "raw").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "raw"), "exact-once")
    return without(docs, dropped, once, id_col, text_col)
