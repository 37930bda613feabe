"""Operator 5: document fingerprints by Merkle trees over paragraphs and sections. Built-in functions only.

A text's lines are its paragraphs, and a paragraph is cut into leaves, runs of up to LEAF words that end with a sentence; nothing
of a text is outside its leaves. A leaf's digest is the MD5 of its text (all that is said of equality rests on this), a paragraph's the
SHA-256 of its leaves' digests in order. Consecutive paragraphs form a section, which ends after a paragraph whose digest begins with
one of four hex digits, so that an edit moves no section boundary but its own. A section's digest is the SHA-256 of its paragraphs'
digests, the root that of the sections' digests. Equal roots mean equal texts; where roots differ, comparing sections and then
paragraphs locates the edit.

Two trees are compared from the top: equal roots are alike with 1.0; of differing ones, branches (paragraphs, each counted once) that both
have count with all their leaves, and only the others descend to their leaves. Likeness is the share of leaves in common (Dice).

Defined cases: null text counts as empty; an empty text is one empty paragraph without leaves. Next documents go by (id, text), null ids first, and the last row's next is the first row; a
single row is its own next. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, text_of

#: A leaf ends at an end of sentence or paragraph or after this many words (of 32 characters at most).
LEAF = 4
_WHITE = r"[\x09-\x0d\x20]"
LEAVES = rf"(?:{_WHITE}*[^\x09-\x0d\x20.!?]{{1,32}}){{1,{LEAF}}}{_WHITE}*[.!?]*|{_WHITE}*[.!?]+|{_WHITE}+"
#: A section ends after a paragraph whose digest begins with one of these.
SECTION_END = "(?<=\\b[0-3][0-9a-f]{63} )"


def paragraph_nodes(text: Column) -> Column:
    """What each paragraph's digest is of: its leaves' digests, joined."""
    leaves = lambda p: F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0))
    return F.transform(F.split(text, "\n", -1), lambda p: F.array_join(F.transform(leaves(p), lambda s: F.md5(s)), " "))


def paragraph_digests(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: F.sha2(n, 256))


def section_digests(paragraphs: Column) -> Column:
    joined = F.concat(F.array_join(paragraphs, " "), F.lit(" "))
    return F.transform(F.filter(F.split(joined, SECTION_END, -1), lambda s: s != ""), lambda s: F.sha2(s, 256))


def merkle_root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, " "), 256)


#: Characters of a leaf in a node, a blank included.
_PER_LEAF = 33


def _leaf_count(nodes: Column) -> Column:
    """Leaves below all these nodes."""
    return F.aggregate(nodes, F.lit(0), lambda n, x: n + F.floor((F.char_length(x) + 1) / _PER_LEAF).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves that the trees of these paragraph nodes have in common, from 0 to 1 (Dice), from the top."""
    below = lambda x, y: F.filter(F.split(F.array_join(F.array_except(x, y), " "), " "), lambda s: s != "")
    rest_a, rest_b = F.array_distinct(below(a, b)), F.array_distinct(below(b, a))
    both = 2.0 * _leaf_count(F.array_intersect(a, b))
    total = both + F.size(rest_a) + F.size(rest_b)
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(1.0)).otherwise((both + 2.0 * F.size(F.array_intersect(rest_a, rest_b))) / total)


def first_difference(a: Column, b: Column) -> Column:
    """Number (from 0) of the first branch that differs; null if none does."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(at > 0, (at - 1).cast("int"))


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds prefix_nodes, prefix_paragraphs, prefix_sections and prefix_root of a text column without nulls."""
    return (
        df.withColumn(f"{prefix}_nodes", paragraph_nodes(F.col(text)))
        .withColumn(f"{prefix}_paragraphs", paragraph_digests(F.col(f"{prefix}_nodes")))
        .withColumn(f"{prefix}_sections", section_digests(F.col(f"{prefix}_paragraphs")))
        .withColumn(f"{prefix}_root", merkle_root(F.col(f"{prefix}_sections")))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, sections, paragraphs) of every row; narrow."""
    t = docs.select(F.col(quoted(id_col)).alias("id"), text_of(quoted(text_col)).alias("t"))
    return with_tree(t, "t", "own").select(F.col("id").alias(id_col), F.col("own_root").alias("fingerprint"), F.col("own_sections").alias("sections"), F.col("own_paragraphs").alias("paragraphs"))


def with_next(rows: DataFrame, carried: list[str], id_col: str = "id", text_col: str = "t", rows_per_bucket: int = 2048, most_buckets: int = 65_536) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the row that follows by (id, text); the last row is followed by the first.

    Ids are cut into ranges at values taken from the ids themselves, so each range begins with a row whose id is
    the boundary. Such rows go to the range before as well, behind all its rows, and the first row also to the last range:
    each range then knows its successor, and no task sees more than a range. One shuffle of the rows. Ranges hold rows_per_bucket rows
    up to most_buckets of them, and grow beyond (at 100 TB to some GB, which the sort of a window spills)."""
    n, low, nulls = rows.agg(F.count(F.lit(1)), F.min(id_col), F.count_if(F.col(id_col).isNull())).first()
    side = max(1, round(min(most_buckets, n / rows_per_bucket) ** 0.5))
    bounds: list = []
    if low is not None and side > 1:
        at = [k / (side * side) for k in range(1, side * side)]
        bounds = rows.agg(F.percentile_approx(id_col, at, 4 * side * side)).first()[0]
    bounds = sorted({b for b in bounds if nulls or b > low})
    if bounds:
        coarse = bounds[::side]
        c = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda b: b <= F.col(id_col)))
        fine = F.size(F.filter(F.slice(F.array(*map(F.lit, bounds)), F.greatest(c - 1, F.lit(0)) * side + 1, side), lambda b: b <= F.col(id_col)))
        bucket = F.when(F.col(id_col).isNull() | (c == 0), 0).otherwise((c - 1) * side + fine)
        heads = F.col(id_col).isin(bounds)
    else:
        bucket, heads = F.lit(0), F.lit(False)
    first = F.col(id_col).isNull() if nulls or low is None else F.coalesce(F.col(id_col) == low, F.lit(False))
    places = F.array_compact(
        F.array(
            F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("ghost")),
            F.when(F.coalesce(heads, F.lit(False)), F.struct((F.col("_bucket") - 1).alias("bucket"), F.lit(1).alias("ghost"))),
            F.when(first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("ghost"))),
        )
    )
    order = Window.partitionBy("_place.bucket").orderBy(F.col("_place.ghost"), F.col(id_col).asc_nulls_first(), F.col(text_col))
    dealt = rows.withColumn("_bucket", bucket).withColumn("_place", F.explode(places))
    return (
        dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(F.col("_place.ghost") == 0).drop("_bucket", "_place")
    )


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter (floor of code points) is replaced by
    the beginning of the next text: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, first_section, first_paragraph): the last two say where the trees part (null: nowhere)."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_of(quoted(text_col)).alias("t"))
    rows = with_next(rows, ["t"])
    n = F.char_length("t")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("t", F.lit(1), n - cut), F.substring("next_t", F.lit(1), cut))})
    rows = rows.withColumn("next_nodes", paragraph_nodes(F.col("next_t"))).drop("next_t")
    rows = with_tree(with_tree(rows, "t", "own"), "edited", "edited")
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("own_nodes"), F.col("edited_nodes")).alias("near_edited"),
        likeness(F.col("own_nodes"), F.col("next_nodes")).alias("near_next"),
        first_difference(F.col("own_sections"), F.col("edited_sections")).alias("first_section"),
        first_difference(F.col("own_paragraphs"), F.col("edited_paragraphs")).alias("first_paragraph"),
    )
