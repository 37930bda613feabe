"""Operator 4: mixing sources to target weights by Pareto order sampling. Built-in functions only.

A source's target is its share of the mix by weight, stopped at a multiple of its size, the excess reshared.
Target over size is the number of copies that each document of the source is due; the whole part is certain. For
the fraction pi, documents are ranked by random odds over inclusion odds, (u/(1-u)) / (pi/(1-pi)), u from a
hash of the document, and the smallest are taken until their sizes make up what the whole copies leave of the target.

The cut is found without a sort of a source. The rank statistic q is mapped to q/(1+q) in (0, 1) and dealt into
equal buckets, about BUCKET documents each near the cut (which lies about q = 1). Cumulated bucket sums say which
bucket holds the cut; buckets below are taken whole, and in that one bucket documents are taken in rank order as they fit.

Defined cases: null text is empty, of size 0; a null source is a source, the last one. Documents of size 0 take
no words. Repeated rows (same id, source and text) are folded to one entry with a count first, so they cannot
pile up in a bucket; of k such rows, the first few by number get the extra copy. An empty table gives an empty result.
Columns other than id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, quoted, text_hash, text_of, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a bucket of the rank statistic holds near the cut, in expectation, at most.
BUCKET = 1000


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def uniform(seed: str, *parts: str | Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of seed and parts."""
    h = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, entries, source_size, weight, target): one row per source, from rows (source, size, k).

    Water filling in closed form: by ascending cap/weight, the first source whose level (what is left for it and those
    behind it, by weight) is within its cap gives the level of all that are not capped."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("size") * F.col("k")).alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number % len(weights) + 1))
    per = per.withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "rank": F.row_number().over(by_ratio),
            "total": share * F.sum("source_size").over(every),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "rest_weight": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("capped")) / F.col("rest_weight")
    per = per.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    per = per.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("rank"))).over(every))
    return per.select("source", "entries", "source_size", "weight", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _ranked(rows: DataFrame, by_source: DataFrame, seed: str) -> DataFrame:
    """rows (id, source, ...) with the figures of their source and their bucket; by_source is a written table, one row a source."""
    out = rows.join(by_source.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    u = uniform(seed, "id", "source")
    q = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    out = out.withColumn("t", F.when(F.col("pi") > 0, q / (1 + q)))
    return out.withColumn("bucket", F.least(F.floor(F.col("t") * F.col("buckets")), F.col("buckets") - 1))


#: What of a ranked row is decided without a look at other rows: all but the bucket of its source that holds the cut.
_CLEAR = "pi <= 0 or cut is null or bucket <> cut"


def _clear_extra() -> Column:
    return ((F.col("pi") > 0) & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut")))).cast("int")


def _allocated(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, most: float, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked, by_source, at_cut): the folded entries with bucket and cut, the figures of each source, and the allotted entries of the
    buckets that hold a cut."""
    id_col, text_col, source_col = quoted(id_col), quoted(text_col), quoted(source_col)
    entries = (
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_hash(text_col).alias("text_hash"), word_count(text_col).alias("size"))
        .groupBy("id", "source", "text_hash", "size")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    entries = materialize(entries, "mix-entries")
    targets = materialize(source_targets(entries, weights, share, most), "mix-targets")
    t = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    t = t.withColumn("pi", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    t = t.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("entries") / BUCKET)).cast("long")).drop("entries", "weight")
    sums = _ranked(entries, t, seed).where("pi > 0").groupBy("source", "rest", "bucket").agg(F.sum(F.col("size") * F.col("k")).alias("words"))
    order = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(order)).where("upto > rest")
    cut = sums.groupBy("source").agg(F.min("bucket").alias("cut"), F.min_by(F.col("rest") - F.col("upto") + F.col("words"), "bucket").alias("room"))
    cut = cut.withColumnRenamed("source", "c_source")
    by_source = materialize(t.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "mix-sources")
    ranked = _ranked(entries, by_source, seed)
    # the one bucket of each source that holds its cut: entries in rank order, each taken as far as it fits
    item = F.struct("t", "id", "text_hash", "size", "k")
    bucket = ranked.where("pi > 0 and bucket = cut").groupBy("source", "source_size", "target", "whole", "room").agg(F.array_sort(F.collect_list(item)).alias("items"))
    fits = lambda a, x: F.when(x["size"] > 0, F.least(x["k"], F.floor(a["room"] / x["size"]).cast("long"))).otherwise(F.lit(0).cast("long"))
    start = F.struct(F.col("room").cast("double").alias("room"), F.array().cast("array<bigint>").alias("got"))
    step = lambda a, x: F.struct((a["room"] - fits(a, x) * x["size"]).cast("double").alias("room"), F.concat(a["got"], F.array(fits(a, x))).alias("got"))
    bucket = bucket.withColumn("got", F.aggregate("items", start, step)["got"])
    bucket = bucket.withColumn("x", F.explode(F.arrays_zip("items", "got")))
    at_cut = bucket.select(
        F.col("x.items.id").alias("id"), "source", F.col("x.items.text_hash").alias("text_hash"), F.col("x.items.size").alias("size"), F.col("x.items.k").alias("k"), "source_size", "target", "whole", F.col("x.got").alias("extra")
    )
    return ranked, by_source, at_cut


def allocate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per distinct (id, source, text): id, source, text_hash, size, k (equal rows), source_size, target, whole
    (copies that each of the k gets) and extra (how many of the k get one more)."""
    ranked, _, at_cut = _allocated(docs, id_col, text_col, source_col, weights, share, most, seed)
    keep = ["id", "source", "text_hash", "size", "k", "source_size", "target", "whole"]
    return ranked.where(_CLEAR).select(*keep, (F.col("k") * _clear_extra()).alias("extra")).unionByName(at_cut)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: (doc_id, source, size, source_size, target, copies, taken)."""
    rows = allocate(docs, **options).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "k")))
    copies = F.col("whole") + F.when(F.col("i") <= F.col("extra"), 1).otherwise(0)
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it was allotted. Rows outside the buckets of the cuts need
    only the figures of their source, so their texts stay where they are; those in them join the few entries there."""
    _, by_source, at_cut = _allocated(docs, id_col, text_col, source_col, weights, share, most, seed)
    row, c = unused(docs.columns, "row", "copies")
    whole = F.struct(*map(quoted, docs.columns)).alias(row)
    keyed = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), text_hash(F.col(quoted(text_col))).alias("text_hash"), whole)
    ranked = _ranked(keyed, by_source.select("source", "whole", "pi", "buckets", "cut"), seed)
    clear = ranked.where(_CLEAR).select(row, (F.col("whole") + _clear_extra()).alias(c))
    due = materialize(at_cut.select(F.col("id").alias("d_id"), F.col("source").alias("d_source"), F.col("text_hash").alias("d_hash"), "k", "extra"), "mix-at-cut")
    same = F.col("id").eqNullSafe(F.col("d_id")) & F.col("source").eqNullSafe(F.col("d_source")) & (F.col("text_hash") == F.col("d_hash"))
    cut = ranked.where(f"not ({_CLEAR})")
    some = "extra > 0 and extra < k"
    out = clear.unionByName(cut.join(due.where(f"not ({some})"), same).select(row, (F.col("whole") + (F.col("extra") >= F.col("k")).cast("int") * (F.col("extra") > 0).cast("int")).alias(c)))
    if not due.where(some).isEmpty():
        # of k equal rows some get one more: they are numbered within the partitions that read them, then by the partitions' counts
        rows = cut.join(due.where(some), same).select("id", "source", "text_hash", "whole", "extra", row, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
        rows = materialize(rows, "mix-repeated")
        key = ["id", "source", "text_hash"]
        counts = rows.groupBy(*key, "p").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before).select(*[F.col(x).alias(f"n_{x}") for x in key], F.col("p").alias("n_p"), "before")
        here = (F.col("p") == F.col("n_p")) & reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"n_{x}")) for x in key])
        numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key, "p").orderBy("at"))).join(counts, here)
        out = out.unionByName(numbered.select(row, (F.col("whole") + (F.col("n") + F.col("before") <= F.col("extra")).cast("int")).alias(c)))
    return out.where(F.col(c) > 0).withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(c)))).select(f"{row}.*")
