"""Mixing sources to target weights: Efraimidis-Spirakis sampling with exponential keys.

Each source has a target number of words.  ``target // size`` whole epochs of it come first; the rest of the budget is
filled by a weighted sample without replacement: every document draws the key ``-ln(u) / quality``, documents are sorted by
key within their source, and those whose running size stays within the budget are taken (to the nearest document).

``u`` is derived from an MD5 of the document id (of the text where the id is null), so reruns and SQL agree.  The running sum is
two-level: keys fall into slices by value, slices are summed first (a map-side aggregate), and only rows of one slice of one source
are sorted together, so a source with a third of all rows is no hot partition.  Slices follow the number of documents, and cut the keys by a curve under
which documents of any quality spread evenly, up to a small factor.  DataFrame functions throughout; words are counted once,
and the sizes and keys written in the shared folder (with ``keep_rows`` they are worked out twice instead, as rows are wide).

Defined cases.  A null or empty text has size 0 and the least quality; it is taken 0 words whatever its copies.  Documents without a source form a source
of their own, last in order.  Sources without any words have target 0, and their documents come once.  Repeated rows share a key and are
ordered by size; equal ones are interchangeable.  Ties of keys go by id, nulls last.  Texts may be of any length.  Empty tables give no rows.
Columns other than doc_id, text and source are ignored, and carried in ``row`` with ``keep_rows``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.common import cut

#: Expected documents in a slice, slices at least, and the rates whose exponential curves cut the keys (quality is 0.05 to 1).
SLICE_DOCS, SLICES = 65_536, 512
RATES = (1.0, 0.37, 0.14, 0.05)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\u000B\f\r]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """The sampling weight of a document: the share of characters that aren't symbols, 0.05 at least."""
    chars = F.coalesce(F.length(text), F.lit(0))
    symbols = chars - F.coalesce(F.length(F.regexp_replace(text, r"[#*$%&|<>]", "")), F.lit(0))
    return F.when(chars == 0, F.lit(0.05)).otherwise(F.greatest(F.lit(0.05), F.lit(1.0) - symbols.cast("double") / F.greatest(chars, F.lit(1))))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the id, or from the text where it is null: the first 13 hex digits of the MD5."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 13), 16, 10).cast("long")
    return (digits.cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """Per source: source_size and target.  ``sizes`` has source, size.

    Raising every source's share by weight and holding those that would pass ``most`` times their size is water-filling:
    with the sources sorted by ``most * size / weight`` the first few are held, and the level of the rest is the remaining
    total over the remaining weight.  The table of sources is small against the documents, and its windows run over it alone.
    """
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    held = held.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    order = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("rest", F.sum("source_size").over(W.partitionBy(F.lit(0))) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    held = held.withColumn("rest_w", F.sum("w").over(W.partitionBy(F.lit(0))) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    held = held.withColumn("level", F.col("rest").cast("double") / F.col("rest_w")).withColumn("full", F.col("cap").cast("double") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.struct(-F.col("cap") / F.col("w"), F.col("level")))).over(W.partitionBy(F.lit(0)))["level"]
    held = held.withColumn("top", level)
    return held.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("top") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, slices: int | None = None, keep_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every (doc_id, text, source); with ``keep_rows`` also ``row``, the whole row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        (-F.ln(uniform(F.col("doc_id").cast("long"), F.col("text"))) / quality(F.col("text"))).alias("key"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []),
    )
    if not keep_rows:
        rows = cut(docs.sparkSession, rows)
    slices = slices or max(SLICES, -(-docs.count() // SLICE_DOCS))

    def curve(key: Column) -> Column:
        """Falls short of 1 by the mean of the exponentials, so it rises with the key."""
        return F.lit(1.0) - sum((F.exp(-key * F.lit(r)) for r in RATES), F.lit(0.0)) / F.lit(float(len(RATES)))

    # inside the lambda the key, which is costly, is a value and not an expression that is worked out for every rate
    rows = rows.withColumn("slice", F.element_at(F.transform(F.array("key"), lambda k: F.floor(F.lit(slices) * curve(k))), 1).cast("int"))
    of_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    of_source = targets(of_slice.select("source", F.col("slice_size").alias("size")), weights, most)
    of_slice = of_slice.withColumn("before", F.coalesce(F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    plan = of_slice.alias("s").join(of_source.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "slice", "before", "source_size", "target")
    inner = W.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    kept = ["row"] if keep_rows else []
    r, p = placed.alias("r"), plan.alias("p")
    joined = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.slice") == F.col("p.slice"))).select(
        "doc_id", "size", "source_size", "target", (F.col("before") + F.col("inner")).alias("begin"), *kept
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(1)).cast("long")
    left = F.col("target") - (epochs * F.col("source_size")).cast("double")
    copies = epochs + ((F.col("source_size") > 0) & (F.col("begin") + F.col("size") / F.lit(2.0) <= left) & (left > 0)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "copies", *kept)
