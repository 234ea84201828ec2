"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

A document's set is its distinct 5-word shingles (64-bit hashes).  Documents with equal sets are one class, represented
by the smallest id, so thousands of exact copies are one row from there on.  Each class is sketched (Dahlgaard, Knudsen and
Thorup 2017): round i places every element in a random bin with a random value, earlier rounds win, and after ``bins``
rounds round ``bins + j`` throws all elements in bin j, so every bin is filled, and agreement of bins is concentrated about
the similarity as it is for independent samples.  The sketch is cut into bands of ``rows`` bins.

With 300 bins in 50 bands of 6, two sets of similarity 0.75 share no band with probability (1 - 0.75^6)^50 = 6e-5; at 0.8 it
is 3e-7.

Within a bucket no list of all pairs is made.  First every class is paired with the smallest of its bucket; these pairs are
checked on the full sets and joined into components.  Only buckets that still hold several components are looked at again, and
there pairs of classes from different components are compared in memory, by sketch and then on the full sets, and only links that
join two components come out.  A pair is checked if its sketches agree in 60 % of bins, six standard deviations below
0.75.  Every link that the bands retrieve is so either verified or lies within a component already.

Defined cases.  Empty, blank and null texts have an empty set and are linked with nothing.  A null id is a document of its own that is
never linked.  Rows of one id are one document: where their texts differ it has the links of each of them, and all its rows with words the same
component.  Ties cannot arise, since the smallest id is kept; of repeated rows ``keep_one`` keeps any one.  Texts may be of any length: batches
are cut by bytes, a set is never.  Empty tables give no rows.  Columns other than doc_id and text are ignored by ``near_duplicates`` and carried by
``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import U, WordHash, cut, drop_cut, in_pieces, mix, scratch, seeds, shingle_set, small
from brindle.llm.components import components

BINS, ROWS = 300, 6
#: Rows of a bucket that one task compares with each other.
CROWD = 2000
#: Bins that must agree before a pair's full sets are compared.
AGREE = 0.6

_words: list[WordHash] = []


def word_hash() -> WordHash:
    if not _words:
        _words.append(WordHash())
    return _words[0]


def sketch(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.full(bins, U(0xFFFFFFFFFFFFFFFF))
    step = max(1, int(1.2 * bins * np.log(bins) / len(x)))
    i = 0
    while i < bins:
        n = min(step, bins - i)
        h = mix(x[None, :] ^ _SEEDS[i : i + n, None])
        b = ((h >> U(32)) * U(bins) >> U(32)).astype(np.intp)
        v = (np.arange(i, i + n, dtype=np.uint64)[:, None] << U(48)) | (h & U(0xFFFFFFFFFFFF))
        np.minimum.at(out, b.ravel(), v.ravel())
        i += n
        step = 4
        if (out >> U(48) < U(bins)).all():
            return out
    for b in np.flatnonzero(out >> U(48) >= U(bins)):
        out[b] = (U(bins + b) << U(48)) | (mix(x ^ _SEEDS[bins + b]) & U(0xFFFFFFFFFFFF)).min()
    return out


_SEEDS = seeds(2 * BINS, 1000)


def band_hashes(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = s.reshape(-1, rows)
        h = np.arange(len(s), dtype=np.uint64)
        for j in range(rows):
            h = mix(h * U(0x9E3779B97F4A7C15) ^ s[:, j])
        return h


PROFILE = "doc_id long, n_shingles long, f1 long, f2 long, marks binary, bands array<long>"


def profiles(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit fingerprint of the set, low bytes of the sketch, and band hashes of every (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_hash()
        with np.errstate(over="ignore"):
            for batch in in_pieces(batches):
                n, f1, f2, marks, bands = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    x = shingle_set(text, words)
                    n.append(len(x))
                    f1.append(int(x.sum().astype(np.int64)))
                    f2.append(int(mix(x ^ U(0x5851F42D4C957F2D)).sum().astype(np.int64)))
                    s = sketch(x) if len(x) else None
                    marks.append(None if s is None else s.astype(np.uint8).tobytes())
                    bands.append(None if s is None else band_hashes(s).astype(np.int64))
                arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in (n, f1, f2)], pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "f1", "f2", "marks", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PROFILE)


def shingles(docs: DataFrame) -> DataFrame:
    """id, shingles of every (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_hash()
        for batch in in_pieces(batches):
            made = [shingle_set(t, words).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<long>")


def _agreeing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches agree in AGREE of their bins."""
    m = marks.select(F.col("id"), "marks")
    both = pairs.join(m.withColumnsRenamed({"id": "a", "marks": "ma"}), "a").join(m.withColumnsRenamed({"id": "b", "marks": "mb"}), "b").select("a", "b", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= AGREE * x.shape[1]))

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles of the documents named in ``ids``: a row per different set of a document."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = shingles(named.join(small(ids), named["doc_id"] == ids["id"], "left_semi"))
    return sets.groupBy("id", F.xxhash64("shingles").alias("set")).agg(F.max("shingles").alias("shingles")).drop("set")


def _verified(spark: SparkSession, pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives with 100 * intersection >= percent * union, by their full sets."""
    pairs = cut(spark, pairs.distinct())
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    left = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), common.alias("common")).where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Links that join different components of a bucket, at most one for each two components that meet.

    rows: bucket, band, id, component, marks, bands, shingles.  A bucket of over CROWD rows is dealt to parts, and every two
    parts of it are compared in a task of their own, so no task holds more than 2 * CROWD rows of it, more or less.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, part = np.array(table.column("id")), np.array(table.column("part"))
        comp = np.unique(np.array(table.column("component")), return_inverse=True)[1]
        m = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)
        flat = table.column("shingles").combine_chunks()
        begin, values = np.array(flat.offsets), np.array(flat.values)
        band, two = int(np.array(table.column("band"))[0]), key[1].as_py() != key[2].as_py()
        a, b = [], []
        for i in range(len(ids) - 1):
            rest = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & ((part[i + 1 :] != part[i]) if two else True))
            if not len(rest):
                continue
            same = m[rest] == m[i]
            good = same.sum(axis=1) >= AGREE * m.shape[1]
            if band:  # a pair that shares an earlier band is compared there
                good &= ~(bands[rest, :band] == bands[i, :band]).any(axis=1)
            x = values[begin[i] : begin[i + 1]]
            for j in rest[good].tolist():
                if comp[i] != comp[j]:
                    y = values[begin[j] : begin[j + 1]]
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * n >= percent * (len(x) + len(y) - n):
                        a.append(int(ids[i]))
                        b.append(int(ids[j]))
                        comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sized = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts"))
    dealt = rows.join(sized, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("parts", "other")
    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every (doc_id, text); documents are linked at ``percent`` similarity.

    The result is written in the shared folder, and what led to it is deleted.
    """
    with scratch(spark) as keep:
        return keep(_groups(spark, docs, percent))


def _same_document(spark: SparkSession, every: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of documents that have rows with different sets; None if there are no such documents."""
    kind = ["n_shingles", "f1", "f2"]
    rows = every.where("n_shingles > 0 and doc_id is not null")
    several = cut(spark, rows.groupBy("doc_id").agg(F.min(F.struct(*kind)).alias("lo"), F.max(F.struct(*kind)).alias("hi")).where("lo < hi").select("doc_id"))
    if several.isEmpty():
        return None
    own = cut(spark, rows.join(small(several), "doc_id", "left_semi").join(classes.select(*kind, "class_id"), kind).select("doc_id", F.col("class_id").alias("b")).distinct())
    return own.join(own.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a < b").select("a", "b")


def _groups(spark: SparkSession, docs: DataFrame, percent: int) -> DataFrame:
    every = cut(spark, profiles(docs))
    # a class is a row from here on; partial minima are taken before the shuffle, so many copies are few rows
    least = [F.min_by(c, "doc_id").alias(c) for c in ("marks", "bands")]
    classes = cut(spark, every.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("class_id"), *least))
    firsts = classes.withColumnRenamed("class_id", "id")
    marks = firsts.select("id", "marks")
    placed = firsts.select("id", F.posexplode("bands").alias("band", "bucket"))
    crowded = placed.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("bucket", "least")
    buckets = cut(spark, placed.join(crowded, "bucket").select("bucket", "band", "id", "least"))

    stars = buckets.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(spark, _agreeing(stars, marks), docs, percent)
    together = _same_document(spark, every, classes)
    links = cut(spark, links if together is None else links.unionByName(together))
    found = cut(spark, components(spark, links))
    named = buckets.join(found.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    rows = cut(spark, named.join(mixed, "bucket").select("bucket", "band", "id", "component"))
    sets = _sets(docs, rows.select("id").distinct()).join(firsts.select("id", "marks", "bands"), "id")
    more = cut(spark, _across(rows.join(sets, "id"), percent))
    if not more.isEmpty():
        found = cut(spark, components(spark, links.unionByName(more)))
    drop_cut(spark, buckets)

    whole = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "class_id").alias("component"))
    out = every.join(whole, ["n_shingles", "f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group (one of repeated rows); rows without an id all stay."""
    kept = near_duplicates(spark, docs, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where(docs["doc_id"].isNotNull())
    one = named.join(kept, named["doc_id"].cast("long") == kept["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where(docs["doc_id"].isNull()))
