"""Removing passages that occur in an earlier document, by suffix arrays of shards.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.  Strings are judged on
the input, they never cross documents, and every one is looked at:

1.  Documents equal to one with a smaller id are settled by a 256-bit hash and leave.
2.  The rest are dealt to buckets.  By winnowing, every string of ``length`` bytes chooses one of its 16-byte grams, the one with least hash, so
    equal strings choose equal grams.  A bucket's distinct grams go to shards by hash, as packed arrays; a shard tells which of
    them are in two documents or more.  A string whose gram is in one document alone occurs nowhere else.
3.  Runs of strings that chose a gram in several documents go to the gram's shard as context bytes, once for each bucket however often
    a passage occurs in it, with the smallest document.
4.  A shard builds the suffix array of its distinct contexts (those whose gram has several) by induced sorting, and finds runs of suffixes that share ``length`` bytes by permuted
    common prefixes.  Each run is one string, and has its smallest document in the corpus.
5.  That goes back to the buckets, where the bytes are removed.

The texts are shuffled once; the steps above read the same exchange.  Shards follow the number of documents.  A gram that stands in more than
``crowded`` buckets, as boilerplate does, is not left to one shard: its strings are dealt by eight more of their own bytes, those after the gram
where they lie in the string and those before it otherwise, so equal strings still meet.

Defined cases.  Null and empty texts have no bytes and stay.  A null id is never smaller than another: its text stays, and takes nothing from
others.  Rows of one id don't remove each other's bytes, whether their texts are equal or differ; each removes from larger ids.  Repeated rows each get a row, alike.
Texts shorter than ``length`` stay; long ones are never cut.  Empty tables give no rows.  Columns other than doc_id and text are ignored, and with ``carry`` held
in ``row``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import U, as_bytes, cut, drop_cut, give_back, mix, small
from brindle.llm.suffix_arrays import eights, shared_prefixes, suffix_array

GRAM = 16
#: Bytes next to a crowded gram by which its strings are dealt, and the shortest strings that have them on one side or the other.
BESIDE = 8
SPLITS_FROM = GRAM + 2 * BESIDE - 1
BLOBS = "bucket int, shard int, kind int, a binary, b binary, c binary, d binary"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def choose_grams(t: np.ndarray, length: int, step: int = 32_768) -> tuple[np.ndarray, np.ndarray]:
    """For the string of ``length`` bytes at each place, the place of the gram it chooses; and the hash of every gram.

    Worked out in pieces that stay in a core's cache.
    """
    strings, grams = len(t) - length + 1, length - GRAM + 1
    owner = np.empty(strings, np.int32)
    hashes = np.empty(len(t) - GRAM + 1, np.uint64)
    for a in range(0, strings, step):
        b = min(strings, a + step)
        m = b - a + grams - 1
        x = eights(t[a : a + m + GRAM - 1])
        with np.errstate(over="ignore"):
            h = mix(x[:m] * U(0x9E3779B97F4A7C15) ^ mix(x[8 : m + 8]))
        hashes[a : a + m] = h
        least, width = (h & U(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64), 1
        while width * 2 <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        owner[a:b] = (least & U(0xFFFFFFFF)).astype(np.int32) + np.int32(a)
    return owner, hashes


class Bucket:
    """A bucket's texts in a row, and for every run of ``length``-byte strings in them the gram they chose."""

    def __init__(self, table: pa.Table, length: int):
        rows = sorted(((d, as_bytes(t), i) for i, (d, t) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))), key=lambda r: r[:2])
        self.docs = np.array([d for d, _, _ in rows], np.int64)
        self.order = [i for _, _, i in rows]
        sizes = np.array([len(t) for _, t, _ in rows], np.int64)
        self.text = b"".join(t for _, t, _ in rows)
        self.t = np.frombuffer(self.text, np.uint8)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.length = length
        n = len(self.t)
        if n < length:
            self.first = self.last = self.owner = self.hash = np.empty(0, np.int64)
            self.of = np.empty(0, np.int64)
            return
        owner, h = choose_grams(self.t, length)  # of each string, by its first byte
        inside = np.zeros(n + 1, np.int8)  # strings that lie in one document
        long = sizes >= length
        np.add.at(inside, self.begins[long], 1)
        np.add.at(inside, self.ends[long] - length + 1, -1)
        valid = np.cumsum(inside[: len(owner)], dtype=np.int8) > 0
        new = np.r_[True, (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])]
        starts = np.zeros(n + 1, bool)
        starts[self.begins[long]] = True
        new |= starts[: len(new)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(owner)) - 1
        keep = valid[first]
        self.first, self.last = first[keep], last[keep]
        self.owner = owner[self.first]
        self.hash = h[self.owner]
        self.of = np.searchsorted(self.ends, self.first, side="right")

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct chosen grams, and whether two documents of the bucket have them."""
        if not len(self.first):
            return np.empty(0, np.uint64), np.empty(0, bool)
        doc = self.docs[self.of]
        order = np.argsort(self.hash, kind="stable")
        h, d = self.hash[order], doc[order]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[begin], np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)

    def split(self, crowded: np.ndarray) -> None:
        """Cut the runs of crowded grams by the side on which a string has BESIDE more bytes, and add those bytes to the key."""
        self.key = self.hash.copy()
        if self.length < SPLITS_FROM or not len(crowded) or not len(self.first):
            return
        hot = np.isin(self.hash & TOP, crowded)
        if not hot.any():
            return
        edge = self.owner[hot] - (self.length - GRAM - BESIDE)  # from here on a string has the bytes after its gram
        parts = []
        for first, last, at, side in ((self.first[hot], np.minimum(self.last[hot], edge - 1), self.owner[hot] - BESIDE, 1), (np.maximum(self.first[hot], edge), self.last[hot], self.owner[hot] + GRAM, 2)):
            some = first <= last
            beside = np.ascontiguousarray(self.t[at[some, None] + np.arange(BESIDE)]).view(np.uint64).ravel()
            with np.errstate(over="ignore"):
                key = mix(self.hash[hot][some] ^ mix(beside + U(side)))
            parts.append((first[some], last[some], self.owner[hot][some], self.hash[hot][some], self.of[hot][some], key))
        kept = tuple(x[~hot] for x in (self.first, self.last, self.owner, self.hash, self.of, self.key))
        every = [np.concatenate(x) for x in zip(kept, *parts)]
        order = np.argsort(every[0], kind="stable")
        self.first, self.last, self.owner, self.hash, self.of, self.key = (x[order] for x in every)

    def contexts(self, shared: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts of runs whose gram is shared, as they first occur (rows are sorted, so in the same order each time); their smallest and largest documents; the runs, and each one's context."""
        runs = np.flatnonzero(np.isin(self.hash & TOP, shared)) if len(self.first) else np.empty(0, np.int64)
        text, length = self.text, self.length
        held = [text[a : b + length] for a, b in zip(self.first[runs].tolist(), self.last[runs].tolist())]
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(x, len(number)) for x in held], np.int64)
        docs = self.docs[self.of[runs]]
        lo, hi = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).min)
        np.minimum.at(lo, which, docs)
        np.maximum.at(hi, which, docs)
        return list(number), lo, hi, runs, which


def _blobs(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["bucket", "shard", "kind", "a", "b", "c", "d"])


def _short(h: np.ndarray) -> np.ndarray:
    """The upper 40 bits, five bytes each: enough to tell which grams may be shared."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, 3:]


def _long(blob: bytes) -> np.ndarray:
    x = np.zeros((len(blob) // 5, 8), np.uint8)
    x[:, 3:] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return x.view(np.uint64).ravel()


def _shared(grams: list[bytes], crowded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shared grams that a bucket has been told, and the crowded ones among them."""
    if not grams:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = np.concatenate([_long(b) for b in grams])
    return np.unique(h), np.unique(h[np.concatenate([np.frombuffer(b, bool) for b in crowded])])


TOP = U(0xFFFFFFFFFF000000)


def shortest_documents(names: list[bytes], docs: np.ndarray, grams: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts, their smallest documents and chosen grams: where each one's strings begin in a row, and each string's smallest document over all contexts.

    Equal strings choose equal grams, so a context that is its gram's only one shares no string with another, and only the others are sorted.
    """
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    strings = sizes - length + 1
    offset = np.cumsum(strings) - strings
    out = np.repeat(docs, strings)
    _, number, times = np.unique(grams, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[number] > 1)
    if not len(some):
        return offset, out
    t = np.frombuffer(b"".join([names[i] for i in some.tolist()]), np.uint8)
    begins = np.cumsum(sizes[some]) - sizes[some]
    each = strings[some]
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    at = np.full(len(t), -1, np.int64)
    at[np.repeat(begins, each) + within] = np.repeat(offset[some], each) + within
    del within
    order = suffix_array(t, length)
    order = order[at[order] >= 0]
    run = np.flatnonzero(~np.r_[False, shared_prefixes(t, order, length)[1:]])
    string = at[order]
    del at
    out[string] = np.repeat(np.minimum.reduceat(out[string], run), np.diff(np.append(run, len(order))))
    return offset, out


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 50, bucket_docs: int = 1000, shard_docs: int = 2000, shards: int | None = None, carry: bool = False, crowded: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and kept_sha256 or, with ``carry``, kept (binary) and ``row`` (the whole row but its text), of every (doc_id, text).

    ``length`` is 24 at least.  Shards and buckets follow the number of documents, so each is
    a few MB whatever the input.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    shards = shards or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // shard_docs))
    whole_row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("no text")).alias("row")] if carry else []
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *whole_row)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    size = F.octet_length("text").cast("long")
    hashed = named.where(F.col("doc_id").isNotNull() & (size >= length))
    # a text's 256-bit hash is worked out once; a row is then known by its id and a short hash
    short = F.xxhash64("text")
    marks = cut(spark, hashed.select("doc_id", sha.alias("sha"), short.alias("short")))
    firsts = marks.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    copies = cut(spark, marks.join(firsts, "sha").where("doc_id > first").select(F.col("doc_id").alias("copy_id"), F.col("short").alias("copy_short")).distinct())
    drop_cut(spark, marks)
    gone = small(copies)
    is_copy = (F.col("doc_id") == F.col("copy_id")) & (short == F.col("copy_short"))
    blank = F.lit(b"").cast("binary") if carry else F.lit(EMPTY_SHA)
    whole = F.col("text").cast("binary") if carry else sha
    out_name = "kept" if carry else "kept_sha256"
    row = ["row"] if carry else []
    # one pass has the rows that need no bucket: copies go whole, those without an id or with too few bytes stay
    copied = F.col("copy_id").isNotNull() & (size >= length)
    none = F.lit(0).cast("long")
    aside = named.join(gone, is_copy, "left").where(F.col("doc_id").isNull() | (size < length) | copied)
    aside = aside.select("doc_id", size.alias("n_bytes"), F.when(copied, size).otherwise(none).alias("n_removed"), F.when(copied, 1).otherwise(none).alias("n_spans"), F.when(copied, blank).otherwise(whole).alias(out_name), *row)

    rest = hashed.join(gone, is_copy, "left_anti")
    buckets = max(1, -(-docs.count() // bucket_docs))
    placed = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))

    def grams(key: tuple, table: pa.Table) -> pa.Table:
        h, twice = Bucket(table, length).grams()
        shard = (h % U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        h, twice, cuts = h[order], twice[order], np.searchsorted(shard[order], np.arange(shards + 1))
        return _blobs([(key[0].as_py(), s, 0, _short(h[a:b]).tobytes(), twice[a:b].tobytes(), b"", b"") for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        at, a, b = (table.column(c).to_pylist() for c in ("bucket", "a", "b"))
        each = [_long(x) for x in a]
        h, twice = np.concatenate(each), np.concatenate([np.frombuffer(x, bool) for x in b])
        _, number = np.unique(h, return_inverse=True)
        in_buckets = np.bincount(number)
        good = (in_buckets + np.bincount(number, weights=twice) > 1)[number]
        hot = (in_buckets > crowded)[number]
        cuts = np.cumsum([0, *map(len, each)])
        return _blobs([(k, key[0].as_py(), 1, _short(h[i:j][good[i:j]]).tobytes(), hot[i:j][good[i:j]].tobytes(), b"", b"") for k, i, j in zip(at, cuts, cuts[1:]) if good[i:j].any()])

    def contexts(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        bucket = Bucket(table, length)
        known, hot = _shared(told.column("a").to_pylist(), told.column("b").to_pylist())
        bucket.split(hot)
        names, lo, hi, runs, which = bucket.contexts(known)
        if not names:
            return _blobs([])
        gram = np.zeros(len(names), np.uint64)
        gram[which] = bucket.key[runs]
        shard = (gram % U(shards)).astype(np.int64)
        rows = []
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            held = [names[i] for i in own.tolist()]
            rows.append((key[0].as_py(), s, 2, b"".join(held), np.fromiter(map(len, held), np.int32, len(held)).tobytes(), lo[own].tobytes(), np.array([own, hi[own], gram[own].view(np.int64)]).tobytes()))
        return _blobs(rows)

    def strings(key: tuple, table: pa.Table) -> pa.Table:
        at, text, sizes, lo, rest_ = (table.column(c).to_pylist() for c in ("bucket", "a", "b", "c", "d"))
        number: dict[bytes, int] = {}
        seen = []
        for x, n in zip(text, sizes):
            ends = np.cumsum(np.frombuffer(n, np.int32)).tolist()
            seen.append(np.array([number.setdefault(x[a:b], len(number)) for a, b in zip([0, *ends], ends)], np.int64))
        names, every = list(number), np.concatenate(seen)
        del text, number  # the contexts are in names
        docs_, grams_ = np.full(len(names), np.iinfo(np.int64).max), np.zeros(len(names), np.int64)
        np.minimum.at(docs_, every, np.concatenate([np.frombuffer(d, np.int64) for d in lo]))
        grams_[every] = np.concatenate([np.frombuffer(m, np.int64).reshape(3, -1)[2] for m in rest_])
        offset, least = shortest_documents(names, docs_, grams_, length)
        give_back()  # what sorting took
        ends = np.append(offset[1:], len(least))
        edge = np.r_[True, least[1:] != least[:-1]]
        edge[offset] = True
        begin = np.flatnonzero(edge)
        stop = np.append(begin[1:], len(least))
        lowest = np.searchsorted(begin, offset)
        highest = np.searchsorted(begin, ends)
        rows = []
        for k, ids, more in zip(at, seen, rest_):
            own, hi, _ = np.frombuffer(more, np.int64).reshape(3, -1)
            n = highest[ids] - lowest[ids]
            piece = np.repeat(lowest[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who = np.repeat(np.arange(len(ids)), n)
            useful = least[begin[piece]] < hi[who]
            piece, who = piece[useful], who[useful]
            if len(piece):
                base = offset[ids[who]]
                rows.append((k, key[0].as_py(), 3, own[who].astype(np.int32).tobytes(), (begin[piece] - base).astype(np.int32).tobytes(), (stop[piece] - base).astype(np.int32).tobytes(), least[begin[piece]].tobytes()))
        return _blobs(rows)

    def removed(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        bucket = Bucket(table, length)
        kind = np.array(told.column("kind").to_pylist())
        cols = [told.column(c).to_pylist() for c in "abcd"]
        known, hot = _shared(*([c[i] for i in np.flatnonzero(kind == 1)] for c in cols[:2]))
        bucket.split(hot)
        names, _, _, runs, which = bucket.contexts(known)
        said = np.flatnonzero(kind == 3)
        cover = np.zeros(len(bucket.t) + 1, np.int32)
        if len(said):
            own, a, b, least = (np.concatenate([np.frombuffer(c[i], k) for i in said]) for c, k in zip(cols, (np.int32, np.int32, np.int32, np.int64)))
            order = np.argsort(own, kind="stable")
            own, a, b, least = own[order], a[order], b[order], least[order]
            begin, end = np.searchsorted(own, which), np.searchsorted(own, which, side="right")
            n = end - begin
            piece = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            run = np.repeat(runs, n)
            hit = least[piece] < bucket.docs[bucket.of[run]]
            piece, run = piece[hit], run[hit]
            np.add.at(cover, bucket.first[run] + a[piece], 1)
            np.add.at(cover, bucket.first[run] + b[piece] + length - 1, -1)
        gone_ = np.cumsum(cover[:-1]) > 0
        out: list[list] = [[], [], [], [], []]
        for d, a_, b_ in zip(bucket.docs.tolist(), bucket.begins.tolist(), bucket.ends.tolist()):
            g = gone_[a_:b_]
            n_gone = int(g.sum())
            kept = bucket.text[a_:b_] if not n_gone else bucket.t[a_:b_][~g].tobytes()
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n_gone else 0
            for c, v in zip(out, (d, b_ - a_, n_gone, spans, kept if carry else hashlib.sha256(kept).hexdigest())):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary() if carry else pa.string())
        carried = [table.column("row").combine_chunks().take(pa.array(bucket.order, pa.int64()))] if carry else []
        return pa.table([*[pa.array(c, k) for c, k in zip(out, kinds)], *carried], names=["doc_id", "n_bytes", "n_removed", "n_spans", out_name, *row])

    told = placed.groupBy("bucket").applyInArrow(grams, BLOBS).groupBy("shard").applyInArrow(shared, BLOBS)
    found = placed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(contexts, BLOBS).groupBy("shard").applyInArrow(strings, BLOBS)
    answers = told.unionByName(found)
    kept = placed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(removed, aside.schema)
    return kept.unionByName(aside)


def strip_stage(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """The columns of ``docs`` with repeated passages taken out of ``text`` (and ``n_chars``, if there is one, counted anew).

    A character whose bytes are removed in part goes as a whole.  Every row stays, also one whose text is empty now.
    """
    done = remove_repeats(spark, docs, length, carry=True)
    # what is left of a character is no valid UTF-8: it is marked and the mark dropped
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\uFFFD", "")
    same = F.col("n_removed") == 0
    new = {"text": F.when(F.col("row.`no text`"), None).when(same, F.col("kept").cast("string")).otherwise(left)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
