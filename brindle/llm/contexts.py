"""Exact contexts of bytes, and words: counting, the trie as packed rows of a table, and prediction by partial matching from the part that some texts need.

A cell is a context of ``order`` symbols and the symbol after it, a byte each, the newest lowest, below a bit that tells the order; so
orders up to 6 fit 64 bits.  Symbols are the bytes; 0xFF, which UTF-8 never has, is the end of a text, which also stands before it.  Nothing is
hashed away or left out: contexts are as many as the corpus has.

Blocks of texts count their cells and words and deal them to shards by a hash of the context or word, as packed arrays.  Shards follow the square root of the number of blocks:
what a block gives to a shard, and what a shard holds, both grow slowly.  Blocks are merged ``FAN`` at a time, so no task reads one array from every
block, and a shard is looked up by ``FAN`` blocks at a time.

Every symbol seen after a context has been seen after its suffixes, as the same positions are counted.  So what a context excludes
from its suffix is a sum over its own symbols, and a probability needs only a few sums per context and no list per position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import U, mix

SYMBOLS, END, BITS = 256, 0xFF, 8
#: Bytes of text looked at at once, cells held before they are summed, and blocks that a task merges or answers.
STEP, HELD, FAN = 1 << 21, 1 << 20, 1024


def steps(texts: list[bytes], most: int = STEP) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def cells(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every symbol of some texts, their ends included, and where each text begins among them."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = bytes([END]) * order
    s = np.frombuffer(pad + (pad + bytes([END])).join(texts) + bytes([END]), np.uint8).astype(np.int64)
    stop = order + np.cumsum(sizes + order + 1) - order - 1
    between = (stop[:, None] + np.arange(1, order + 1)).ravel()
    keep = np.ones(len(s), bool)
    keep[:order] = keep[between[between < len(s)]] = False
    out = s | (1 << (BITS * (order + 1)))
    for k in range(1, order + 1):
        out[k:] |= s[:-k] << (BITS * k)
    return out[keep], np.cumsum(sizes + 1) - sizes - 1


def shortened(x: np.ndarray, order: int) -> np.ndarray:
    """Contexts of ``order`` or more symbols cut to the newest ``order``."""
    mark = 1 << (BITS * order)
    return (x & (mark - 1)) | mark


def summed(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and their counts' sums."""
    if not len(cell):
        return cell, n
    by = np.argsort(cell, kind="stable")  # mostly runs that are in order already
    cell, n = cell[by], n[by]
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return cell[begin], np.add.reduceat(n, begin)


def counted(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of the longest order, and how often each one occurs."""
    cell = n = np.empty(0, np.int64)
    held: list[pa.StructArray] = []

    def fold() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([cell, *(x.field(0) for x in held)]), np.concatenate([n, *(x.field(1) for x in held)]))

    for some in steps(texts):
        held.append(pc.value_counts(pa.array(cells(some, order)[0])))
        if sum(map(len, held)) > HELD:
            cell, n = fold()
            held = []
    return fold()


def every_order(cell: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all orders, in order, from those of the longest."""
    out = [(cell, n)]
    for k in range(order, 0, -1):
        out.append(summed(shortened(out[-1][0], k), out[-1][1]))
    return np.concatenate([c for c, _ in reversed(out)]), np.concatenate([m for _, m in reversed(out)])


def packed(x: np.ndarray) -> bytes:
    """Sorted numbers as their differences, which are small."""
    return np.diff(x, prepend=0).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.int64))


def packed_counts(n: np.ndarray) -> bytes:
    """Counts in four bytes each, or eight if some are large."""
    return n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.int64).tobytes()


def unpacked_counts(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32 if len(blob) == 4 * size else np.int64).astype(np.int64)


def words_of(blob: bytes, counts: bytes) -> list[bytes]:
    """Words that were joined by spaces; the empty word may be one."""
    return blob.split(b" ") if counts else []


def shards_for(blocks: int, least: int) -> int:
    return max(least, 16 * math.isqrt(blocks))


def _deal(shard: np.ndarray, shards: int) -> tuple[np.ndarray, list[int]]:
    """The order by shard, and where each shard begins in it."""
    by = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    return by, np.searchsorted(shard[by], np.arange(shards + 1)).tolist()


def dealt(cell: np.ndarray, n: np.ndarray, words: dict[bytes, int], shards: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """shard, cells, counts, words, totals: the cells by their contexts' shard, the words by their own."""
    by, cuts = _deal((mix((cell >> BITS).astype(np.uint64)) % U(shards)).astype(np.int64), shards)
    cell, n = cell[by], n[by]
    names = sorted(words)  # neighbours are alike, which compresses
    order, marks = _deal(np.fromiter(map(crc32, names), np.int64, len(names)) % shards, shards)
    names = [names[i] for i in order.tolist()]
    totals = np.fromiter(map(words.__getitem__, names), np.int64, len(names))
    for s in range(shards):
        a, b, i, j = cuts[s], cuts[s + 1], marks[s], marks[s + 1]
        if b > a or j > i:
            yield s, packed(cell[a:b]), packed_counts(n[a:b]), b" ".join(names[i:j]), packed_counts(totals[i:j])


PART = "cells binary, counts binary, words binary, totals binary"


def joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The cells and counts of all rows."""
    cell = [unpacked(x) for x in table.column("cells").to_pylist()]
    n = [unpacked_counts(x, len(c)) for x, c in zip(table.column("counts").to_pylist(), cell)]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *cell]), np.concatenate([none, *n])


def word_totals(table: pa.Table) -> dict[bytes, int]:
    """The words of all rows and the sums of their totals."""
    out: dict[bytes, int] = {}
    get = out.get
    for blob, totals in zip(table.column("words").to_pylist(), table.column("totals").to_pylist()):
        names = words_of(blob, totals)
        for w, n in zip(names, unpacked_counts(totals, len(names)).tolist()):
            out[w] = get(w, 0) + n
    return out


def trie(parts: DataFrame, blocks: int) -> DataFrame:
    """shard, PART, tokens, kinds: a row per shard, from (block, shard, PART); words' tokens and kinds are those that have a count."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        cell, n = summed(*joined(table))
        seen = n > 0
        words = {w: n for w, n in sorted(word_totals(table).items()) if n}
        totals = np.fromiter(words.values(), np.int64, len(words))
        row = (key[0].as_py(), key[1].as_py(), packed(cell[seen]), packed_counts(n[seen]), b" ".join(words), packed_counts(totals), int(totals.sum()), len(words))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=["shard", "part", "cells", "counts", "words", "totals", "tokens", "kinds"])

    now, left = parts.withColumn("part", F.col("block")), blocks
    while True:
        left = -(-left // FAN)
        now = now.select("shard", F.floor(F.col("part") / FAN).cast("int").alias("part"), "cells", "counts", "words", "totals")
        now = now.groupBy("shard", "part").applyInArrow(merge, f"shard int, part int, {PART}, tokens long, kinds long")
        if left <= 1:
            return now.drop("part")


def looked_up(parts: DataFrame, grown: DataFrame, blocks: int) -> DataFrame:
    """block, PART: of the contexts that each row of ``parts`` has, all cells of the trie, and of its words the totals."""

    def answer(key: tuple, asked: pa.Table, shard: pa.Table) -> pa.Table:
        cell, n = joined(shard)
        total = word_totals(shard)
        own = cell >> BITS
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
        context, size = own[begin], np.diff(np.append(begin, len(own)))
        rows: list[list] = [[], [], [], [], []]
        for block, blob, names, marks in zip(*(asked.column(c).to_pylist() for c in ("block", "cells", "words", "totals"))):
            want = unpacked(blob) >> BITS
            want = want[np.r_[True, want[1:] != want[:-1]]] if len(want) else want
            at = np.searchsorted(context, want)
            at = at[at < len(context)]
            at = at[context[at] == want[: len(at)]]
            times = size[at]
            places = np.arange(times.sum()) + np.repeat(begin[at] - (np.cumsum(times) - times), times)
            have = words_of(names, marks)
            totals = np.fromiter((total.get(w, 0) for w in have), np.int64, len(have))
            for c, v in zip(rows, (block, packed(cell[places]), packed_counts(n[places]), names, packed_counts(totals))):
                c.append(v)
        return pa.table([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names=["block", "cells", "counts", "words", "totals"])

    groups = -(-blocks // FAN)
    asked = parts.select("block", "shard", F.floor(F.col("block") / FAN).cast("int").alias("part"), "cells", "words", "totals")
    told = grown.select("shard", "cells", "counts", "words", "totals").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1)))))
    return asked.groupBy("shard", "part").cogroup(told.groupBy("shard", "part")).applyInArrow(answer, f"block int, {PART}")


class Rows:
    """Cells of the trie with their counts: whole contexts, and all suffixes of each."""

    def __init__(self, cell: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        by = np.argsort(cell, kind="stable")
        # what isn't found is a last row without counts
        self.cell, self.n = np.append(cell[by], -1), np.append(n[by], 0).astype(np.float64)
        own = self.cell[:-1] >> BITS
        first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.empty(0, bool)
        begin = np.flatnonzero(first)
        self.context = np.append(own[begin], -1)
        self.row = np.append(np.cumsum(first) - 1, len(begin))  # of each cell, its context's
        self.seen = np.append(np.diff(np.append(begin, len(own))), 0)
        below = np.zeros(len(own))
        for k in range(1, order + 1):
            a, b = np.searchsorted(self.cell[:-1], [1 << (BITS * (k + 1)), 1 << (BITS * (k + 2))])
            below[a:b] = self.n[self.find(self.cell, shortened(self.cell[a:b], k))]
        # totals, and what the context's symbols count after its suffix
        self.total, self.out = (np.append(np.add.reduceat(x, begin) if len(begin) else [], 0.0) for x in (self.n[:-1], below))

    @staticmethod
    def find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Where each of x is, the last place if nowhere."""
        at = np.searchsorted(sorted_[:-1], x)
        return np.where(sorted_[at] == x, at, len(sorted_) - 1)

    def log10(self, cell: np.ndarray) -> np.ndarray:
        """log10 probability of each cell's symbol after its context."""
        out, todo = np.zeros(len(cell)), np.arange(len(cell))
        above = np.full(len(cell), len(self.context) - 1)
        for order in range(self.order, -1, -1):
            own = shortened(cell[todo], order + 1)
            at = self.find(self.cell, own)
            n, row = self.n[at], self.row[at]
            missed = np.flatnonzero(n == 0)
            row[missed] = self.find(self.context, own[missed] >> BITS)
            total, q = self.total[row] - self.out[above], self.seen[row] - self.seen[above]
            hit, escaped = n > 0, (n == 0) & (q > 0)
            out[todo[hit]] += np.log10((n[hit] - 0.5) / total[hit])
            out[todo[escaped]] += np.log10(0.5 * q[escaped] / total[escaped])
            todo, above = todo[~hit], row[~hit]
        out[todo] -= np.log10(SYMBOLS - self.seen[above])
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        """log10 probability of each text and its end."""
        out: list[float] = []
        for some in steps(texts):
            cell, begin = cells(some, self.order)
            kinds = pa.array(cell).dictionary_encode()
            values = kinds.dictionary.to_numpy()
            by = np.argsort(values)  # looked up in order
            each = np.empty(len(values))
            each[by] = self.log10(values[by])
            out += np.add.reduceat(each[kinds.indices.to_numpy()], begin).tolist()
        return out
