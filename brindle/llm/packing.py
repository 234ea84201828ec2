"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt to groups at random (by a hash of id and text's ids), each group is packed on its own, and the number of groups
follows the number of documents, so a group's size is bounded whatever the input.  Within a group:

* a document longer than ``length`` gives whole pieces of ``length`` ids and a remainder;
* remainders go, longest first, into the first bin with room, found by descending a tournament tree whose inner nodes hold
  the largest free capacity below them (O(log n) a piece);
* the emptiest bins are then broken up: their pieces are cut to fill holes of ``min_cut`` ids or more in the others.

Defined cases.  Null and empty texts are documents of the closing id alone; a null id is packed like any other.  Repeated rows are packed
as separate documents; equal ones lie in one group.  Ties of length go by id, nulls last, then by the ids themselves.  Texts may be of any length: batches are cut by
bytes, a document is cut over as many sequences as it needs.  An empty table gives no rows.  Columns other than the id and text are ignored,
so clashing names do no harm.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import as_bytes, in_pieces
from brindle.llm.token_counts import byte_alphabet

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Bytes of text whose words are numbered at once.
PIECE = 1 << 21
#: Words that a worker remembers.
REMEMBER = 700_000


class TournamentTree:
    """Bins of equal capacity, opened in order; ``fit`` finds the first with room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def fit(self, size: int) -> int:
        """The first bin with room for ``size``, whose capacity is taken; -1 if there is none."""
        best, i = self.best, 1
        if best[1] < size:
            return -1
        while i < self.leaves:
            i = 2 * i if best[2 * i] >= size else 2 * i + 1
        found = i - self.leaves
        best[i] -= size
        while i > 1:
            i >>= 1
            top = max(best[2 * i], best[2 * i + 1])
            if best[i] == top:
                break
            best[i] = top
        return found


def pack(lengths: list[int], length: int, min_cut: int = 32) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, bin, offset) of each piece; every id of every document is in exactly one."""
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # length, document, start
    bins = 0
    for d, n in enumerate(lengths):
        whole = n // length
        for k in range(whole):
            out.append((d, k * length, length, bins, 0))
            bins += 1
        if n % length:
            rest.append((n % length, d, whole * length))
    if not rest:
        return out
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = TournamentTree(len(rest), length)
    held: list[list[tuple[int, int, int]]] = []
    for piece in rest:
        b = tree.fit(piece[0])
        if b == len(held):
            held.append([])
        held[b].append(piece)
    free = [length - sum(p[0] for p in h) for h in held]
    order = sorted(range(len(held)), key=lambda b: (-free[b], b))
    holes = [b for b in reversed(order)]  # fullest first; the emptiest are broken up
    gone, at = 0, 0
    while gone < len(order):
        donor = order[gone]
        room = sum(free[b] for b in holes[at : len(holes) - gone - 1] if free[b] >= min_cut)
        if room < length - free[donor]:
            break
        todo = held[donor]
        held[donor] = []
        gone += 1
        while todo and at < len(holes) - gone:
            b = holes[at]
            if free[b] < min_cut:
                at += 1
                continue
            n, d, s = todo.pop()
            take = min(n, free[b])
            held[b].append((take, d, s))
            free[b] -= take
            if take < n:
                todo.append((n - take, d, s + take))
        if todo:  # pieces that found no hole stay where they were
            held[donor] = todo
            break
    for h in held:
        if h:
            at_offset = 0
            for n, d, s in h:
                out.append((d, s, n, bins, at_offset))
                at_offset += n
            bins += 1
    return out


#: A single mark between a letter or digit and white space is a pre-token of its own.
_MARK = re.compile(rb"[.,;:!?](?<=[a-z0-9][.,;:!?])(?=[ \n])")
#: The same by byte: 1 a lower-case letter or digit, 2 a mark, 3 a space or line feed.
_KINDS = np.array([1 if b in b"abcdefghijklmnopqrstuvwxyz0123456789" else 2 if b in b".,;:!?" else 3 if b in b" \n" else 0 for b in range(256)], np.uint8)


class _Ids(dict):
    """Word (its ASCII letters lower-cased) -> its ids as little-endian 16- or 32-bit units.

    This vocabulary drops white space and encodes a run of letters and a run of punctuation apart, so a text's ids are its
    words' ids in a row, and those of ``thing,`` are those of ``thing`` and of ``,``.  Words that aren't known yet are cut into such a stem and
    tail; unknown stems of Latin letters in composed form are merged together by the library's model; any other word is encoded whole
    by the library.  At most about ``most`` stems, as many words put together from them, and a quarter as many words encoded whole are remembered
    (some 150 bytes each), from task to task.
    """

    TAIL = b".,;:!?)]}\"%&*#$"

    def __init__(self, path: str, most: int = REMEMBER):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library, self.most, self.stems, self.odd = Tokenizer.from_file(path), most, {b"": b""}, {}
        self.model = Tokenizer(self.library.model)
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.kind = "H" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"

    @staticmethod
    def words(text: str | None) -> list[bytes]:
        raw = as_bytes(text)
        if b"<|" in raw:  # perhaps a special string, which is matched before letters are lower-cased
            return [w if b"<|" in w else w.lower() for w in raw.split()]
        return _MARK.sub(rb" \g<0>", raw.lower()).split()

    def encode(self, tokenizer, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        plain, tailed, stems, other, whole, tail, known, odd = [], [], {}, {}, [], self.TAIL, self.stems, self.odd
        for w in new:
            stem = w.rstrip(tail)
            if stem not in known and stem not in stems and stem not in other:
                if stem.isalpha():  # as bytes: of ASCII letters alone
                    stems[stem] = None
                elif w in odd:
                    self[w] = odd[w]
                    continue
                else:
                    text = stem.decode("utf-8", "replace")
                    # letters below U+0250 are composed, and lower to single letters but for a capital dotted I
                    if text.isascii() or not text.isalpha() or max(text) >= "\u0250" or "\u0130" in text:
                        whole.append(w)
                        continue
                    other[stem] = text.lower().encode().decode("latin-1").translate(self.shown)
            if len(stem) == len(w):
                plain.append(w)
            else:
                tailed.append((w, stem))
        texts = b" ".join(stems).decode("ascii").split(" ") if stems else []
        known.update(zip([*stems, *other], self.encode(self.model, [*texts, *other.values()])))
        self.update(zip(plain, map(known.__getitem__, plain)))
        tails = list({w[len(s) :] for w, s in tailed})
        ends = dict(zip(tails, self.encode(self.library, [t.decode() for t in tails])))
        for w, s in tailed:
            self[w] = known[s] + ends[w[len(s) :]]
        odd.update(zip(whole, self.encode(self.library, [w.decode("utf-8", "replace") for w in whole])))
        self.update((w, odd[w]) for w in whole)

    def prepared(self, text: str | None) -> bytes:
        """The text with its words, as ``words`` gives them, between white space."""
        raw = as_bytes(text)
        return b" ".join(self.words(text)) if b"<|" in raw else _MARK.sub(rb" \g<0>", raw.lower())

    def marked(self, texts: pa.StringArray) -> pa.StringArray:
        """Each text as ``prepared`` gives it, by passes over all their bytes; a mark at a text's edge may get a space too, which changes no ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return texts
        begin = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = bytes(memoryview(texts.buffers()[2] or b"")[begin[0] : begin[-1]])
        if b"<|" in raw:
            return pa.array(map(self.prepared, texts.to_pylist()), pa.string())
        raw, begin = np.frombuffer(raw.lower(), np.uint8), begin - begin[0]
        kind = _KINDS[raw]
        at = np.flatnonzero((kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 3)) + 1
        out, begin = np.insert(raw, at, 0x20), (begin + np.searchsorted(at, begin)).astype(np.int32)
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(begin), pa.py_buffer(out))

    def blobs(self, texts: pa.StringArray, end: bytes = b"") -> pa.BinaryArray:
        """The ids of each text and then ``end``.

        The texts' words are split and numbered by Arrow; each different word is looked up once, and the ids are gathered in whole arrays.
        """
        for held, most in ((self, self.most), (self.stems, self.most), (self.odd, self.most // 4)):
            if len(held) > most:
                held.clear()
        self[b""] = self.stems[b""] = b""  # white space at an edge gives an empty word, which has no ids
        split = pc.ascii_split_whitespace(self.marked(texts))
        number = split.values.dictionary_encode()
        words = number.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        made = list(map(self.get, words))
        missing = [i for i, v in enumerate(made) if v is None]
        self.learn([words[i] for i in missing])
        for i in missing:
            made[i] = self[words[i]]
        unit = np.dtype(np.uint16 if self.kind == "H" else np.uint32)
        size = np.fromiter(map(len, made), np.int64, len(made)) // unit.itemsize
        begin = np.cumsum(size) - size
        which = number.indices.to_numpy()
        times = size[which]
        after = np.concatenate([[0], np.cumsum(times)])
        ids = np.frombuffer(b"".join(made), unit)[np.repeat(begin[which] - after[:-1], times) + np.arange(after[-1])]
        # room for the end after each text
        stop = after[split.offsets.to_numpy()]
        tail = np.frombuffer(end, unit)
        count = np.diff(stop)
        out = np.empty(len(ids) + len(texts) * len(tail), unit)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)) * len(tail), count)] = ids
        ends = (np.cumsum(count + len(tail))).astype(np.int64)
        for j in range(len(tail)):
            out[ends - len(tail) + j] = tail[j]
        offsets = np.concatenate([[0], ends * unit.itemsize]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])

    def of(self, texts: list[str | None]) -> list[bytes]:
        return self.blobs(pa.array(map(as_bytes, texts), pa.string())).to_pylist()


_known: dict[tuple[str, int], _Ids] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, remember: int = REMEMBER) -> DataFrame:
    """doc_id, ids: each text's ids and then ``end_id``, as binary of 16- or 32-bit units (by the vocabulary's size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tokenizer_path, remember
        ids = _known.get(key) or _known.setdefault(key, _Ids(*key))
        end = array(ids.kind, [end_id]).tobytes()
        for batch in in_pieces(batches, PIECE):
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.blobs(batch.column(1), end)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def pack_sequences(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, group_docs: int = 2048, min_cut: int = 32, wide: bool = False, remember: int = REMEMBER) -> DataFrame:
    """Pack every document of (doc_id, text) into sequences of at most ``length`` ids.  Returns a row per piece.

    ``group_docs`` is the expected number of documents in a group.  The vocabulary must drop white space and never join
    words across it.  ``wide``: the vocabulary has over 65,536 ids.  ``remember``: words that a worker remembers, some 300 bytes each with their stems; fewer take
    longer and give the same.
    """
    groups = max(1, -(-docs.count() // group_docs))
    kind = np.uint32 if wide else np.uint16

    def run(key: tuple, table: pa.Table) -> pa.Table:
        doc, raw = table.column("doc_id").to_pylist(), table.column("ids").to_pylist()
        blobs = [np.frombuffer(b, kind) for b in raw]
        order = sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i] or 0, len(blobs[i]), raw[i]))
        pieces = pack([len(blobs[i]) for i in order], length, min_cut)
        base = key[0].as_py() << 32
        cols = [[], [], [], [], [], [], []]
        for d, s, n, b, o in pieces:
            i = order[d]
            for c, v in zip(cols, (doc[i], s, n, zlib.crc32(blobs[i][s : s + n].astype("<u4").tobytes()), len(blobs[i]), base + b, o)):
                c.append(v)
        return pa.table(dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), (pa.array(c, pa.int64()) for c in cols))))

    dealt = tokenize(docs, tokenizer_path, end_id, remember).withColumn("pack_group", F.pmod(F.xxhash64(F.lit("deal"), "doc_id", "ids"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(run, SCHEMA)
