"""Language-model scores: prediction by partial matching over bytes, pretrained on the corpus.

Model.  Texts are bytes with A-Z lower-cased; the bytes and the end of a text, which also stands before it, are the symbols.
The trie has every context of orders 0 to 5 that the training documents have, exactly, in a written table that grows with
the corpus (``contexts``).  At a context, escape is estimated by method D (half a count of each symbol seen goes to the escape);
symbols that longer contexts have seen are excluded from the counts of shorter ones; below order 0 the symbols never seen are
equally likely.

Documents are dealt to blocks.  One pass over a block's texts counts its words and cells, the training documents' and, with count 0, the others'; the sums over
blocks are the word counts and the trie, and a block is joined with those of its words and contexts.  Nothing that grows with the corpus is collected or broadcast.

Defined cases.  Null and empty texts are one token, the end.  Without training documents every probability is uniform and the base score is 0.
A null id counts as the empty string for the split.  Repeated rows are scored alike, and train as often as they occur; counts are sums, so there are no
ties.  Texts of any length are scored whole, in steps bounded by bytes.  An empty table gives no rows.  Columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import contexts
from brindle.llm.common import as_bytes, cut

#: The longest context.
LONGEST = 5


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def trains(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(spark: SparkSession, docs: DataFrame, block_docs: int = 8000, order: int = LONGEST) -> DataFrame:
    """RESULT for every (doc_id, text): the base score over word counts and the model's log10 probability."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = max(1, -(-docs.count() // block_docs))
    shards = contexts.shards_for(blocks, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = named.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).withColumn("trains", trains(F.col("doc_id")))

    def read(key: tuple, table: pa.Table) -> pa.Table:
        """The block's cells and words by shard, each with its count in the training documents; the empty word is the end."""
        texts, is_trained = [as_bytes(t).lower() for t in table.column("text").to_pylist()], table.column("trains").to_pylist()
        learnt, rest = ([t for t, x in zip(texts, is_trained) if x is kind] for kind in (True, False))
        cell, n = contexts.counted(learnt, order)
        other, _ = contexts.counted(rest, order)
        cell, n = contexts.summed(np.concatenate([cell, other]), np.concatenate([n, np.zeros(len(other), np.int64)]))
        words: Counter[bytes] = Counter({b"": 0})
        for t in rest:
            words.update(dict.fromkeys(t.split(), 0))
        for t in learnt:
            words.update(t.split())
        words[b""] += len(learnt)
        rows = list(contexts.dealt(*contexts.every_order(cell, n, order), words, shards))
        shard, *blobs = zip(*rows)
        block = pa.array(np.full(len(rows), key[0].as_py(), np.int32))
        return pa.table([block, pa.array(shard, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]], names=["block", "shard", "cells", "counts", "words", "totals"])

    parts = cut(spark, placed.groupBy("block").applyInArrow(read, f"block int, shard int, {contexts.PART}"))
    grown = cut(spark, contexts.trie(parts, blocks))
    tokens, kinds = grown.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    scale = np.log10(float(tokens + kinds + 1))

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        have = contexts.word_totals(right)
        m = contexts.Rows(*contexts.joined(right), order)
        cols: list[list] = [[], [], [], [], [], [], []]
        texts = [as_bytes(t).lower() for t in left.column("text").to_pylist()]
        for doc, raw, mark in zip(left.column("doc_id").to_pylist(), texts, m.scores(texts)):
            c = np.array([*map(have.__getitem__, raw.split()), have[b""]], np.float64)
            for out, v in zip(cols, (doc, held_out(doc), len(c), int((c > 0).sum()), tokens, float(np.log10(c + 1).sum() - len(c) * scale), mark)):
                out.append(v)
        kinds_ = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds_)], names=[x.split()[0] for x in RESULT.split(", ")])

    return placed.groupBy("block").cogroup(contexts.looked_up(parts, grown, blocks).groupBy("block")).applyInArrow(score, RESULT)
