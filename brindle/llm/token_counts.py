"""Counting tokens of a byte-level BPE vocabulary with a whole-token shortcut.

Once per worker it is proved which vocabulary strings are one token when they stand alone: the string is a single pre-token
and merging its bytes gives one id.  A pre-token among them counts 1 without any merging; only the rest is merged, once for
each distinct pre-token, by the library itself.  The vocabulary's special strings are cut out of a text first and count 1
each, as is the library's default.

Defined cases.  Null and empty texts have 0 tokens and 0 bytes; a null id is counted like any other.  Repeated rows are counted separately and
alike; nothing is compared, so there are no ties.  Texts of any length are counted whole, batches are cut by bytes.  An empty table gives no rows.  Columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import as_bytes, in_pieces

#: Fixed value: the pattern by which this family of vocabularies splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary -> that byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenCounts(dict):
    """pre-token -> number of tokens."""

    def __init__(self, path: str, most: int = 200_000):
        super().__init__()
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.split = regex.compile(SPLIT).findall
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.whole = self.prove(spec["model"]["vocab"])
        self.update(self.whole)

    def prove(self, vocab: dict[str, int]) -> dict[str, int]:
        """Vocabulary strings that are valid text, one pre-token, and one token alone."""
        alphabet, held = byte_alphabet(), []
        for shown in vocab:
            try:
                text = bytes(alphabet[c] for c in shown).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self.split(text) == [text]:
                held.append(text)
        return {t: 1 for t, e in zip(held, self.tokenizer.encode_batch(held, add_special_tokens=False)) if len(e.ids) == 1}

    def __missing__(self, pre: str) -> int:
        n = len(self.tokenizer.encode(pre, add_special_tokens=False).ids)
        if len(self) >= self.most + len(self.whole):
            self.clear()
            self.update(self.whole)
        if len(pre) <= 64:
            self[pre] = n
        return n

    def count(self, text: str) -> int:
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(p))) for p in parts)
        return sum(map(self.__getitem__, self.split(text)))


_known: dict[str, TokenCounts] = {}  # a Python worker proves and remembers once, not once a task


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _known.get(tokenizer_path) or _known.setdefault(tokenizer_path, TokenCounts(tokenizer_path))
        for batch in in_pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = pa.array([counts.count(t) for t in texts], pa.int64())
            size = pa.array([len(as_bytes(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
