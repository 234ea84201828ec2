"""What the corpus operators share: word splitting, 64-bit mixing, written cuts and size-checked broadcasts.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  ``bytes.split()`` splits on exactly those six
bytes, and none of them occurs inside a multi-byte UTF-8 character, so it is used throughout.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SEPARATORS = r"[ \t\n\u000B\f\r]+"
#: Rows that may be broadcast after they have been counted; beyond it a shuffled join is used.
BROADCAST_ROWS = 2_000_000

#: Bytes of text that a Python worker turns into one array of results; longer batches are cut, single rows never are.
BATCH_BYTES = 1 << 23

U = np.uint64
M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of SplitMix64), elementwise."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(start, start + n, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


class WordHash(dict):
    """bytes -> 64-bit hash, remembered for at most ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.hash, self.most = xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self.hash(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(w: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles in order; a shorter sequence is one shingle of its own length; none if empty."""
    n = len(w)
    if n == 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        m = min(k, n)
        h = np.full(n - m + 1, (m * 0x9E3779B97F4A7C15) & M64, np.uint64)
        for j in range(m):
            h = (h ^ w[j : n - m + 1 + j]) * U(0xD6E8FEB86659FD93)
            h ^= h >> U(32)
        return mix(h)


def shingle_set(text: str | None, words: WordHash, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    return np.unique(shingle_hashes(words.of((text or "").encode("utf-8", "surrogatepass").lower().split()), k))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="brindle-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_written: list[tuple[SparkSession, str]] = []


def discard(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
        pass


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        discard(spark, path)


#: Hadoop without its native library starts a ``chmod`` for every file it makes in a local folder, and until that runs the process stands
#: for all of the JVM's memory once more.  So a working table has no files beside its parts; what a ``.crc`` file told, the pages' checksums do.
WRITE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "parquet.page.write-checksum.enabled": "true"}
READ = {"parquet.page.verify-checksum.enabled": "true"}


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and no executor is needed again."""
    path = f"{shared_dir(spark).rstrip('/')}/brindle-{uuid.uuid4().hex}"
    df.write.options(**WRITE).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).options(**READ).parquet(path)
    out._brindle_path = path
    return out


def drop_cut(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by ``cut`` once nothing reads it."""
    discard(spark, df._brindle_path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables cut inside are deleted at the end, but for the one that the yielded function writes and returns."""
    begin, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(cut(spark, df))
        return kept[-1]

    try:
        yield keep
    finally:
        ours = _written[begin:]
        del _written[begin:]
        for session, path in ours:
            if any(path == k._brindle_path for k in kept):
                _written.append((session, path))
            else:
                discard(session, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted and is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def give_back() -> None:
    """Memory that this process has freed goes back to the system: a worker lives on between tasks and serves other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_pieces(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches whose strings have about ``most`` bytes at most, or one row."""
    for batch in batches:
        if batch.num_rows < 2 or batch.nbytes <= most:
            yield batch
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > begin and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)
    give_back()
