"""Array primitives shared by the text operators: chunked byte access, word tables,
rolling hashes and sliding minima.

Everything here works on numpy arrays of one bounded chunk of documents.  A chunk
is a run of whole documents of about ``CHUNK_BYTES`` bytes (one document at least),
so memory follows the longest single text and not the Arrow batch.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
ROLL = 0xD1342543DE82EF95
MASK64 = (1 << 64) - 1

#: Word byte classes.  SPACE_WORDS: everything but ASCII white space;
#: LETTER_WORDS: digits, ASCII letters and all bytes of non-ASCII characters.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
LETTER_WORDS = np.zeros(256, dtype=bool)
LETTER_WORDS[0x30:0x3A] = True
LETTER_WORDS[0x41:0x5B] = True
LETTER_WORDS[0x61:0x7B] = True
LETTER_WORDS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream64(n: int, seed: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit values; a longer stream starts with the shorter one."""
    start = (seed * 0x632BE59BD9B4E019 + _MULT) & MASK64
    return mix64(np.arange(n, dtype=U64) * U64(_MULT) + U64(start))


_BYTE_VALUES = stream64(256, 7) | U64(1)
_POSITIONS = stream64(4096, 11)


def _position_values(n: int) -> np.ndarray:
    global _POSITIONS
    if n > len(_POSITIONS):
        _POSITIONS = stream64(1 << (n - 1).bit_length(), 11)
    return _POSITIONS


def byte_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_binary(column.type):
        column = column.cast(pa.string()).cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of documents of about limit bytes each."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


class Words:
    """Words of a chunk of documents: byte range, document ordinal, 64-bit hash of each."""

    __slots__ = ("buf", "doc", "end", "first", "hash", "n_docs", "start")

    def __init__(self, texts: list[bytes], classes: np.ndarray, fold: np.ndarray, hashed: bool = True):
        joined = b"\n".join(texts)
        self.n_docs = len(texts)
        self.buf = fold[np.frombuffer(joined, dtype=np.uint8)] if fold is not SAME else np.frombuffer(joined, dtype=np.uint8)
        inside = classes[self.buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        #: first[d]: ordinal of the first word of document d; first[n_docs]: number of words.
        self.first = np.searchsorted(self.start, np.concatenate(([0], ends)))
        if len(self.first):
            self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.hash = self._hashes(inside) if hashed else None

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        body = self.buf[inside]
        lens = self.end - self.start
        at = np.cumsum(lens) - lens
        pos = np.arange(len(body)) - np.repeat(at, lens)
        values = _BYTE_VALUES[body]
        values *= _position_values(int(lens.max()))[pos]
        return mix64(np.add.reduceat(values, at) + lens.astype(U64) * U64(_MULT))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def in_doc(self) -> np.ndarray:
        """Ordinal of each word in its document."""
        return np.arange(len(self.start)) - self.first[self.doc]

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def hash_word(word: bytes) -> int:
    """The hash Words gives one word."""
    return int(Words([word], np.ones(256, dtype=bool), SAME).hash[0])


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n consecutive values (length len - n + 1, empty if shorter)."""
    if len(values) < n or n < 1:
        return np.zeros(0, dtype=U64)
    whole: np.ndarray | None = None
    done, part, size, left = 0, values, 1, n
    while True:
        if left & 1:
            if whole is None:
                whole, done = part, size
            else:
                keep = len(values) - (done + size) + 1
                whole = whole[:keep] * U64(pow(ROLL, size, 1 << 64)) + part[done : done + keep]
                done += size
        left >>= 1
        if not left:
            return whole if whole is not values else values.copy()
        keep = len(part) - size
        part = part[:keep] * U64(pow(ROLL, size, 1 << 64)) + part[size : size + keep]
        size *= 2


def rolling_one(values: list[int]) -> int:
    out = 0
    for v in values:
        out = (out * ROLL + v) & MASK64
    return out


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    size = 1
    while size * 2 <= n:
        values = np.minimum(values[:-size], values[size:]) if len(values) > size else values[:0]
        size *= 2
    if size < n:
        shift = n - size
        values = np.minimum(values[:-shift], values[shift:]) if len(values) > shift else values[:0]
    return values


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns: anything else that the table carries is not read."""
    return df.select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: what a Python worker holds follows these and not the partition."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "4000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only with a local master and none named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(named or "/tmp/checkpoints", "rasterloom", spark.sparkContext.applicationId)


#: Folders of intermediate tables, removed when the driver ends.
_FOLDERS: set[str] = set()


def _remove_folders(spark: SparkSession) -> None:
    while _FOLDERS:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            _delete(spark, _FOLDERS.pop())


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._gateway.jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a written table in the shared folder, so later stages survive the loss of executors.

    Compressed columns take a fraction of the disk of a row checkpoint, and the written size lets small tables be joined
    without an exchange.  The application's tables go when the driver ends, or earlier with ``discard``.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove_folders, spark)
    path = os.path.join(folder, uuid.uuid4().hex)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame | None) -> None:
    """Removes the table of a checkpointed result that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        _delete(df.sparkSession, path)


def crc_mod(column: Column, n: int) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % F.lit(n)
