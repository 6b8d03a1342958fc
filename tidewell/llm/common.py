"""Reading, word hashing and small shared pieces of the operators.

Words are lower-cased in A-Z and split at ASCII white space.  They are hashed
to 64 bits straight from the bytes of an Arrow column, many documents at once;
no Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
_U = np.uint64
_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space, control characters and punctuation of ASCII.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[_LOWER]
_BASE = _U(0xD6E8FEB86659FD93)
_PLACE = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | _U(1)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's offset in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and how many words precede each row; ``apart``: the bytes between words."""
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, computed over a quarter of a megabyte at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = ends - starts
    filled = np.cumsum(lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max(initial=0)) + 1, _BASE, dtype=np.uint64))
    a = 0
    while a < len(starts):
        done = filled[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(filled, done + _BYTES, side="right")))
        n = lengths[a:b]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        value = _TABLE[data[at + np.repeat(starts[a:b], n)]] * powers[at]
        out[a:b] = mix(np.add.reduceat(value, first) + n.astype(np.uint64))
        a = b
    return out


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word shingles of one document, in order; with fewer words one of the whole sequence."""
    if not len(words):
        return words
    if len(words) < k:
        return mix((words * _PLACE[: len(words)]).sum(keepdims=True) + _U(len(words)))
    h = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        h += words[j : len(words) - k + 1 + j] * _PLACE[j]
    return mix(h)


def document_words(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each row."""
    data, offsets = column_bytes(column)
    starts, ends, first = find_words(data, offsets)
    hashes = hash_words(data, starts, ends)
    for i in range(len(column)):
        yield hashes[first[i] : first[i + 1]]


def bounded(batches: Iterable[pa.RecordBatch], column: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text is at most ``size`` bytes, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        filled = np.cumsum(lengths)
        a = 0
        while a < batch.num_rows:
            done = filled[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(filled, done + size, side="right")))
            yield batch.slice(a, b - a)
            a = b


def named(frame: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the needed columns, under names of our own, so that further or clashing ones do no harm."""
    return frame.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def free(name: str, taken: Iterable[str]) -> str:
    """The name for a column of our own beside those of the input: underscores follow while it is taken."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def stored(frame: DataFrame, folder: str) -> DataFrame:
    """Writes a step to the shared folder and reads it back, which cuts its lineage."""
    frame.write.mode("overwrite").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def most(frame: DataFrame, column: str, limit: int) -> DataFrame:
    """About ``limit`` rows of a stored table with the largest positive values, without a sort.

    Values are classed by their logarithm; a histogram of the classes, a few
    hundred rows, says from which class on all rows fit, and of the next class
    a share by hash is taken.
    """
    level = F.floor(F.log2(F.col(column)) * 8).cast("long")
    left, from_level, share = limit, None, 0.0
    for row in sorted(frame.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        from_level = row["level"]
        if row["count"] > left:
            share = left / row["count"]
            break
        left -= row["count"]
        share = 1.0
    if from_level is None:
        return frame
    drawn = F.pmod(F.xxhash64(*frame.columns), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    return frame.where((level > from_level) | ((level == from_level) & drawn))


#: Up to this many rows of two longs (16 MB) one side of a join is broadcast; beyond, both are shuffled.
BROADCAST_ROWS = 1_000_000


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it is proven to be small."""
    return F.broadcast(frame) if frame.count() <= rows else frame
