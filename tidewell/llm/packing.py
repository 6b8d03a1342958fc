"""Packs tokenised documents into fixed windows by concatenate and cut.

First pass: each document is tokenised once and written with its partition
number, its start among the partition's tokens and its ids.  The totals of the
partitions (one row each) give by a running sum where each partition starts in
the whole stream.  Second pass: each document is cut at the multiples of the
window; one that lies across a boundary gives one record on each side.

All windows but the last are full, so only the last is padded.  Null texts
count as empty and still carry their end token; repeated rows are packed again;
texts of any length are encoded whole, also long runs of white space; an empty
table gives no piece; other columns are ignored.  Ids are kept in 16 bits: a
vocabulary with larger ones stops with an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import bounded, named, stored
from tidewell.llm.vocabulary import encoded
from tidewell.session import work_folder

WINDOW = 2048
END_ID = 1


def _encoded(rows: DataFrame, path: str, end_id: int) -> DataFrame:
    """part, at (start within the part), doc_id, n and ids, which take 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in bounded(batches, "text"):
            ids = [np.array([*encoded(path, t or ""), end_id], dtype="<u2") for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            columns = [
                pa.array(np.full(len(n), part, dtype=np.int32)),
                pa.array(starts),
                batch.column("doc_id"),
                pa.array(n),
                pa.array([x.tobytes() for x in ids], pa.binary()),
            ]
            yield pa.record_batch(columns, ["part", "at", "doc_id", "n", "ids"])

    return rows.mapInArrow(run, f"part int, at long, doc_id {dict(rows.dtypes)['doc_id']}, n long, ids binary")


def pack(
    documents: DataFrame,
    path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, sequence_id, offset, doc_tokens and ids (binary, 16 bits each)."""
    rows = named(documents, doc_id=id_column, text=text_column)
    encoded = stored(_encoded(rows, path, end_id), work_folder(rows.sparkSession, "packing"))
    totals = encoded.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the input.
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = encoded.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("at"))
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "ids"):
            out: list[tuple] = []
            for doc, first, n, ids in zip(
                batch.column("doc_id").to_pylist(),
                batch.column("first").to_pylist(),
                batch.column("n").to_pylist(),
                batch.column("ids").to_pylist(),
                strict=True,
            ):
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, window)
                    length = min(window - offset, n - start)
                    out.append((doc, start, length, n, sequence, offset, ids[2 * start : 2 * (start + length)]))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types(batch), strict=True)], names=NAMES
            )

    def types(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.column("doc_id").type, *[pa.int64()] * 5, pa.binary()]

    return placed.select("doc_id", "first", "n", "ids").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids, as 32-bit integers, instead of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [
                zlib.crc32(np.frombuffer(x, dtype="<u2").astype("<u4").tobytes())
                for x in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in NAMES[:-1]], pa.array(crc, pa.int64())], names=[*NAMES[:-1], "ids_crc32"]
            )

    kept = ", ".join(f"{n} {t}" for n, t in pieces.dtypes if n != "ids")
    return pieces.select(*NAMES).mapInArrow(run, f"{kept}, ids_crc32 long")
