"""A published log whose epochs are committed once, as a data source.

Tasks write their rows to part files of their own names; what a reader sees is
only what a commit record lists.  The record of an epoch is written once and
under its number: an epoch that runs again after a failure finds its record,
keeps it, and drops its new parts.  Parts of failed tasks are in no record.

    spark.dataSource.register(EventLog)
    events.writeStream.format("event_log").option("path", root).option("checkpointLocation", c).start()
    spark.read.format("event_log").option("path", root).load()

The folder must be storage that tasks and driver share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.streaming import DataStreamWriter

SCHEMA = "value string"


@dataclass
class Parts(WriterCommitMessage):
    """The part files of a task."""

    names: list[str] = field(default_factory=list)


@dataclass
class Part(InputPartition):
    name: str


def _store(root: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/")


def committed(root: str) -> dict[int, list[str]]:
    """Epoch -> its part files."""
    store, path = _store(root)
    found = {}
    for info in store.get_file_info(fs.FileSelector(f"{path}/commits", allow_not_found=True)):
        if info.extension == "json":
            with store.open_input_stream(info.path) as stream:
                found[int(info.base_name.removesuffix(".json"))] = json.loads(stream.read())
    return found


class LogWriter(DataSourceStreamArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _store(self.root)
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        store.create_dir(f"{path}/parts", recursive=True)
        for batch in iterator:
            if writer is None:
                writer = pq.ParquetWriter(f"{path}/parts/{name}", batch.schema, filesystem=store)
            writer.write_batch(batch)
        if writer is None:
            return Parts()
        writer.close()
        return Parts([name])

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, path = _store(self.root)
        store.create_dir(f"{path}/commits", recursive=True)
        record = f"{path}/commits/{batchId}.json"
        if store.get_file_info(record).type == fs.FileType.File:
            self.abort(messages, batchId)  # this epoch has been published
            return
        # Written aside and renamed, so that a record is there whole or not at all.
        aside = f"{path}/commits/.{batchId}-{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as stream:
            stream.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        store.move(aside, record)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, path = _store(self.root)
        for name in [n for m in messages if m for n in m.names]:
            store.delete_file(f"{path}/parts/{name}")


class LogReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> Sequence[InputPartition]:
        return [Part(name) for names in committed(self.root).values() for name in names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Part):  # an empty log
            return
        store, path = _store(self.root)
        with store.open_input_file(f"{path}/parts/{partition.name}") as file:
            yield from pq.ParquetFile(file).iter_batches()


class EventLog(DataSource):
    """``path``: folder of the log; ``columns``: its columns when it is read, ``value string`` if not given."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return self.options.get("columns", SCHEMA)

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return LogWriter(self.options["path"])


def publish(events: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """The stream writer that publishes events to a log; the caller sets the trigger and starts it."""
    events.sparkSession.dataSource.register(EventLog)
    return events.writeStream.format("event_log").option("path", root).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, root: str, columns: str = SCHEMA) -> DataFrame:
    """The committed rows of a log."""
    spark.dataSource.register(EventLog)
    return spark.read.format("event_log").option("path", root).option("columns", columns).load()
