"""Files of a dataset by prefix, as a data source.

``dataset_files`` lists only what a query asks for: its partitions are the
(dataset, channel, day) folders that the pushed filters name, and each task
lists its own folder.  Which bucket and prefix a dataset lies under comes from a
map with a default.  Dated folders hold dated files only, so an undated file is
never returned.

    spark.dataSource.register(DatasetFiles)
    files = asked_files(spark, places).where("dataset = 'raw' and channel = 'c1' and day between ...")
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

SCHEMA = "dataset string, channel string, day date, path string, length long, modified timestamp"
LAYOUT = "{prefix}{dataset}/{channel}/{day}"
DEFAULT = "default"
_DAY = datetime.timedelta(days=1)


@dataclass
class Folder(InputPartition):
    """One folder to list."""

    bucket: str
    path: str
    dataset: str
    channel: str
    day: datetime.date


class FolderReader(DataSourceReader):
    def __init__(self, places: Mapping[str, Mapping[str, str]], layout: str):
        self.places, self.layout = places, layout
        self.values: dict[str, set] = {}
        self.first: datetime.date | None = None
        self.last: datetime.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Notes the datasets, channels and days that are asked; Spark still applies every filter."""
        for one in filters:
            if isinstance(one, (EqualTo, In)) and len(one.attribute) == 1:
                asked = {one.value} if isinstance(one, EqualTo) else set(one.value)
                name = one.attribute[0]
                self.values[name] = self.values.get(name, asked) & asked
            elif one.__class__ in (GreaterThan, GreaterThanOrEqual) and one.attribute == ("day",):
                first = one.value + _DAY if isinstance(one, GreaterThan) else one.value
                self.first = max(self.first or first, first)
            elif one.__class__ in (LessThan, LessThanOrEqual) and one.attribute == ("day",):
                last = one.value - _DAY if isinstance(one, LessThan) else one.value
                self.last = min(self.last or last, last)
            yield one

    def _days(self) -> list[datetime.date]:
        if "day" in self.values:
            days = sorted(d for d in self.values["day"] if d is not None)
            return [d for d in days if (self.first or d) <= d <= (self.last or d)]
        if self.first is None or self.last is None:
            raise ValueError("name the days to list: an equality, or a first and a last day")
        return [self.first + _DAY * n for n in range((self.last - self.first).days + 1)]

    def partitions(self) -> Sequence[InputPartition]:
        for name in ("dataset", "channel"):
            if name not in self.values:
                raise ValueError(f"name the {name} to list")
        found = []
        for dataset in sorted(v for v in self.values["dataset"] if v):
            place = self.places.get(dataset) or self.places.get(DEFAULT)
            if place is None:
                raise ValueError(f"no bucket for {dataset}, and no default")
            for channel in sorted(v for v in self.values["channel"] if v):
                for day in self._days():
                    path = self.layout.format(prefix=place.get("prefix", ""), dataset=dataset, channel=channel, day=day)
                    found.append(Folder(place["bucket"], path, dataset, channel, day))
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Folder):  # nothing was asked
            return
        store, root = fs.FileSystem.from_uri(partition.bucket)
        folder = f"{root.rstrip('/')}/{partition.path}"
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            hidden = info.base_name.startswith(("_", "."))
            if info.type == fs.FileType.File and not hidden:
                modified = info.mtime.replace(tzinfo=None) if info.mtime else None
                yield partition.dataset, partition.channel, partition.day, info.path, info.size, modified


class DatasetFiles(DataSource):
    """``places``: JSON of dataset -> {bucket, prefix} with a ``default``; ``layout``: folder of a (dataset, channel, day)."""

    @classmethod
    def name(cls) -> str:
        return "dataset_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(json.loads(self.options["places"]), self.options.get("layout", LAYOUT))


def asked_files(spark: SparkSession, places: Mapping[str, Mapping[str, str]], layout: str = LAYOUT) -> DataFrame:
    """The files of the datasets, channels and days that the caller's filters name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DatasetFiles)
    return spark.read.format("dataset_files").option("places", json.dumps(places)).option("layout", layout).load()
