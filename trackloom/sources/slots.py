"""Feeds that land slot by slot or page by page, as a Spark data source that a reader can follow.

A feed is a folder whose subfolders are named <key>=<number>: quarter-hour slots (yyyyMMddHHmmss), pages, versions. Each is
one input partition and is opened only in its task. Batch reads take conditions on the number before anything is opened;
streams have the last number read as their offset, so a reader goes on where its checkpoint stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from trackloom.session import fresh_path, ship
from trackloom.sources.standins import positions

SCHEMA = "slot long, line string"
#: Bytes of a file that are held at once, and lines of a batch.
CHUNK, LINES = 1 << 22, 8192
#: Slots that a stream takes at once, unless the option says otherwise.
AT_ONCE = 96


class Slot(InputPartition):
    def __init__(self, number: int, folder: str):
        self.number, self.folder = number, folder


class Feed:
    """The slots of a folder. Any file system that pyarrow knows by URI; a bare path is the local one, which a cluster must share."""

    def __init__(self, options: dict):
        self.path, self.key = options["path"], options.get("key", "slot")
        self.at_once = int(options.get("slotsPerBatch", AT_ONCE))

    def slots(self) -> list[Slot]:
        files, root = self._open()
        found = []
        for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            key, _, number = f.base_name.partition("=")
            if f.type == fs.FileType.Directory and key == self.key and number.isdigit():
                found.append(Slot(int(number), f.path))
        return sorted(found, key=lambda s: s.number)

    def _open(self):
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def lines(self, slot: Slot) -> Iterator[pa.RecordBatch]:
        """Lines of a slot's files in the order of their names; .gz and the like are unpacked, hidden files left alone."""
        files, _ = self._open()
        found = files.get_file_info(fs.FileSelector(slot.folder, allow_not_found=True))
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path):
            with files.open_input_stream(f.path) as stream:
                rest, held = b"", []
                while chunk := stream.read(CHUNK):
                    *whole, rest = (rest + chunk).split(b"\n")
                    held += whole
                    while len(held) >= LINES:
                        yield self._batch(slot, held[:LINES])
                        held = held[LINES:]
                yield self._batch(slot, held + [rest] * bool(rest))

    @staticmethod
    def _batch(slot: Slot, lines: list[bytes]) -> pa.RecordBatch:
        text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([slot.number] * len(text), pa.int64()), pa.array(text, pa.string())], ["slot", "line"])


class SlotReader(DataSourceReader):
    """Conditions on the slot leave whole partitions out; they are all that is taken over from Spark's filters."""

    def __init__(self, feed: Feed):
        self.feed, self.tests = feed, []

    def pushFilters(self, filters):
        compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in compare and f.attribute == ("slot",):
                self.tests.append((compare[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Slot]:
        return [s for s in self.feed.slots() if all(test(s.number, value) for test, value in self.tests)]

    def read(self, partition: Slot | None) -> Iterator[pa.RecordBatch]:
        return self.feed.lines(partition) if partition else iter(())  # Spark asks once where there is no slot


class SlotFollower(DataSourceStreamReader):
    """A slot is read once it is there and a number above it or a `done` file says that it is whole."""

    def __init__(self, feed: Feed, first: int):
        self.feed, self.first = feed, first
        self.at: int | None = None  # how far this run has offered slots

    def initialOffset(self) -> dict:
        return {"slot": self.first}

    def latestOffset(self) -> dict:
        slots = [s.number for s in self.feed.slots()]
        files, _ = self.feed._open()
        whole = [s for s in self.feed.slots() if s.number < slots[-1] or any(f.base_name in ("_SUCCESS", "done") for f in files.get_file_info(fs.FileSelector(s.folder)))]
        ahead = [s.number for s in whole if s.number > (self.first if self.at is None else self.at)][: self.feed.at_once]
        self.at = ahead[-1] if ahead else self.first if self.at is None else self.at
        return {"slot": self.at}

    def partitions(self, start: dict, end: dict) -> list[Slot]:
        self.at = max(self.at or 0, end["slot"])
        return [s for s in self.feed.slots() if start["slot"] < s.number <= end["slot"]]

    def read(self, partition: Slot | None) -> Iterator[pa.RecordBatch]:
        return self.feed.lines(partition) if partition else iter(())  # Spark asks once where there is no slot

    def commit(self, end: dict) -> None:
        pass


class Landed(DataSource):
    """spark.read.format("landed").load(path), spark.readStream.format("landed").option("after", n).load(path): slot, line.

    Options: key, the name before the number (slot); after, the number a new stream starts behind (0); slotsPerBatch.
    """

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SlotReader:
        return SlotReader(Feed(self.options))

    def streamReader(self, schema) -> SlotFollower:
        return SlotFollower(Feed(self.options), int(self.options.get("after", 0)))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, with conditions pushed down to it."""
    ship(spark)
    spark.dataSource.register(Landed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def window(spark: SparkSession, path: str, newest: int, minutes: int, key: str = "slot") -> DataFrame:
    """Lines of the slots (yyyyMMddHHmmss) in the `minutes` up to the newest; slots that haven't landed are simply not there."""
    from datetime import datetime, timedelta

    register(spark)
    since = int((datetime.strptime(str(newest), "%Y%m%d%H%M%S") - timedelta(minutes=minutes)).strftime("%Y%m%d%H%M%S"))
    return spark.read.format("landed").option("key", key).load(path).where((F.col("slot") > since) & (F.col("slot") <= newest))


def land(lines: DataFrame, path: str, key: str = "slot") -> None:
    """Writes lines (slot, line) as such a feed, gzipped, a folder a slot; a slot's lines are dealt over the tasks that hold them."""
    lines.select(F.col("slot").alias(key), F.col("line").alias("value")).write.mode("append").partitionBy(key).option("compression", "gzip").text(path)


def _events(s, d) -> DataFrame:
    """The position log as comma-separated lines in slots of a day, written and read through the source."""
    path = fresh_path(s, "slots")
    p = positions(s, d)
    slot = F.date_format(F.timestamp_seconds(F.floor(F.col("ts") / 86_400) * 86_400), "yyyyMMddHHmmss").cast("long")
    land(p.select(slot.alias("slot"), F.concat_ws(",", "event_id", "entity_id", F.col("ts").cast("decimal(20,6)"), "kind").alias("line")), path)
    field = F.split("line", ",")
    lines = window(s, path, 20240110000000, 3 * 1440)
    return lines.select("slot", field[0].cast("long").alias("event_id"), field[1].cast("long").alias("entity_id"), field[2].cast("double").alias("ts"), field[3].alias("kind"))


QUERIES = {"scan_slots": _events}
ORACLES = {
    "scan_slots": """WITH e AS (SELECT *, CAST(strftime(date_trunc('day', ts), '%Y%m%d000000') AS BIGINT) AS slot FROM events)
    SELECT slot, event_id, user_id AS entity_id, epoch_us(ts) / 1000000.0::DOUBLE AS ts, event_type AS kind FROM e WHERE slot > 20240107000000 AND slot <= 20240110000000""",
}
