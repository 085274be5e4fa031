"""Slot feeds as a data source: what is opened, and streams that stop and go on."""

import gzip
import os

from pyspark.sql import functions as F

from trackloom.sources import slots
from trackloom.sources.slots import EqualTo, GreaterThan, In, LessThanOrEqual


def put(root, number, lines, key="slot", done=True):
    folder = root / f"{key}={number}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part-0.gz").write_bytes(gzip.compress("".join(f"{x}\n" for x in lines).encode()))
    (folder / "part-1.txt").write_text("tail\r\nlast")
    if done:
        (folder / "_SUCCESS").write_text("")


def test_conditions_leave_slots_unopened(tmp_path):
    for n in (10, 20, 30, 40):
        put(tmp_path, n, [f"a{n}"])
    (tmp_path / "other=5").mkdir()
    (tmp_path / "slot=x").mkdir()
    reader = slots.SlotReader(slots.Feed({"path": str(tmp_path)}))
    left = list(reader.pushFilters([GreaterThan(("slot",), 10), LessThanOrEqual(("slot",), 40), In(("slot",), (20, 40, 50)), EqualTo(("line",), "x")]))
    assert [s.number for s in reader.partitions()] == [20, 40] and left == [EqualTo(("line",), "x")]
    assert [x for b in reader.read(reader.partitions()[0]) for x in b.column(1).to_pylist()] == ["a20", "tail", "last"]


def test_window_reads_its_slots_and_none_that_is_missing(spark, tmp_path):
    for n in (20240101000000, 20240101001500, 20240101003000, 20240101010000):
        put(tmp_path, n, [str(n), "", "ä"])
    got = slots.window(spark, str(tmp_path), 20240101010000, 45)
    assert sorted({r.slot for r in got.collect()}) == [20240101003000, 20240101010000]
    assert sorted(r.line for r in got.where("slot = 20240101010000").collect()) == sorted(["20240101010000", "", "ä", "tail", "last"])
    assert slots.window(spark, str(tmp_path / "none"), 20240101010000, 45).count() == 0
    pages = tmp_path / "pages"
    put(pages, 1, ["p1"], key="page")
    assert spark.read.format("landed").option("key", "page").load("file://" + str(pages)).count() == 3


def test_long_files_come_in_batches(tmp_path):
    put(tmp_path, 1, [f"line {i}" for i in range(20_000)])
    feed = slots.Feed({"path": str(tmp_path)})
    batches = list(feed.lines(feed.slots()[0]))
    assert max(b.num_rows for b in batches) <= slots.LINES and sum(b.num_rows for b in batches) == 20_002


def test_a_stream_stops_and_goes_on_without_loss_or_repeat(spark, tmp_path):
    slots.register(spark)
    feed, out = tmp_path / "feed", str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("landed").option("after", 10).option("slotsPerBatch", 2).load(str(feed))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.slot, r.line) for r in spark.read.parquet(out).collect()) if os.path.exists(out) else []

    for n in (10, 20, 30, 35):
        put(feed, n, [f"a{n}"])
    want = sorted((n, x) for n in (20, 30, 35) for x in (f"a{n}", "tail", "last"))
    assert run() == want
    assert run() == want  # nothing new
    put(feed, 40, ["a40"])
    put(feed, 50, ["a50"], done=False)  # still being written
    want = sorted(want + [(40, x) for x in ("a40", "tail", "last")])
    assert run() == want
    put(feed, 50, ["a50"])
    put(feed, 45, ["late"])
    got = run()
    assert got == sorted(want + [(n, x) for n, a in ((45, "late"), (50, "a50")) for x in (a, "tail", "last")])
    assert spark.read.parquet(out).groupBy("slot", "line").count().where(F.col("count") > 1).count() == 0
