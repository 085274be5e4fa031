"""Best-fit packing of documents into bins under conflicts of source and duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ready

CAPACITY = 16384
POOL_ROWS = 4096


class Bins:
    """Open bins in the order of their room, each with a bitmap of sources and one of clusters."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.sources, self.clusters = capacity, [], [], []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for an item: the tightest bin with room that holds neither its source nor its cluster, else a new one."""
        k = bisect_left(self.by_room, (size, -1))
        while k < len(self.by_room):
            room, b = self.by_room[k]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.by_room[k]
                break
            k += 1  # the successor is the next tightest
        else:
            room, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if room > size:
            insort(self.by_room, (room - size, b))
        return b, self.capacity - room


def pack_pool(items: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size, source, cluster), placed in the order of falling size, ties as they come.

    None as source or cluster conflicts with nothing. A cluster gets a bit only if two items hold it.
    """
    codes = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for _, s, _ in items if s is not None))}
    shared = [c for c, n in Counter(c for *_, c in items if c is not None).items() if n > 1]
    bits = {c: 1 << i for i, c in enumerate(shared)}
    bins, out = Bins(capacity), [(0, 0)] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, source, cluster = items[i]
        out[i] = bins.put(size, codes.get(source, 0), bits.get(cluster, 0))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, pool_rows: int = POOL_ROWS, cluster: str | None = None) -> DataFrame:
    """Packs every document into bins of `capacity` bytes such that no bin holds two of a source or of a duplicate cluster.

    Returns one row per piece: doc_id, piece, start, size, source, cluster, bin_id, bin_offset. size is in UTF-8 bytes; a
    document over the capacity is cut into pieces of capacity bytes, each full piece a bin of its own, and its rest is an item.
    start is the piece's first byte in the text. Null or empty texts are items of size 0: they take a place but no room.
    cluster names a column with the duplicate cluster (such as op10's component_id); without it, equal texts are a
    cluster, and near-copies may share a bin. Null sources and clusters conflict with nothing. Rows are dealt by hash
    into pools of about pool_rows, each packed on its own in one small task: two pools lose at most what their unfilled
    bins hold, and the successor search passes at most pool_rows bins. Repeated rows are items each, in pools of their
    own numbers; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    pools = max(1, -(-docs.count() // pool_rows))
    slim = docs.select(
        "doc_id", "source",
        (F.col(cluster) if cluster else F.when(F.octet_length("text") > 0, F.xxhash64("text"))).cast("string").alias("cluster"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
    )
    # equal rows are counted and written out again with a number each, which deals them to different pools
    cols = slim.columns
    groups = slim.groupBy(*cols).agg(F.count("*").alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {pool_rows}")))
    lone = groups.where("n = 1").select(*cols, F.lit(0).cast("long").alias("copy"))
    chunks = groups.where("n > 1").withColumn("chunk", chunk).repartition("doc_id", "chunk")
    copies = chunks.select(*cols, F.explode(F.sequence(F.col("chunk") * pool_rows, F.least(F.col("n"), (F.col("chunk") + 1) * pool_rows) - 1)).alias("copy"))
    items = lone.unionByName(copies).withColumn("pool", F.pmod(F.xxhash64("doc_id", "cluster", "copy", F.lit("pool")), F.lit(pools)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending"), ("copy", "ascending")])
        pool = t["pool"][0].as_py()
        rows = list(zip(*(t[c].to_pylist() for c in ("bytes", "source", "cluster"))))
        spots = pack_pool([(n - (max(n - 1, 0) // capacity) * capacity, s, c) for n, s, c in rows], capacity)
        out, full = [], 0
        for k, ((n, s, c), (b, at)) in enumerate(zip(rows, spots)):
            whole = max(n - 1, 0) // capacity
            for p in range(whole):
                out.append((k, p, p * capacity, capacity, f"{pool}-f{full}", 0))
                full += 1
            out.append((k, whole, whole * capacity, n - whole * capacity, f"{pool}-{b}", at))
        k, piece, start, size, bin_id, at = zip(*out)
        of = t.take(pa.array(k))
        return pa.table([of["doc_id"], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), of["source"], of["cluster"], pa.array(bin_id), pa.array(at, pa.int64())], ["doc_id", "piece", "start", "size", "source", "cluster", "bin_id", "bin_offset"])

    source = docs.schema["source"].dataType.simpleString()
    return items.groupBy("pool").applyInArrow(run, f"doc_id {kind}, piece int, start long, size long, source {source}, cluster string, bin_id string, bin_offset long")
