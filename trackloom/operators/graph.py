"""Connected components as alternating star contractions over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.spread import hot_least, join_by_key
from trackloom.session import discard, materialize, ship

#: Edges that a task contracts at once.
AT_ONCE = 1 << 20
#: A graph of so many star edges, half a megabyte, is settled by one task at once, as small tables are broadcast; a larger one by rounds.
FEW = 1 << 15


def min_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its component) of the links a[i]-b[i], without the roots themselves."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to star edges with the same components, over up to AT_ONCE edges of a partition at a time."""
    held, n = [], 0

    def stars() -> pa.RecordBatch:
        u, v = min_labels(*(np.concatenate([np.asarray(b.column(c)) for b in held]) for c in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= AT_ONCE:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_by_key(both, low, "u", hot_least(2 * rows)).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    # every edge points from its larger to its smaller end here
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_by_key(edges, low, "u", hot_least(rows)).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, few: int | None = None) -> DataFrame:
    """Components of an undirected graph of longs: one row (node, component) per node with an edge, component = least node reachable.

    Edges are first contracted to stars inside their partitions. If `few` (FEW) or less are left, one task contracts these;
    else each node takes its least centre, the graph of the centres alone is settled, and nodes follow their centre. Large-star
    and small-star rounds over the centres alternate until no edge changes, and their number grows with the logarithm of the
    graph. Each round is written to the shared folder, so lineage stays short; nothing is collected but the count and checksum that are taken while writing. Null ends and
    loops are ignored; an empty edge table gives an empty result. Hubs are safe: minima combine before the shuffle, and a
    node with many edges meets its minimum by broadcast (at most HOT_KEYS such nodes), not in one task.
    """
    few = FEW if few is None else min(few, AT_ONCE - 1)
    ship(edges.sparkSession)
    slim = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    now = _written(slim.mapInArrow(_contract, "u long, v long").distinct())
    if (now.measured["n"] or 0) <= few:
        return _named(_settled(now, few, max_rounds))
    rows = now.measured["n"]
    low = materialize(now.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-low")
    centres = now.select(F.col("v").alias("u")).distinct()
    beside = join_by_key(now, low, "u", hot_least(rows)).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = beside.unionByName(low.join(centres, "u", "left_semi").select("u", F.col("m").alias("v")))
    of = _settled(_written(linked.mapInArrow(_contract, "u long, v long").distinct()), few, max_rounds)
    # a centre's own row, if it has one, names its component; every other node has the one of its centre
    alone = centres.join(low, "u", "left_anti").select("u", F.col("u").alias("m"))
    centred = low.select("u", "m").unionByName(alone)
    # a centre can hold many nodes, but those whose component has another name meet it by broadcast
    sized = of.join(centred.groupBy(F.col("m").alias("u")).agg(F.count("*").alias("n")), "u").select(F.col("u").alias("m"), "v", "n")
    moved = join_by_key(centred, sized, "m", hot_least(rows)).select(F.col("u").alias("node"), F.col("v").alias("component"))
    rest = centred.join(of.select(F.col("u").alias("m")), "m", "left_anti").select(F.col("u").alias("node"), F.col("m").alias("component"))
    out = materialize(moved.unionByName(rest), "cc-nodes")
    for df in (now, low, of):
        discard(df)
    return out


def _settled(now: DataFrame, few: int, max_rounds: int) -> DataFrame:
    """Star edges of whole components: node and least node, without the least nodes themselves."""
    for _ in range(max_rounds):
        if not now.measured["n"]:
            break
        if now.measured["n"] <= few:
            after = _written(now.coalesce(1).mapInArrow(_contract, "u long, v long"))
            discard(now)
            now = after
            break
        after = _written(_small_star(_large_star(now, now.measured["n"]), now.measured["n"]))
        done = after.measured == now.measured
        discard(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now


def _named(stars: DataFrame) -> DataFrame:
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _written(edges: DataFrame) -> DataFrame:
    # decimal sums cannot overflow, so equal measures mean equal edge sets but for a hash collision; a task that is run
    # again may add to them, which costs a further round at most
    return materialize(edges, "cc", n=F.count("*"), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
