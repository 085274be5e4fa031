"""Embedding near-duplicates: int8 tile products with proven error bounds, full precision where they leave doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import min_labels, ready
from trackloom.functions.spread import hot_least, join_by_key
from trackloom.operators.graph import connected_components
from trackloom.session import materialize

THRESHOLD = 0.98
TILE = 2048
#: Rounding of a double-precision cosine and of the bound's own arithmetic.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows to int8 with one scale each, the norm of what the int8 row stands for, and the norm of the error."""
    top = np.abs(unit).max(axis=1)
    scale = np.where(top > 0, top / 127, 1.0)
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer dot products of int8 rows: float32 holds sums of up to 1,040 products of two int8 exactly."""
    out = np.zeros((len(a), len(b)), np.float64)
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, step: int = 512):
    """Blocks (rows of x, rows of y) of all pairs with cosine >= threshold.

    cos = sx sy (qx . qy) + rest with |rest| <= |ex| |y| + |back(x)| |ey|; a pair whose int8 product plus this bound is
    below the threshold cannot link. All others are recomputed in double precision from the vectors as given.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, bx, ex = quantise(x / nx[:, None])
    qy, sy, _, ey = quantise(y / ny[:, None])
    for k in range(0, len(x), step):
        s = slice(k, k + step)
        bound = ex[s, None] + bx[s, None] * ey[None, :] + SLACK
        i, j = np.nonzero(_dots(qx[s], qy) * (sx[s, None] * sy[None, :]) + bound >= threshold)
        for m in range(0, len(i), 1 << 16):
            a, b = i[m : m + (1 << 16)] + k, j[m : m + (1 << 16)]
            cos = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
            hit = cos >= threshold
            yield a[hit], b[hit]


def _tile_links(t: pa.Table, threshold: float) -> pa.Table:
    """Two tiles of one label to a row (rep, links, root) for each representative with a link here."""
    side = t["side"].to_numpy()
    rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
    # vectors of other lengths than a row's own never link: compare per length
    size = t["size"].to_numpy()
    links, edges = np.zeros(len(rep), np.int64), []
    same = bool(len(rep)) and t["i"][0].as_py() == t["j"][0].as_py()
    column = t["embedding"].combine_chunks()
    for d in np.unique(size):
        of = np.flatnonzero(size == d)
        v = np.stack([column[int(k)].values.to_numpy(zero_copy_only=False).astype(np.float64) for k in of])
        left = np.arange(len(of)) if same else np.flatnonzero(side[of] == 0)
        right = left if same else np.flatnonzero(side[of] == 1)
        if not len(left) or not len(right):
            continue
        for a, b in close_pairs(v[left], v[right], threshold):
            a, b = of[left[a]], of[right[b]]
            if same:
                a, b = a[a != b], b[a != b]
                np.add.at(links, a, copies[b])
            else:
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
            if len(a):
                edges.append(min_labels(rep[a], rep[b]))
    on = np.flatnonzero(links)
    root = dict()
    if edges:
        u, r = min_labels(*map(np.concatenate, zip(*edges)))
        root = dict(zip(u.tolist(), r.tolist()))
    return pa.table({"rep": rep[on], "links": links[on], "root": pa.array([root.get(x, x) for x in rep[on].tolist()], pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row, linking rows of equal non-null labels with cosine >= threshold.

    Needs vec_id, label, embedding; other columns are ignored. Equal vectors of a label are one representative, so copies
    are counted, not paired. Each label's representatives are dealt into tiles of about `tile` rows, and each pair of
    tiles is a group; it emits at most one row for each of its own. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null label or vec_id, link with nothing: n_links 0, component_id = vec_id.
    Vectors of unequal lengths don't link. Rows are vectors whatever their vec_id: a repeated row links with its copy, and
    a vec_id that stands at several vectors or labels is a row of its own at each. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good_row = F.coalesce(usable & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    grouped = rows.where(good_row).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    groups = materialize(grouped.withColumn("rep", F.monotonically_increasing_id()), "vector-reps", rows=F.sum("copies"))
    hot = hot_least(groups.measured["rows"] or 0)
    sizes = groups.groupBy("label").agg(F.count("*").alias("n")).withColumn("held", F.col("n"))
    tiled = (
        join_by_key(groups, sizes, "label", hot, "held")
        .withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
            "rep", "copies", F.size("embedding").alias("size"), "embedding",
        )
    )
    part = tiled.groupBy("label", "i", "j").applyInArrow(lambda t: _tile_links(t, threshold), "rep long, links long, root long")
    part = materialize(part, "vector-links")
    total = part.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(part.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    linked_groups = groups.join(total, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("component", "rep"))
    least = linked_groups.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("held"))
    named = join_by_key(linked_groups, least, "root", hot, "held").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.col("copies").alias("n"))
    # rows that link with nothing stay out of the join, and vectors of very many rows meet theirs by broadcast
    linked = join_by_key(rows.where(good_row), named, ["label", "embedding"], hot).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good_row).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
