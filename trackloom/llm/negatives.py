"""Hard negatives by inner product, with an orthogonal PCA rotation that rules most rows out early.

Vectors are integers, so scores are exact. A rotation to the leading principal axes (eigenvectors of the table's second
moments) gathers most of a product in a few components: after some of them, the rest of a product is at most the product
of the two residual norms, by Cauchy and Schwarz, plus the slack of rounded sums. A row whose bound misses what an anchor
still looks for is dropped; survivors get their integer product. The rotation only decides what is dropped early: any
other one, or none, gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import map_arrow, ready
from trackloom.session import materialize

#: Anchors and rows of a group; components after which rows are dropped.
ANCHORS, TILE, STEPS = 1024, 8192, (8, 24, 64)
#: Relative rounding of products and norms in double precision, far above what sums of a million terms lose.
SLACK = 1e-9
#: Bound on products that double precision sums exactly; larger ones take Python's integers.
EXACT = 2**53
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


@dataclass
class Side:
    """Vectors of one length: ids, labels, integer components, and what bounds need: leading components, norms left after each step."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    lead: np.ndarray
    norm: np.ndarray
    rest: np.ndarray  # a row per step, the first before any
    unit: float  # lead, norm and rest are in this unit, so that they can't overflow

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, axes: np.ndarray | None) -> Side:
        unit = max(float(np.abs(v).max(initial=0)), 1.0)
        x = v / unit
        steps = () if axes is None else [k for k in STEPS if k <= axes.shape[1]]
        lead = x @ axes[:, : steps[-1]] if steps else np.zeros((len(v), 0))
        square = np.einsum("ij,ij->i", x, x)
        rest = [np.sqrt(np.maximum(square * (1 + SLACK) - np.einsum("ij,ij->i", lead[:, :k], lead[:, :k]), 0)) for k in (0, *steps)]
        return cls(ids, labels, v, lead, np.sqrt(square), np.stack(rest), unit)

    def pick(self, of) -> Side:
        return Side(self.ids[of], self.labels[of], self.v[of], self.lead[of], self.norm[of], self.rest[:, of], self.unit)


def survivors(a: Side, b: Side, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of a, row of b) in `alive` whose product may lie between low and high, which are given per row of a."""
    unit = a.unit * b.unit
    low, high = low[:, None] / unit, high[:, None] / unit
    slack = SLACK * (a.norm[:, None] * b.norm[None, :]) + 1e-12
    part, done = np.zeros(alive.shape), 0
    for k, upto in enumerate((0, *(s for s in STEPS if s <= a.lead.shape[1]))):
        if upto:
            part += a.lead[:, done:upto] @ b.lead[:, done:upto].T
            done = upto
        bound = a.rest[k][:, None] * b.rest[k][None, :] + slack
        alive = alive & (part + bound >= low) & (part - bound <= high)
        if not alive.any():
            break
    return np.nonzero(alive)


def products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of x[i] and y[j]; beyond a long they stop at its ends."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(x.shape[1], 1) < EXACT:
        parts = [np.einsum("ij,ij->i", x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]]) for k in range(0, len(i), 1 << 16)]
        return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    whole = [sum(int(p) * int(q) for p, q in zip(x[m], y[n])) for m, n in zip(i.tolist(), j.tolist())]
    return np.array([min(max(w, LONG_MIN), LONG_MAX) for w in whole], np.int64)


def first_of(key: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first `most` of each key by falling score and rising id, in this order."""
    order = np.lexsort((ids, ~score, key))
    k = key[order]
    return order[np.arange(len(k)) - np.searchsorted(k, k, "left") < most]


def search(a: Side, b: Side, low: np.ndarray, high: np.ndarray, most: int, same: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a and each of its windows, the first `most` rows of b with low <= product <= high.

    low and high have a row per row of a and a column per window; an empty window has low above high. same: whether b's
    rows need the label of a's, and another id, or another label. Returns row of a, window, id, product.
    """
    windows = low.shape[1]
    out = []
    labels = np.unique(a.labels) if same else [None]
    for label in labels:
        own = np.flatnonzero(a.labels == label) if same else np.arange(len(a.ids))
        other = np.flatnonzero(b.labels == label) if same else np.arange(len(b.ids))
        for k in range(0, len(own), step):
            at = own[k : k + step]
            x, lo, hi = a.pick(at), low[at], high[at]
            need = np.where(lo <= hi, lo, LONG_MAX).astype(np.float64)  # what a product must reach to matter still
            most_hi = np.where(lo <= hi, hi, LONG_MIN).max(axis=1).astype(np.float64)
            key, ids, score = (np.zeros(0, np.int64) for _ in range(3))
            for m in range(0, len(other), 4 * step):
                y = b.pick(other[m : m + 4 * step])
                allowed = x.ids[:, None] != y.ids[None, :] if same else x.labels[:, None] != y.labels[None, :]
                i, j = survivors(x, y, need.min(axis=1), most_hi, allowed)
                s = products(x.v, y.v, i, j)
                fits = (s[:, None] >= lo[i]) & (s[:, None] <= hi[i])
                r, w = np.nonzero(fits)
                key, ids, score = np.append(key, i[r] * windows + w), np.append(ids, y.ids[j[r]]), np.append(score, s[r])
                best = first_of(key, score, ids, most)
                key, ids, score = key[best], ids[best], score[best]
                last = np.searchsorted(key, np.arange(len(at) * windows), "right") - 1
                full = np.bincount(key, minlength=len(at) * windows) >= most
                need.reshape(-1)[full] = score[last[full]]
            out.append((at[key // windows], key % windows, ids, score))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 4))


def _sides(t: pa.Table, axes: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, Side]]:
    """By length of vector: which rows they are, and the rows."""
    column = t["v"].combine_chunks()
    sizes, flat = np.diff(np.asarray(column.offsets)), np.asarray(column.flatten())
    start = np.cumsum(sizes) - sizes
    ids, labels = np.asarray(t["vec_id"]), np.asarray(t["label"])
    for d in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == d)
        yield d, of, Side.of(ids[of], labels[of], flat[start[of][:, None] + np.arange(d)], axes.get(d))


def _searched(anchors: DataFrame, rows: DataFrame, axes: dict[int, np.ndarray], most: int, same: bool, blocks: int, tiles: int) -> DataFrame:
    """Every anchor with its first `most` rows per window, over all tiles: key, anchor_id, window, other, score, rank.

    anchors: key, vec_id, label, v and arrays low and high, of one length over all anchors. Each block of anchors meets each tile of rows in a group.
    """
    schema = "key long, anchor_id long, window int, other long, score long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = {"key": [], "anchor_id": [], "window": [], "other": [], "score": []}
        ys = {d: y for d, _, y in _sides(right, axes)} if left.num_rows else {}
        keys = np.asarray(left["key"])
        for d, of, x in _sides(left, axes) if ys else ():
            if d in ys:
                low, high = (np.asarray(left[c].combine_chunks().flatten(), np.int64).reshape(left.num_rows, -1)[of] for c in ("low", "high"))
                i, w, ids, score = search(x, ys[d], low, high, most, same)
                for c, values in zip(cols.values(), (keys[of][i], x.ids[i], w, ids, score)):
                    c.append(values)
        return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.int32() if k == "window" else pa.int64()) for k, v in cols.items()})

    spread = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(spread(blocks, 1).alias("i"), each(tiles).alias("j"), "key", "vec_id", "label", "v", "low", "high")
    right = rows.select(each(blocks).alias("i"), spread(tiles, 2).alias("j"), "vec_id", "label", "v")
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)
    order = Window.partitionBy("anchor_id", "key", "window").orderBy(F.desc("score"), F.asc("other"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (array<double> of floor(scale x)) and key of the rows that take part, repeated rows once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite

    def floor(x: Column) -> Column:  # floor() gives a long, which large components don't fit; from 2**53 on all doubles are whole
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(EXACT), F.floor(y).cast("double")).otherwise(y)

    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", floor).alias("v"))
    # where scaling overflows there is no integer to score by
    return rows.where(F.forall("v", lambda x: F.abs(x) < float("inf"))).distinct().withColumn("key", F.xxhash64("vec_id", "label", "v"))


def rotation(rows: DataFrame, size: int) -> np.ndarray:
    """The leading principal axes, as columns, of the rows with `size` components; size x size sums come to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(-1, size)
            x = x / np.maximum(np.abs(x).max(axis=1, initial=0), 1.0)[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def added(t: pa.Table) -> pa.Table:
        row = np.asarray(t["row"].combine_chunks().flatten()).reshape(-1, size).sum(axis=0)
        return pa.table({"i": t["i"][:1], "row": pa.array([row], pa.list_(pa.float64()))})

    part = map_arrow(rows.where(F.size("v") == size).select("v"), sums, "i long, row array<double>")
    got = part.groupBy("i").applyInArrow(added, "i long, row array<double>").toArrow()
    moments = np.zeros((size, size))
    if got.num_rows:
        moments[np.asarray(got["i"])] = np.asarray(got["row"].combine_chunks().flatten()).reshape(-1, size)
    axes = np.linalg.eigh((moments + moments.T) / 2)[1]
    return np.ascontiguousarray(axes[:, ::-1][:, : STEPS[-1]])


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95),
    scale: int = 256, block: int = ANCHORS, tile: int = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hard negatives of the anchors.

    vectors has vec_id, label, embedding; `anchors` says which rows are anchors, `label` replaces the label, both over these
    columns. Components are floor(scale x); a row's score is its integer inner product with the anchor. Higher scores come
    first, ties by smaller vec_id. Positives are an anchor's first `positives` rows of its label and another vec_id;
    negatives are, for each positive, its first `negatives` rows of other labels whose score is between the two percents
    of the positive's, ends included.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Rows that are repeated
    exactly count once; a vec_id with several vectors is several rows, each an anchor of its own. Vectors of another length
    than the anchor's have no product with it. Scores beyond a long stop at its ends. Other columns are ignored; an empty
    table gives no rows.

    Each block of anchors meets each tile of rows once for positives and once for negatives, so the work is that of anchors
    times rows, in groups of about block and tile rows, of which each gives an anchor no more than it looks for.
    """
    ready(vectors.sparkSession)
    slim = vectors.select("vec_id", (F.col("label") if label is None else label).alias("label"), "embedding")
    rows = materialize(prepared(slim, scale), "negative-rows", rows=F.count("*"))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").take(1)
    axes = {r["size"]: rotation(rows, r["size"]) for r in sizes if r["size"]}
    chosen = materialize(rows.where(anchors), "negative-anchors", rows=F.count("*"))
    blocks, tiles = (max(1, -(-(t.measured["rows"] or 0) // n)) for t, n in ((chosen, block), (rows, tile)))

    whole = chosen.withColumns({"low": F.array(F.lit(LONG_MIN)), "high": F.array(F.lit(LONG_MAX))})
    found = _searched(whole, rows, axes, positives, True, blocks, tiles)
    nearest = materialize(found.select("key", "anchor_id", "rank", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")

    part = lambda k: F.col("positive_score").cast("decimal(19,0)") * F.lit(k).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    window = F.struct("rank", F.ceil(part(percent[0])).cast("long").alias("low"), F.floor(part(percent[1])).cast("long").alias("high"))
    per_anchor = nearest.groupBy("key", "anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", window))).alias("w"))
    ends = lambda c, none: F.array(*[F.coalesce(F.col("w")[k][c], F.lit(none)) for k in range(1, positives + 1)])
    narrowed = chosen.join(per_anchor.withColumnRenamed("anchor_id", "vec_id"), ["key", "vec_id"]).withColumns({"low": ends("low", LONG_MAX), "high": ends("high", LONG_MIN)})
    mined = _searched(narrowed, rows, axes, negatives, False, blocks, tiles)
    out = mined.select("key", "anchor_id", (F.col("window") + 1).alias("of"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(nearest.withColumnRenamed("rank", "of"), ["key", "anchor_id", "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
