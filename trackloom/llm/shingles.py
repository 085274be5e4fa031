"""Exact links of texts alike in 0.8 or more of their distinct five-word shingles (Jaccard), and their components.

Search. First the SimHash covering of simhash.py over the shingles: what it finds is checked on the whole sets. It can't
find all, since texts alike in 0.8 of their shingles differ in more bits than the covering spans. The rest comes from
prefixes: with shingles ordered by the number of texts that hold them, then by hash, two sets of Jaccard 0.8 share a
shingle among the first n - ceil(0.8 n) + 1 of each. Those that no other text holds come first and meet nothing, so a text
takes part only with what of its prefix they leave; most have none left. Equal sets are one node.

Links. In each bucket (texts with a prefix shingle in common) all meet the first and last of it, and the pairs are checked
on their whole sets. Then pairs of a bucket whose ends are not yet in one component are checked too, but for those that
sizes or parity bitmaps rule out: bitmaps that differ in d bits are of sets that differ in d shingles at least. First each
text meets its likeliest mate of each bucket, which joins most of a group of near-copies by pairs in proportion to its
rows; then all pairs are taken whose ends are apart even so. No link between components is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_arrow, texts
from trackloom.functions.spread import hot_least, join_by_key
from trackloom.operators.graph import connected_components
from trackloom.session import discard, materialize

SHINGLE = 5
SEED = 42
#: Shingles that a task counts at once; there are as many groups as the shingles of all texts need.
COUNTED = 1 << 19
#: Shingles that a task sends on at once.
POSTED = 1 << 18
PARITY_BITS = 1024
TILE = 1024
PAIRS_AT_ONCE = 1 << 20
WORDS_KEPT = 1 << 17
#: Up to so many ids are broadcast.
FEW_IDS = 1 << 17


def shingle_set(text: str | None, known: dict[bytes, int], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes (signed) of a text's distinct shingles; fewer words than a shingle are one, no word gives none.

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+. `known` keeps hashes of words between calls.
    """
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    if len(known) > WORDS_KEPT:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def _key(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def _simhash(s: np.ndarray) -> int:
    """The signed SimHash of a set of hashes: a bit is 1 if it is set in over half of them."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(s), 1 << 16):
        votes += np.unpackbits(s[k : k + (1 << 16)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(s), bitorder="little").view("<i8")[0])


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, k (hash of the set), n (its size), bits (parity bitmap) and fp (its SimHash) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            keys, sizes, bits, fps = [], [], [], []
            for t in texts(b):
                s = shingle_set(t, known)
                keys.append(_key(s))
                sizes.append(len(s))
                place = (s.view(np.uint64) >> np.uint64(54)).astype(np.int64)
                bits.append(np.packbits((np.bincount(place, minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes())
                fps.append(_simhash(s))
            cols = [b.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k", "n", "bits", "fp"])

    return map_arrow(docs, run, "doc_id long, k long, n int, bits binary, fp long")


def _pack(group: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (g, data): the columns, cut by group, each column's bytes behind those of the one before."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(group))
    columns = [c[order] for c in columns]
    data = [b"".join(c[x:y].tobytes() for c in columns) for x, y in zip(cuts, ends)]
    yield pa.RecordBatch.from_arrays([pa.array(group[cuts].astype(np.int64)), pa.array(data, pa.binary())], ["g", "data"])


def _unpacked(batches: Iterator[pa.RecordBatch], *types: str) -> Iterator[list[np.ndarray]]:
    """The columns of each group of rows (g, data) that come sorted by g."""
    width, now, held = sum(np.dtype(t).itemsize for t in types), None, []

    def columns() -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in types]
        for raw in held:
            n, at = len(raw) // width, 0
            for part, t in zip(parts, types):
                part.append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
        return [np.concatenate(p) for p in parts]

    for b in batches:
        for g, raw in zip(b.column(0).to_pylist(), b.column(1)):
            if g != now:
                if held:
                    yield columns()
                now, held = g, []
            held.append(raw.as_py())
    if held:
        yield columns()


def _dealt(packed: DataFrame) -> DataFrame:
    return packed.repartition("g").sortWithinPartitions("g")


def _shared(docs: DataFrame, groups: int) -> DataFrame:
    """Rows (b, k, n): the shingles b of each set's prefix that another set holds too. Sets with none are left out.

    Shingles go to groups by their hash, where those of one set alone are dropped and the others counted; these go to
    groups by their set, where the prefix is cut. Both moves are of packed arrays.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        seen, sets, held = set(), [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            n = np.array([len(s) for s, _ in sets], np.uint32)
            h = np.concatenate([s for s, _ in sets])
            return _pack((h.view(np.uint64) >> np.uint64(20)) % np.uint64(groups), h, np.repeat(np.array([k for _, k in sets], np.int64), n), np.repeat(n, n))

        for b in batches:
            for t in texts(b):
                s = shingle_set(t, known)
                k = _key(s)
                if k not in seen:
                    seen.add(k)
                    sets.append((s, k))
                    held += len(s)
                if held > POSTED:
                    yield from packed()
                    seen, sets, held = set(), [], 0
        if sets:
            yield from packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, k, n in _unpacked(batches, "i8", "i8", "u4"):
            order = np.lexsort((k, h))
            h, k, n = h[order], k[order], n[order]
            keep = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])]
            h, k, n = h[keep], k[keep], n[keep]
            new = np.r_[True, h[1:] != h[:-1]]
            held = np.bincount(np.cumsum(new) - 1).astype(np.uint32)[np.cumsum(new) - 1]
            on = held > 1
            if on.any():
                yield from _pack(k[on].view(np.uint64) % np.uint64(groups), h[on], k[on], n[on], held[on])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, k, n, held in _unpacked(batches, "i8", "i8", "u4", "u4"):
            order = np.lexsort((h, held, k))
            h, k, n = h[order], k[order], n[order].astype(np.int64)
            new = np.r_[True, k[1:] != k[:-1]]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
            left = n - (4 * n + 4) // 5 + 1 - (n - many)  # of the prefix, after the shingles of this set alone
            on = np.arange(len(k)) - first < left
            yield pa.RecordBatch.from_arrays([pa.array(h[on]), pa.array(k[on]), pa.array(n[on].astype(np.int32))], ["b", "k", "n"])

    posted = map_arrow(docs.select("text"), post, "g long, data binary")
    counted = map_arrow(_dealt(posted), count, "g long, data binary")
    return map_arrow(_dealt(counted), cut, "b long, k long, n int")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows (b, i, j, k, n, c, bits) sorted by (b, i, j) as columns of whole groups. A batch's last group waits for the next batch."""
    kept = [np.zeros(0, np.int64)] * 6 + [np.zeros((0, PARITY_BITS // 64), np.uint64)]
    for batch in batches:
        cols = [batch.column(x).to_numpy().astype(np.int64) for x in range(6)]
        cols.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64))
        cols = [np.concatenate([a, b]) for a, b in zip(kept, cols)]
        if not len(cols[0]):
            continue
        tail = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = tail[-1] + 1 if len(tail) else 0
        if cut:
            yield [c[:cut] for c in cols]
        kept = [c[cut:] for c in cols]
    if len(kept[0]):
        yield kept


def _maybe(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places x < y of rows of one group, in different components, that may be alike, and the bits they differ in; no place comes twice as x, or as y, at once."""
    b, i, j, _, n, c, bits = cols
    new = np.r_[True, (b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    last = np.append(np.flatnonzero(new)[1:], len(b))[np.cumsum(new) - 1]  # end of each row's group
    at, lag = np.arange(len(b)), 1
    while True:
        at = at[at + lag < last[at]]
        if not len(at):
            return
        to = at + lag
        ok = (c[at] != c[to]) & (5 * np.minimum(n[at], n[to]) >= 4 * np.maximum(n[at], n[to]))
        x, y = at[ok], to[ok]
        d = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
        ok = 9 * d <= n[x] + n[y]
        if ok.any():
            yield x[ok], y[ok], d[ok]
        lag += 1


def _emitted(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["u", "v"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as of _grouped() to all pairs (u < v) of a group in different components that may be alike. A group holds two tiles at most."""
    for cols in _grouped(batches):
        k, found, count = cols[3], [], 0
        for x, y, _ in _maybe(cols):
            found.append((k[x], k[y]))
            count += len(x)
            if count > PAIRS_AT_ONCE:
                yield _emitted(*map(np.concatenate, zip(*found)))
                found, count = [], 0
        if found:
            yield _emitted(*map(np.concatenate, zip(*found)))


def _mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of _pairs(), those of each row with its likeliest mate, that whose bits differ least: a row a row at most."""
    for cols in _grouped(batches):
        k = cols[3]
        least, mate = np.full(len(k), PARITY_BITS + 1), np.full(len(k), -1)
        for x, y, d in _maybe(cols):
            for one, other in ((x, y), (y, x)):
                less = d < least[one]
                least[one[less]], mate[one[less]] = d[less], other[less]
        has = np.flatnonzero(mate >= 0)
        if len(has):
            yield _emitted(k[has], k[mate[has]])


def _apart(shared: DataFrame, reps: DataFrame, roots: DataFrame, tile: int, find: Callable) -> DataFrame:
    """Distinct pairs (u, v) of the buckets whose ends are in different components and that sizes and bitmaps leave open: those that `find` takes."""
    labelled = shared.join(roots, shared["k"] == roots["node"], "left").select("b", "k", "n", F.coalesce("component", "k").alias("c"))
    mixed = labelled.groupBy("b").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows")).where("low <> high")
    tiles = mixed.select("b", F.ceil(F.col("rows") / tile).cast("int").alias("tiles"))
    rows = labelled.join(tiles, "b").join(reps.select("k", "bits"), "k")
    own = F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int")
    dealt = (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "k", "n", "c", "bits")
    )
    return map_arrow(dealt.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j"), find, "u long, v long").distinct()


def _open(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (u, v) that sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64) for c in (3, 4))
            ok = 9 * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(b.column(c).to_numpy()[ok]) for c in range(2)], ["u", "v"])

    x, y = (reps.select(F.col("k").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in "uv")
    both = pairs.join(x, "u").join(y, "v").select("u", "v", (F.col("u_n") + F.col("v_n")).alias("n"), "u_bits", "v_bits")
    return map_arrow(both, run, "u long, v long")


def _whole(docs: DataFrame, reps: DataFrame, pairs: DataFrame, repeated: bool) -> DataFrame:
    """k, doc and the whole set of the ends of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            sets = [shingle_set(t, known) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["k", "doc", "s"])

    ends = pairs.select(F.explode(F.array("u", "v")).alias("k")).distinct()
    ids = materialize(reps.select("k", F.col("rep").alias("doc_id")).join(ends, "k", "left_semi").select("doc_id").distinct(), "shingle-ends")
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)  # spares the texts a shuffle
    out = map_arrow(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), run, "k long, doc long, s array<long>")
    return materialize(out.dropDuplicates(["k"]) if repeated else out, "shingle-whole")


def _checked(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs whose sets have Jaccard 0.8 or more: common / (all - common) >= 4 / 5, in whole numbers."""
    a = whole.select(F.col("k").alias("u"), F.col("doc").alias("u_doc"), F.col("s").alias("a"))
    b = whole.select(F.col("k").alias("v"), F.col("doc").alias("v_doc"), F.col("s").alias("b"))
    alike = 9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))
    return pairs.join(a, "u").join(b, "v").where(alike).select("u", "v", "u_doc", "v_doc")


def _by_simhash(reps: DataFrame, similar: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (u, v) of sets whose SimHashes the covering joins: each set with the least of its SimHash, and these along the covering's edges."""
    heads = materialize(reps.groupBy("fp").agg(F.min("k").alias("head"), F.count("*").alias("sets")), "shingle-heads", rows=F.sum("sets"))
    edges = similar(heads.select("fp"))
    a, b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in "uv")
    across = edges.join(a, "u").join(b, "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    same = join_by_key(reps.select("fp", "k"), heads, "fp", hot_least(heads.measured["rows"] or 0), "sets").where("k <> head").select(F.col("head").alias("u"), F.col("k").alias("v"))
    return across.unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def near_copies(docs: DataFrame, tile: int = TILE, similar: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id and component_id (least doc_id reachable over links) of the documents that are linked to another.

    Two link if their sets of five-word shingles have Jaccard 0.8 or more; null and wordless texts have equal, empty sets.
    `similar` gives edges of alike SimHashes (column fp), checked first; without it the prefixes alone are searched, with
    the same result. Rows with a null doc_id are left out.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sets = materialize(_sets(slim), "shingle-sets", rows=F.count("*"), shingles=F.sum("n"))
    rows, groups = sets.measured["rows"], max(1, -(-(sets.measured["shingles"] or 0) // COUNTED))
    reps = materialize(sets.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "bits", "fp"))), "shingle-reps")
    same = join_by_key(sets.select("doc_id", "k"), reps.select("k", "rep", "copies"), "k", hot_least(rows), "copies").where("doc_id > rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    same = materialize(same, "shingle-same")
    repeated = bool(sets.groupBy("doc_id").count().where("count > 1").take(1))
    discard(sets)

    shared = materialize(_shared(slim, groups), "shingle-buckets", tidy=True, rows=F.count("*"))
    ends = shared.groupBy("b").agg(F.min(F.struct("k", "n")).alias("low"), F.max(F.struct("k", "n")).alias("high"), F.count("*").alias("rows"))
    meets = join_by_key(shared, ends, "b", hot_least(shared.measured["rows"]), "rows").select("k", "n", F.explode(F.array("low", "high")).alias("end")).where("k <> end.k and 5 * least(n, end.n) >= 4 * greatest(n, end.n)")
    first = meets.select(F.least("k", "end.k").alias("u"), F.greatest("k", "end.k").alias("v"))
    if similar is not None:
        first = first.unionByName(_by_simhash(reps, similar))
    first = materialize(_open(first.distinct(), reps), "shingle-first")
    whole = _whole(slim, reps, first, repeated)
    linked = materialize(_checked(first, whole), "shingle-linked")
    discard(whole)

    tried, links = [first], [linked]
    for find in (_mates, _pairs):
        met, found = (reduce(DataFrame.unionByName, x) for x in (tried, links))
        roots = connected_components(found.select("u", "v"))
        left = materialize(_apart(shared, reps, roots, tile, find).join(met, ["u", "v"], "left_anti"), "shingle-left")
        whole = _whole(slim, reps, left, repeated)
        links.append(materialize(_checked(left, whole), "shingle-linked"))
        tried.append(left)
        discard(whole)
    for done in (shared, *tried):
        discard(done)
    edges = reduce(DataFrame.unionByName, links).select(F.col("u_doc").alias("u"), F.col("v_doc").alias("v")).unionByName(same)
    out = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    for done in (reps, same, *links):
        discard(done)
    return out
