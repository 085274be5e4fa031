"""SimHash fingerprints and their near-duplicate groups by anchor-point covering.

Covering code. The 64 bits are cut into three blocks of 22, 21 and 21 bits. Two fingerprints that differ in at most
four bits differ in at most one bit of some block. In a block the anchors are the words whose first 15 bits are a
codeword of the perfect [15,11] Hamming code and whose other bits are free: a code of covering radius 1. A fingerprint
goes to every anchor within 1 + 1 bits of its block, so two that differ in one bit of the block meet at the anchor
nearest to either of them. That is about 45 copies of an 8-byte fingerprint and, per block, 2**18 or 2**17 anchors.
Each anchor's fingerprints are compared over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import shingles
from trackloom.llm.common import free_name, map_arrow, min_labels, texts
from trackloom.functions.spread import hot_least, join_by_key
from trackloom.operators.graph import connected_components
from trackloom.session import discard, materialize

THRESHOLD = 4
SHINGLE = 4
SEED = 42
BLOCKS = ((0, 22), (22, 21), (43, 21))
CODE_BITS = 15
TILE = 4096
LINKS_AT_ONCE = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is 1 if it is set in over half of the shingles' XXH64.

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+, shingles repeat; fewer words than a shingle count as one, no word gives 0.
    """
    if text is None:
        return 0
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    votes, n, step = np.zeros(64, np.int64), len(starts), 1 << 16
    ends = ends[shingle - 1 :].tolist()
    for k in range(0, n, step):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + step], ends[k : k + step])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {_type(docs, 'doc_id')}, fp long")


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


@lru_cache(1)
def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: the codewords within 2 bits as a padded table, and their distance (9 where there is none)."""
    n = 1 << CODE_BITS
    syndrome = np.zeros(n, np.int64)
    for i in range(CODE_BITS):
        syndrome[(np.arange(n) >> i) & 1 == 1] ^= i + 1
    moves = [0, *(1 << i for i in range(CODE_BITS)), *((1 << i) | (1 << j) for i, j in combinations(range(CODE_BITS), 2))]
    words, distance = np.zeros((n, 8), np.int64), np.full((n, 8), 9, np.int64)
    filled = np.zeros(n, np.int64)
    for m in moves:
        hit = np.flatnonzero(syndrome[np.arange(n) ^ m] == 0)
        words[hit, filled[hit]], distance[hit, filled[hit]] = hit ^ m, bin(m).count("1")
        filled[hit] += 1
    return words, distance


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints (uint64): index into fp, and key of every anchor within radius 1 plus 1 bit, over the three blocks."""
    words, distance = _hamming()
    index, keys = [], []
    for k, (low, width) in enumerate(BLOCKS):
        block = ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        code, free, spare = block & ((1 << CODE_BITS) - 1), block >> CODE_BITS, width - CODE_BITS
        near, far = words[code], distance[code]
        flips = [0, *(1 << i for i in range(spare)), *((1 << i) | (1 << j) for i, j in combinations(range(spare), 2))]
        for f in flips:
            rows, cols = np.nonzero(far <= 2 - bin(f).count("1"))
            index.append(rows)
            keys.append((np.int64(k) << 40) | ((free[rows] ^ f) << CODE_BITS) | near[rows, cols])
    return np.concatenate(index), np.concatenate(keys)


def _spread(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            i, key = anchors_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i])], ["anchor", "fp"])

    return map_arrow(distinct.select("fp"), run, "anchor long, fp long")


def _links(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, i, j, side, fp) sorted by (anchor, i, j) to star edges of the links found in each group.

    A group holds two tiles at most. A batch's last group waits for the next batch.
    """
    kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 5

    def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, i, j, side, fp = cols
        if len(fp) < 2:
            return
        bits = fp.view(np.uint64)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        group = np.cumsum(new)
        last = np.append(np.flatnonzero(new)[1:], len(fp))[group - 1]  # end of each row's group
        at, lag, found, n = np.arange(len(fp)), 1, [], 0
        while True:
            at = at[at + lag < last[at]]
            if not len(at):
                break
            near = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= threshold]
            if len(near):
                found.append((fp[near], fp[near + lag]))
                n += len(near)
                if n > LINKS_AT_ONCE:
                    found = [min_labels(*map(np.concatenate, zip(*found)))]
                    n = len(found[0][0])
            lag += 1
        if found:
            u, v = min_labels(*map(np.concatenate, zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        cols = [np.concatenate([k, b.column(c).to_numpy(zero_copy_only=False)]) for c, k in enumerate(kept)]
        if not len(cols[0]):
            continue
        tail = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = tail[-1] + 1 if len(tail) else 0
        yield from solve([c[:cut] for c in cols])
        kept = [c[cut:] for c in cols]
    yield from solve(kept)


def similar_fingerprints(distinct: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Star edges (u, v) that connect just the fingerprints (column fp, distinct longs) linked at `threshold` or fewer differing bits.

    An anchor with more than `tile` fingerprints is cut into tiles, and each pair of its tiles is a group of its own.
    So no group exceeds two tiles, and a group emits at most one edge for each of its rows.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the covering is built for thresholds up to {THRESHOLD}")
    spread = _spread(distinct)
    crowded = spread.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    # anchors below the tile size need no tiles: the sizes table holds crowded ones only
    sized = spread.join(crowded, "anchor", "left").withColumn("tiles", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = (
        sized.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.lit(0).alias("side"), "fp")
    )
    grouped = pairs.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")
    return map_arrow(grouped, lambda it: _links(it, threshold), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links) of every row of docs.

    Fingerprints link at `threshold` or fewer differing bits; equal ones are one node, so copies are never paired up.
    Null, empty and wordless texts share fingerprint zero and link like any other. Rows with a null doc_id are kept, and
    take the least non-null doc_id of their component, null if there is none. Ids of other types than long are ordered
    as their type is. Repeated rows each give a row. Other columns are ignored; an empty table gives no rows.

    The covering has 2**17 to 2**18 anchors a block, so beyond about 1e8 distinct fingerprints an anchor holds more than
    a tile; its tiles are then compared pair by pair, which loses nothing but grows with the square.
    """
    fps = materialize(fingerprints(docs, shingle), "simhash-fps", rows=F.count("*"))
    rows = fps.measured["rows"]
    first = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-first")
    edges = materialize(similar_fingerprints(first, threshold), "simhash-edges")
    roots = connected_components(edges)
    discard(edges)
    labelled = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    by_fp = join_by_key(labelled, least, "component", hot_least(rows), "members").select("fp", "component_id", "n")
    # a fingerprint of very many texts, such as that of null and wordless ones, meets its row by broadcast
    return join_by_key(fps, by_fp, "fp", hot_least(rows)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of the documents that have a near-copy: texts alike in 0.8 or more of their five-word shingles.

    The covering finds candidates by the SimHash of the five-word shingles, which are checked on the whole sets. At that
    likeness few SimHashes are within four bits: changing one word changes five shingles. So shingles.py searches on, and
    no pair of 0.8 is missed. component_id is the least doc_id reachable. Rows with a null doc_id are left out.
    """
    return shingles.near_copies(docs, similar=similar_fingerprints)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first (least doc_id) of their group of near_copies(); all columns are kept.

    Rows with a null doc_id cannot be named and are kept. Repeated rows of a kept doc_id are all kept.
    """
    key = free_name(docs, "_gone")
    gone = near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(key))
    marked = docs.where("doc_id is not null")
    kept = marked.join(gone, marked["doc_id"].cast("long") == gone[key], "left_anti")
    return kept.unionByName(docs.where("doc_id is null"))
