"""Document fingerprints from prefix polynomial hashes: span equality, longest common extensions, likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_arrow, ready

#: A prime of the form 2**31 - 1, so that reduction is a shift and an addition.
PRIME = np.uint64((1 << 31) - 1)
BASES = (1_103_515_245, 1_664_525_013)
SPAN = 16
SKETCH = 64
ROWS_A_BUCKET = 4000
#: Ranges at most, and rows drawn for each to find the cuts.
MOST_BUCKETS, SAMPLED = 100_000, 20
_SHIFT = np.uint64(31)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> _SHIFT)
    x = (x & PRIME) + (x >> _SHIFT)
    return np.where(x >= PRIME, x - PRIME, x)


class _Powers:
    """Powers of a base modulo PRIME, grown by doubling as far as the longest text needs."""

    def __init__(self, base: int):
        self.base, self.table = base, np.array([1, base], np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) <= n:
            top = np.uint64(pow(self.base, len(self.table), int(PRIME)))
            self.table = np.concatenate([self.table, _mod(self.table * top)])
        return self.table


_POWERS = [_Powers(b) for b in BASES]
_INVERSE = _Powers(pow(BASES[0], -1, int(PRIME)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Prefixes:
    """The prefix hashes of a text under both bases: any span's hash is a difference of two entries."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        value = codes.astype(np.uint64) + np.uint64(1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), _mod(np.cumsum(_mod(value * p.upto(self.n)[: self.n])))]) for p in _POWERS]

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether the spans of `length` at i here and at j there are equal, but for a chance of about 2**-60."""
        if length <= 0:
            return True
        for s, o, p in zip(self.sums, other.sums, _POWERS):
            t, m = p.upto(max(i, j)), int(PRIME)
            if (int(s[i + length]) - int(s[i])) * int(t[j]) % m != (int(o[j + length]) - int(o[j])) * int(t[i]) % m:
                return False
        return True

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of i here and j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def whole(self) -> tuple[int, int]:
        return tuple(int(s[-1]) for s in self.sums)

    def spans(self, width: int = SPAN) -> np.ndarray:
        """A 32-bit mark of each span of `width` code points that doesn't depend on where it stands; of the whole text if that is shorter."""
        s, m = self.sums[0], self.n - width + 1
        if self.n == 0:
            return np.zeros(0, np.uint64)
        if m < 1:
            return (s[-1:] * _SPREAD) >> np.uint64(32)
        d = s[width:] + (PRIME - s[:m])
        return (_mod(_mod(d) * _INVERSE.upto(m)[:m]) * _SPREAD) >> np.uint64(32)


def spliced(head: Prefixes, m: int, tail: Prefixes, q: int) -> tuple[int, int]:
    """Whole hashes of the first m code points of one text followed by the first q of another, without reading either."""
    return tuple((int(h[m]) + int(p.upto(m)[m]) * int(t[q])) % int(PRIME) for h, t, p in zip(head.sums, tail.sums, _POWERS))


def sketch(marks: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The least `size` distinct marks."""
    if len(marks) > 16 * size:
        few = np.unique(marks[marks < np.uint64((1 << 32) * 4 * size // len(marks))])
        if len(few) >= size:
            return few[:size]
    return np.unique(marks)[:size]


def written(n: int, whole: tuple[int, int], marks: np.ndarray) -> str:
    return f"{n:x}.{whole[0]:08x}{whole[1]:08x}." + marks.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of common spans among all spans of two texts, from their sketches; two empty ones are alike."""
    both = np.unique(np.concatenate([a, b]))[:size]
    return float((np.isin(both, a) & np.isin(both, b)).sum() / len(both)) if len(both) else 1.0


def fingerprint(text: str | None) -> str:
    """Length, whole hash and sketch of a text; equal texts have equal fingerprints. A null text counts as empty."""
    p = Prefixes(code_points(text or ""))
    return written(p.n, p.whole(), sketch(p.spans()))


def likeness_of(a: str, b: str) -> float:
    return 1.0 if a == b else likeness(*(np.frombuffer(bytes.fromhex(x.rpartition(".")[2]), ">u4") for x in (a, b)))


class _Row:
    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.p = Prefixes(code_points(self.text))
        self.marks = self.p.spans()
        self.sketch = sketch(self.marks)

    def against(self, after: _Row) -> tuple:
        """The result row, given the next document."""
        n = self.p.n
        q = min(n // 4, after.p.n)
        m = n - n // 4
        edited = self.text[:m] + after.text[:q]
        own = written(n, self.p.whole(), self.sketch)
        if edited == self.text:
            other, near = own, 1.0
        else:
            # spans inside the kept part are known; those that reach the new part are hashed anew
            cut = max(0, m - SPAN + 1)
            new = Prefixes(code_points(edited[cut:])).spans()
            marks = np.concatenate([self.marks[:cut], new]) if cut and len(edited) >= SPAN else Prefixes(code_points(edited)).spans()
            least = sketch(marks)
            other, near = written(m + q, spliced(self.p, m, after.p, q), least), likeness(self.sketch, least)
        return (
            self.doc_id, n, hashlib.sha256(edited.encode("utf-8")).hexdigest(), own, other, near,
            likeness(self.sketch, after.sketch), self.p.extension(0, after.p, 0),
        )


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "prefix_shared_with_next"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket in order, then the first row of the next one as a ghost: each meets its successor."""
    held: _Row | None = None
    done = False
    for b in batches:
        out = []
        ghosts = b.column(2).to_pylist()
        for k in range(b.num_rows):
            if done:
                break
            row = _Row(b.column(0)[k].as_py(), b.column(1)[k].as_py())
            if held is not None:
                out.append(held.against(row))
            held, done = row, bool(ghosts[k])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], NAMES)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]


def _place(cuts: np.ndarray) -> Callable:
    """A pandas UDF: the number of cuts (key, hash), sorted, at or below each row's pair."""
    keys, hashes = cuts[:, 0], cuts[:, 1]

    @F.pandas_udf("int")
    def place(key: pd.Series, mark: pd.Series) -> pd.Series:
        k, h = key.to_numpy(np.int64), mark.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for i in np.flatnonzero(low < high):  # rows whose id is a cut's id: their hashes decide
            low[i] += np.searchsorted(hashes[low[i] : high[i]], h[i], "right")
        return pd.Series(low.astype(np.int32))

    return place


def _cuts(keyed: DataFrame, rows: int, buckets: int) -> np.ndarray:
    """At most buckets - 1 pairs (key, hash) that part the rows evenly, from a sample of about SAMPLED rows a bucket, drawn by hash."""
    if buckets < 2:
        return np.zeros((0, 2), np.int64)
    rate = max(1, rows // (buckets * SAMPLED))
    some = keyed.where(F.pmod(F.xxhash64("_k", "_h", F.lit("cuts")), F.lit(rate)) == 0).select("_k", "_h").distinct().orderBy("_k", "_h").collect()
    pairs = np.array([tuple(r) for r in some], np.int64).reshape(-1, 2)
    return pairs[SAMPLED - 1 :: SAMPLED]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ghost) dealt into ranges of (doc_id, hash of the text), one a partition, in order, each followed by its successor's first row.

    The cuts come from a sample of ids, at most MOST_BUCKETS * SAMPLED pairs of longs, and each range is found by binary
    search; the texts move once. Rows of one doc_id are spread over ranges by their texts' hashes.
    """
    ready(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    n = docs.count()
    buckets = int(min(MOST_BUCKETS, max(1, n // ROWS_A_BUCKET)))
    cuts = _cuts(slim, n, buckets)
    placed = slim.withColumn("_b", _place(cuts)("_k", "_h") if len(cuts) else F.lit(0))
    firsts = [(r["_b"], *r["k"]) for r in placed.groupBy("_b").agg(F.min(F.struct("_k", "_h")).alias("k")).orderBy("_b").collect()]
    # the first row of each range goes to the range before it as well; the very first one to the last range
    ghosts = docs.sparkSession.createDataFrame([(k, h, firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)], "_first long, _hash long, _to int")
    both = placed.join(F.broadcast(ghosts), (placed["_k"] == ghosts["_first"]) & (placed["_h"] == ghosts["_hash"]), "left")
    own = F.struct(F.col("_b").cast("int").alias("b"), F.lit(0).alias("g"))
    ghost = F.struct(F.col("_to").alias("b"), F.lit(1).alias("g"))
    dealt = both.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    dealt = dealt.select("doc_id", "text", F.col("_at.g").alias("ghost"), F.col("_at.b").alias("_b"), "_k", "_h")
    return dealt.repartitionById(len(cuts) + 1, F.col("_b")).sortWithinPartitions("ghost", "_k", "_h", "text").select("doc_id", "text", "ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next row's
    text, rows standing in the order of doc_id; after the last comes the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, prefix_shared_with_next (code points, by binary search over
    the prefix hashes). Null texts count as empty; an empty text is like an empty text only. Null doc_ids stand before all
    others, rows of one doc_id in the order of their texts' hashes, so that a doc_id of many rows is many ranges; rows
    equal in id and text share one. Other columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_shared_with_next long"
    return map_arrow(with_next(docs), _stream, schema)
