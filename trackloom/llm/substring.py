"""Repeated-passage removal with a log-structured index of window fingerprints.

Every window of 50 words holds 35 runs of 16 words; the least 64-bit fingerprint among these runs stands for the window.
Equal windows have equal least runs, so two documents share a window only if they share such a fingerprint. The index
holds each document's distinct least fingerprints in immutable runs sorted by fingerprint. A new batch is merge-joined
with the runs; what meets is verified on whole windows with 128-bit hashes of the texts themselves, which are kept as
sorted runs too, so that a text is read again only when one of its fingerprints is shared for the first time. The batch
is then written as a new run, and runs are compacted into one when there are too many. An index stays in its folder and
is opened again for the next batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import free_name, map_arrow, texts, word_list
from trackloom.functions.spread import attach, hot_least, join_by_key
from trackloom.session import discard, fresh_path, materialize, remove

WINDOW = 50
RUN_WORDS = 16
#: Runs of a kind before they are merged, and batches that a whole table is taken in by.
MAX_RUNS, BATCHES = 1, 3
#: Up to so many ids are broadcast.
FEW_IDS = 1 << 17
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _roll(a: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each run of `width` values, by doubling."""
    n = len(a) - width + 1
    out, have, power, size, step = None, 0, a, 1, base
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:  # append the block of `size` values that starts after those already taken
                out = power[have : have + n] if out is None else out * step + power[have : have + n]
                have += size
            left >>= 1
            if left:
                power, step = power[:-size] * step + power[size:], step * step
                size *= 2
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _slide_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def least_runs(hashes: np.ndarray, window: int = WINDOW, run: int = RUN_WORDS) -> np.ndarray:
    """For each window its least run fingerprint (int64); empty where there are fewer words than a window."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    return _slide_min(_mix(_roll(hashes, run, _BASES[0])), window - run + 1).view(np.int64)


def window_digests(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each window."""
    return _mix(_roll(hashes, window, _BASES[0])).view(np.int64), _mix(_roll(_mix(hashes + _BASES[1]), window, _BASES[1])).view(np.int64)


def sketch(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, version, digest, n_words, kept_sha256 of all words, and the distinct least runs (marks) of the document's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, marks = [], [], []
            for t in texts(b):
                words = word_list(t)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                marks.append(np.unique(least_runs(word_hashes(words), window)) if len(words) >= window else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(sha), pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "version", "digest", "n_words", "kept_sha256", "marks"])

    return map_arrow(docs.select("doc_id", "version", "text", F.md5(F.col("text").cast("binary")).alias("digest")), run, "doc_id long, version long, digest string, n_words long, kept_sha256 string, marks array<long>")


class WindowIndex:
    """A log-structured index in a shared folder: immutable sorted runs, and manifests that name the live ones.

    Two kinds of runs hold the history: `marks` (mark, doc_id, version), the least-run fingerprints of every document, and
    `windows` (a, b, first), the hashes of the windows that were verified so far with the least doc_id that holds each. A
    manifest is written after the runs it names, so an index whose writer died opens as it was before. WindowIndex(spark,
    path) opens what is there. Beyond max_runs runs of a kind, they are merged into one.
    """

    SCHEMAS = {"marks": "mark long, doc_id long, version long", "windows": "a long, b long, first long"}

    def __init__(self, spark, path: str | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.path, self.max_runs, self.compactions = spark, path or fresh_path(spark, "window-index"), max_runs, 0
        self.runs: dict[str, list[str]] = {kind: [] for kind in self.SCHEMAS}
        self.version = self._newest()
        if self.version:
            for r in spark.read.schema("kind string, run string").parquet(f"{self.path}/manifest-{self.version:06d}").orderBy("run").collect():
                self.runs[r["kind"]].append(r["run"])

    def _newest(self) -> int:
        """The number of the newest whole manifest, 0 where there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return max((int(str(f.getPath().getParent().getName())[-6:]) for f in found or []), default=0)

    def read(self, kind: str = "marks") -> DataFrame | None:
        runs = self.runs[kind]
        return self.spark.read.schema(self.SCHEMAS[kind]).parquet(*[f"{self.path}/{r}" for r in runs]) if runs else None

    def append(self, marks: DataFrame, windows: DataFrame) -> None:
        """Take a batch in: a run of either kind, then the manifest; then compaction where runs are too many."""
        self.version += 1
        for kind, df in (("marks", marks), ("windows", windows)):
            self.runs[kind] = [*self.runs[kind], self._write(kind, df)]
        self._publish()
        if any(len(r) > self.max_runs for r in self.runs.values()):
            self.compact()

    def compact(self) -> None:
        """Merge the runs of each kind into one. Old runs and manifests go only once the new manifest is whole."""
        old, self.version = self.runs, self.version + 1
        self.runs = {"marks": [self._write("marks", self.read())]}
        windows = self.spark.read.schema(self.SCHEMAS["windows"]).parquet(*[f"{self.path}/{r}" for r in old["windows"]])
        self.runs["windows"] = [self._write("windows", windows.groupBy("a", "b").agg(F.min("first").alias("first")))]
        self._publish()
        self.compactions += 1
        for run in (*old["marks"], *old["windows"], *(f"manifest-{v:06d}" for v in range(1, self.version))):
            remove(self.spark, f"{self.path}/{run}")

    def drop(self) -> None:
        remove(self.spark, self.path)
        self.runs = {kind: [] for kind in self.SCHEMAS}

    def _write(self, kind: str, df: DataFrame) -> str:
        run, cols = f"{kind}-{self.version:06d}", [c.split()[0] for c in self.SCHEMAS[kind].split(", ")]
        df.select(*cols).repartitionByRange(*cols[:2]).sortWithinPartitions(*cols).write.mode("overwrite").parquet(f"{self.path}/{run}")
        return run

    def _publish(self) -> None:
        rows = [(kind, run) for kind, runs in self.runs.items() for run in runs]
        self.spark.createDataFrame(rows, "kind string, run string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{self.version:06d}")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """The windows of each text that stand under one of the document's contested marks: doc_id, version, at, a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(3)
            for k, t in enumerate(texts(batch)):
                h = word_hashes(word_list(t))
                if len(h) < window:
                    continue
                low = least_runs(h, window)
                at = np.flatnonzero(np.isin(low, marks[k].values.to_numpy(zero_copy_only=False)))
                a, b = window_digests(h, window)
                ids = [pa.array(np.full(len(at), batch.column(c)[k].as_py(), np.int64)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(at, pa.int32()), pa.array(a[at]), pa.array(b[at])], ["doc_id", "version", "at", "a", "b"])

    return map_arrow(docs.select("doc_id", "version", "text", "marks"), run, "doc_id long, version long, at int, a long, b long")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, version, n_removed, kept_sha256, text (the kept words) of texts with the start words of their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, sha, kept = [], [], []
            starts = batch.column(3)
            for k, t in enumerate(texts(batch)):
                words = word_list(t)
                steps = np.zeros(len(words) + 1, np.int64)
                at = starts[k].values.to_numpy(zero_copy_only=False)
                np.add.at(steps, at, 1)
                np.add.at(steps, at + window, -1)
                keep = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
                text = b" ".join([words[i] for i in keep.tolist()])
                gone.append(len(words) - len(keep))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["doc_id", "version", "n_removed", "kept_sha256", "text"])

    return map_arrow(docs.select("doc_id", "version", "text", "starts"), run, "doc_id long, version long, n_removed long, kept_sha256 string, text string")


def _repeats(index: WindowIndex, batch: DataFrame, own: DataFrame, history: DataFrame, window: int, keep: bool = True) -> DataFrame:
    """doc_id, version and start words of the windows in `batch` (doc_id, version, marks) that also start in a document with a smaller id.

    `own` and `history` hold the texts (doc_id, version, text) of the batch and of what is in the index. The index takes
    the batch in, unless keep is False: a last batch that nothing will be compared with is not written.
    """
    key = ["doc_id", "version"]
    by_doc = lambda df: df.groupBy(*key).agg(F.collect_list("mark").alias("marks"))
    new = batch.select("doc_id", "version", F.explode("marks").alias("mark"))
    past, hashes = index.read("marks"), index.read("windows")
    # a mark is contested if two documents hold it, one of them new: any other window cannot repeat
    held = new.groupBy("mark").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    asked = None
    if past is not None:
        old = past.groupBy("mark").agg(F.min("doc_id").alias("old"), F.max("doc_id").alias("old_hi"))
        held = held.join(old.hint("merge"), "mark", "left").withColumn("lo", F.least("lo", "old")).withColumn("hi", F.greatest("hi", "old_hi"))
        # where two old documents held a mark, the index has its windows; else the old document's text is read
        unread = held.where("lo < hi and old = old_hi").select("mark")
        asked = past.join(unread.hint("merge"), "mark", "left_semi")
    contested = held.where("lo < hi").select("mark")
    fresh = materialize(by_doc(new.join(contested.hint("merge"), "mark", "left_semi")), "contested")
    windows = _windows(own.join(fresh, key), window)
    if asked is not None:
        asked = materialize(by_doc(asked), "contested-before", rows=F.count("*"))
        some = history.join(F.broadcast(asked.select(*key)), key, "left_semi") if asked.measured["rows"] <= FEW_IDS else history
        windows = windows.unionByName(_windows(some.join(asked, key), window))
    windows = materialize(windows, "windows")
    # written, so that the joins below have shuffles of their own on either side, which AQE can split where a window is common
    seen = materialize(windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "seen-windows", rows=F.sum("n"))
    first = seen
    if hashes is not None:
        before = hashes.groupBy("a", "b").agg(F.min("first").alias("before"))
        first = seen.join(before.hint("merge"), ["a", "b"], "left").withColumn("first", F.least("first", "before"))
    first = materialize(first.where("first < last").select("a", "b", "first", "n"), "first-windows")
    least = hot_least(seen.measured["rows"] or 0)
    inside = batch.select("doc_id").distinct()
    again = join_by_key(windows, first, ["a", "b"], least).where("doc_id > first").groupBy("doc_id", "version").agg(F.collect_list("at").alias("starts"))
    out = materialize(again.join(inside, "doc_id", "left_semi"), "repeats")
    if keep:
        index.append(new, seen)
    for done in (windows, seen, first, fresh, asked):
        if done is not None:
            discard(done)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """Removes every word covered by a window that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256; keep_texts() gives the texts themselves.
    Documents are taken into a fresh index in `batches` ranges of ascending doc_id, so each meets the ranges before it.
    doc_ids are longs (others are cast; one that isn't a number fails under ANSI rules).
    Whole copies of a text are settled by their digest: with a window or more, all words of all but the first go.
    Windows are judged on the input. Null and empty texts have no words; texts shorter than a window lose nothing. Rows
    with a null doc_id come back whole and remove nothing, as ids don't order them. Rows of one doc_id don't remove each
    other's words. Other columns are ignored; an empty table gives no rows.
    """
    return _run(docs, window, batches)[0]


def keep_texts(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """docs with each changed text replaced by its kept words joined by one space; rows that lose all words go. All columns stay.

    Unchanged rows keep their text as it is, null, empty and wordless ones too.
    """
    report, cut = _run(docs, window, batches, version=True)
    key, kept, gone = free_name(docs, "_key"), free_name(docs, "_kept"), free_name(docs, "_gone")
    name = F.concat_ws(":", F.col("doc_id").cast("long"), F.col("version"))
    # copies lose everything; of the rest, those in cut have a new text
    out = report.where("n_removed = n_words and n_words > 0").select(name.alias(key)).distinct().select(key, F.lit(None).cast("string").alias(kept), F.lit(True).alias(gone))
    new = cut.where("text <> ''").select(name.alias(key), F.col("text").alias(kept), F.lit(False).alias(gone))
    changed = out.unionByName(new).withColumn("n", F.lit(1))
    marked = docs.withColumn(key, F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.concat_ws(":", F.col("doc_id").cast("long"), _version())))
    left = attach(marked, changed, key, 1).where(~F.coalesce(gone, F.lit(False)))
    return left.withColumn("text", F.coalesce(kept, "text")).select(*docs.columns)


def _version():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _slim(docs: DataFrame) -> DataFrame:
    # doc_id and version name a text even where a doc_id is repeated with another one
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version().alias("version"), "text")


def _sketched(slim: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketch of every row; the first doc_id of each text of a window or more, with its rows (n); and the first rows themselves with their marks."""
    every = materialize(sketch(slim, window), "sketch", rows=F.count("*"))
    copies = materialize(every.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "copies")
    # the first row of each text stands for all its copies
    firsts = copies.where("first is not null").select("digest", "first", "n")
    lone = join_by_key(every.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()), firsts, "digest", hot_least(every.measured["rows"])).where("doc_id = first")
    return every, copies, materialize(lone.select("doc_id", "version", "marks").dropDuplicates(["doc_id", "version"]), "lone")


def _run(docs: DataFrame, window: int, batches: int, version: bool = False) -> tuple[DataFrame, DataFrame]:
    slim = _slim(docs)
    every, copies, lone = _sketched(slim, window)
    cuts = [None, *_bounds(lone, batches), None]
    index, parts = WindowIndex(docs.sparkSession), []
    for lo, hi in zip(cuts, cuts[1:]):
        here = F.lit(True) if lo is None else F.col("doc_id") >= lo
        upto = F.lit(True) if hi is None else F.col("doc_id") < hi
        earlier = slim.where("false" if lo is None else F.col("doc_id") < lo)
        parts.append(_repeats(index, lone.where(here & upto), slim.where(here & upto), earlier, window, keep=hi is not None))
    index.drop()
    discard(lone)
    return _reported(slim, every, copies, parts, window, version)


def _reported(slim: DataFrame, every: DataFrame, copies: DataFrame, parts: list[DataFrame], window: int, version: bool) -> tuple[DataFrame, DataFrame]:
    """The report of every row, and the texts that lost words, from the start words of repeated windows."""
    key = ["doc_id", "version"]
    starts = parts[0]
    for p in parts[1:]:
        starts = starts.unionByName(p)
    cut = materialize(_cut(slim.join(starts, key), window).dropDuplicates(key), "cut")
    for p in parts:
        discard(p)
    nothing = hashlib.sha256(b"").hexdigest()
    least = hot_least(every.measured["rows"])
    known = attach(every.drop("marks"), copies, "digest", least, F.col("n_words") >= window).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    gone = cut.select(F.concat_ws(":", *key).alias("_text"), "n_removed", F.col("kept_sha256").alias("_sha"), F.lit(1).alias("n"))
    named = known.withColumn("_text", F.when(F.col("doc_id").isNotNull() & ~F.col("copy") & (F.col("n_words") >= window), F.concat_ws(":", *key)))
    report = attach(named, gone, "_text", least, F.col("_text").isNotNull()).select(
        "doc_id", *key[1:] * version, "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("_sha", "kept_sha256")).alias("kept_sha256"),
    )
    return report, cut


def remove_repeats_from(index: WindowIndex, batch: DataFrame, history: DataFrame, window: int = WINDOW) -> DataFrame:
    """As remove_repeats(), for a new batch against all that an index (such as one opened again) has taken in; the index then holds the batch too.

    `history` has the texts (doc_id, text) of the documents taken in before; of these, only those are read that share a
    fingerprint with the batch which no two of them shared before. The result is the batch's rows. Where batches come in the order of
    doc_id, the results are those of remove_repeats() over all of them; a row reported once is not reported anew.
    """
    slim = _slim(batch)
    every, copies, lone = _sketched(slim, window)
    starts = _repeats(index, lone, slim, _slim(history), window)
    discard(lone)
    return _reported(slim, every, copies, [starts], window, False)[0]


def _bounds(ids: DataFrame, batches: int) -> list[int]:
    if batches < 2:
        return []
    at = [k / batches for k in range(1, batches)]
    found = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), 1000).alias("p")).first()["p"]
    return sorted(set(found or []))
