"""Quality scores learned from preference pairs (Bradley-Terry) and cut at a score quantile.

A text is described by what it looks like (FEATURES) and by what it says (hashed n-grams of words and bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import held_out, map_arrow, texts

#: Labelled rows to learn from, in expectation; they are drawn by a hash of the doc_id.
TRAIN_ROWS = 12_000
#: Preferred rows that each rejected row is paired with.
PAIRS = 12
#: Penalties of the weights of FEATURES and of hashed n-grams.
RIDGE, GRAM_RIDGE = 1e-3, 0.3
CUT = 0.3
#: Buckets of hashed words and word pairs, and of hashed byte triples (powers of two).
WORD_BITS, BYTE_BITS = 9, 7
GRAMS = (1 << WORD_BITS) + (1 << BYTE_BITS)
WORDS_KEPT = 1 << 17
#: Pairs whose differences are formed at once.
PAIRS_AT_ONCE = 2048
FEATURES = (
    "log_chars", "letters", "upper", "digits", "space", "lines_per_word", "stops_per_word", "marks_per_word", "top_mark", "calls_per_word",
    "pipes_per_word", "word_length", "distinct", "log_distinct", "line_repeats", "short_words", "long_words", "tagged_words",
)
_STOPS, _CALLS, _PIPES = b".,;:?'\"-()", b"!", b"|"
_CLASS = np.zeros(256, np.int64)  # 0 other control, 1 lower, 2 upper, 3 digit, 4 space, 5 stop, 6 mark
_CLASS[33:127] = 6
for _bytes, _k in ((range(97, 123), 1), (range(128, 256), 1), (range(65, 91), 2), (range(48, 58), 3), ((32, *range(9, 14)), 4), (_STOPS, 5)):
    for _b in _bytes:
        _CLASS[_b] = _k


def features(text: str | None) -> np.ndarray:
    """What a text looks like, by counts of its bytes, words and lines; zeros for an empty one."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8")
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=hist, minlength=7)
    words = raw.split()
    n, w = len(raw), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds, lines = len(set(words)), [x for x in raw.split(b"\n") if x.strip()]
    marks = np.where(_CLASS == 6, hist, 0)
    letters = kind[1] + kind[2]
    ends = sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128 and x[-1] not in _STOPS)
    out[:] = (
        np.log1p(n), letters / n, kind[2] / max(1, letters), kind[3] / n, kind[4] / n, min(2.0, hist[10] / w), min(2.0, kind[5] / w),
        min(2.0, kind[6] / w), min(2.0, marks.max() / w), min(2.0, hist[33] / w), min(2.0, hist[124] / w), min(20.0, lengths.mean()),
        kinds / w, np.log1p(kinds) / np.log1p(w), 1 - len(set(lines)) / max(1, len(lines)), (lengths <= 2).mean(), (lengths > 14).mean(), ends / w,
    )
    return out


def grams(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """What a text says: square roots of the shares of its hashed words and word pairs, and of its byte triples, in lower case.

    `known` keeps hashes of words between calls. An empty text has zeros.
    """
    out = np.zeros(GRAMS, np.float32)
    raw = (text or "").encode("utf-8").lower()
    words = raw.split()
    if words:
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        place = np.concatenate([h, pair]) >> np.uint64(64 - WORD_BITS)
        out[: 1 << WORD_BITS] = np.bincount(place.astype(np.int64), minlength=1 << WORD_BITS) / len(place)
    if len(raw) > 2:
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        triple = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2_654_435_761)
        out[1 << WORD_BITS :] = np.bincount(triple >> np.uint32(32 - BYTE_BITS), minlength=1 << BYTE_BITS) / len(triple)
    return np.sqrt(out)


def all_features(texts_: Iterator[str | None], known: dict[bytes, int]) -> np.ndarray:
    """FEATURES, then n-grams, a row a text."""
    rows = [np.concatenate([features(t), grams(t, known)]) for t in texts_]
    return np.array(rows).reshape(-1, len(FEATURES) + GRAMS)


class QualityModel:
    """s(x) = weights . (f(x) - mean) / deviation; cut is the score at the learned quantile."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, weights: np.ndarray, cut: float):
        self.mean, self.deviation, self.weights, self.cut = mean, deviation, weights, cut

    def strength(self, f: np.ndarray) -> np.ndarray:
        return ((f - self.mean) / self.deviation) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        """0 to 1, rising with strength, and CUT at the cut."""
        z = np.clip(self.strength(f) - self.cut, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def fit(f: np.ndarray, label: np.ndarray, pairs: int = PAIRS, quantile: float | None = None, seed: int = 0) -> QualityModel:
    """Bradley-Terry: P(a preferred to b) = sigmoid(s(a) - s(b)), fitted on drawn pairs (label 1, label 0) by Newton's method.

    The cut is the midpoint around the `quantile` of the training scores, which is the share of label 0 unless given.
    With one label only, nothing is preferred: all strengths are 0 and all pass if that label is 1.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    width = f.shape[1]
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), -1.0 if len(good) or not len(label) else 1.0)
    mean, deviation = f.mean(axis=0, dtype=np.float64), f.std(axis=0, dtype=np.float64)
    deviation[deviation < 1e-9] = 1.0
    deviation[len(FEATURES) :] = np.maximum(deviation[len(FEATURES) :], 0.01)  # rare n-grams aren't blown up
    ridge = np.where(np.arange(width) < len(FEATURES), RIDGE, GRAM_RIDGE)
    x = ((f - mean.astype(f.dtype)) / deviation.astype(f.dtype)).astype(np.float32)
    draw = np.random.default_rng(seed)
    left, right = draw.choice(good, size=(len(bad), pairs)).ravel(), np.repeat(bad, pairs)
    w = np.zeros(width)
    for _ in range(30):
        # the pairs' differences are made a few at a time: the driver holds the rows once, not once a pair
        slope, bend = -ridge * w, np.diag(ridge)
        for k in range(0, len(left), PAIRS_AT_ONCE):
            diff = x[left[k : k + PAIRS_AT_ONCE]].astype(np.float64) - x[right[k : k + PAIRS_AT_ONCE]]
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            slope += diff.T @ (1 - p) / len(left)
            bend += (diff * (p * (1 - p))[:, None]).T @ diff / len(left)
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(x @ w)
    k = int(np.clip(round((len(bad) / len(label) if quantile is None else quantile) * len(s)), 1, len(s) - 1))
    return QualityModel(mean, deviation, w, float((s[k - 1] + s[k]) / 2))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fits on about `rows` labelled documents; labels has doc_id and quality (0 or 1).

    Null labels and ids teach nothing; of several labels of a document the majority counts, a tie as 1, and of several rows
    of a document one. One task holds one row of features (3 kB) per drawn document, which `rows` bounds.
    """
    each = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    each = each.select("doc_id", (F.col("q") >= 0.5).cast("int").alias("quality")).where(~held_out())
    n = each.count()
    share = min(1.0, rows / n) if n else 0.0
    drawn = each.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < share * (1 << 20))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # bounded by rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            f = [features(t).tobytes() + grams(t, known).astype(np.float16).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.binary())], ["doc_id", "quality", "f"])

    each = map_arrow(joined, run, "doc_id long, quality int, f binary").groupBy("doc_id", "quality").agg(F.min("f").alias("f"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, f, y = 8 * len(FEATURES), [], []
        for b in batches:
            for _, q, raw in sorted(zip(*(b.column(c).to_pylist() for c in range(3)))):
                f.append(np.concatenate([np.frombuffer(raw[:cut]).astype(np.float32), np.frombuffer(raw[cut:], np.float16)], dtype=np.float32))
                y.append(q)
        m = fit(np.array(f, np.float32).reshape(-1, len(FEATURES) + GRAMS), np.array(y, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64())) for v in (m.mean, m.deviation, m.weights, np.array([m.cut]))], ["mean", "deviation", "weights", "cut"])

    # one task learns from the drawn rows, which `rows` bounds, in the order of their ids; the driver gets the weights
    one = map_arrow(each.repartition(1).sortWithinPartitions("doc_id"), learn, "mean array<double>, deviation array<double>, weights array<double>, cut array<double>").first()
    return QualityModel(*(np.array(one[c]) for c in ("mean", "deviation", "weights")), one["cut"][0]) if one else fit(np.zeros((0, len(FEATURES) + GRAMS)), np.zeros(0, np.int64))


def predict(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= CUT) of every row's whole text.

    Null and empty texts have the features of an empty text. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            s = shared.value.score(all_features(texts(b), known))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names)

    names = ["doc_id", "held_out", "score", "predicted"]
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_arrow(slim, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return predict(docs, train(docs, labels, rows))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs predicted 1, learned as classify() does; all columns stay and no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            yield b.filter(pa.array(shared.value.score(all_features(texts(b), known)) >= CUT))

    return map_arrow(docs, run, docs.schema)
