"""Language identification by unigram piece models whose segmentations are summed out."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import held_out, map_arrow, texts

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
#: Rows a language is learned from, in expectation: they are drawn by a hash of the doc_id.
TRAIN_ROWS = 1500
ROUNDS = 2
SMOOTHING = 0.05
#: Probability of a letter that no piece spells, in every language.
LETTER = 1e-6
#: A worker's cache, emptied when full: words, and log scores over all languages.
CACHE_WORDS, CACHE_SCORES = 150_000, 1_500_000
#: Characters of the texts that are scored together.
TOGETHER = 500_000
#: Words longer than this are scored with rescaling and not cached.
LONG = 24
_SPACE = "▁"


@lru_cache(2)
def _classes(top: int) -> tuple[str, str]:
    """The code points up to `top` that are letters, and letters or marks (categories L and M), as ranges of a pattern."""
    out = []
    for kinds in ("L", "LM"):
        runs: list[list[int]] = []
        for c in range(top + 1):
            if unicodedata.category(chr(c))[0] in kinds:
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
        out.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs))
    return out[0], out[1]


@lru_cache(4)
def _word_pattern(top: int) -> re.Pattern:
    """A letter with the letters and marks that follow it."""
    letters, both = _classes(top)
    return re.compile(f"[{letters}][{both}]*")


_RARE = re.compile("[\U00010000-\U0010ffff]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(2)
def vocabulary(path: str) -> tuple[str, ...]:
    """The pieces of a sentencepiece file that spell letters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    spelling = re.compile(f"[{_classes(sys.maxunicode)[1]}]+")
    return tuple(p for p in map(sp.id_to_piece, ids) if spelling.fullmatch(p.removeprefix(_SPACE) or "a"))


@lru_cache(2)
def _automaton(path: str) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, p in enumerate(vocabulary(path)):
        a.add_word(p, i << 6 | len(p))
    a.make_automaton()
    return a


def words_of(text: str) -> list[str]:
    """The words of a text in lower case: letters with their marks. Digits and other numbers, such as fractions, are no letters."""
    text = text.lower()
    return _word_pattern(sys.maxunicode if _RARE.search(text) else 0xFFFF).findall(text)


@lru_cache(2)
def _single(path: str) -> frozenset[str]:
    return frozenset(p for p in vocabulary(path) if len(p) == 1)


def matches(path: str, word: str) -> list[tuple[int, int, int]]:
    """(start, end, piece) of all pieces in a marked word, by end; piece -1 spells a letter that no single piece does."""
    marked, single = _SPACE + word, _single(path)
    spare = [(k, k + 1, -1) for k, c in enumerate(marked) if c not in single]
    found = [(end + 1 - (v & 63), end + 1, v >> 6) for end, v in _automaton(path).iter(marked)]
    return sorted(spare + found, key=lambda m: m[1]) if spare else found


def forward(found: list[tuple[int, int, int]], n: int, p: list, unknown: list[float]) -> list[list[float]]:
    """Sums over all segmentations of each prefix, for all languages at once; p[piece] holds a probability a language."""
    sums: list = [[1.0] * len(unknown), *([0.0] * len(unknown) for _ in range(n))]
    for start, end, i in found:
        q = unknown if i < 0 else p[i]
        sums[end] = [x + y * z for x, y, z in zip(sums[end], sums[start], q)]
    return sums


def log_scores(path: str, word: str, p: list, k: int) -> np.ndarray:
    """Log probability of a word in each language, all segmentations summed."""
    found, n, unknown = matches(path, word), len(word) + 1, [LETTER] * k
    if n <= LONG + 1:
        return np.log(forward(found, n, p, unknown)[n])
    sums, logs = np.zeros((n + 1, k)), np.zeros(k)
    sums[0], longest, done = 1.0, max(e - s for s, e, _ in found), 0
    for start, end, i in found:
        if end > done + 1:
            done = end - 1
            low = sums[done].copy()
            if low.min() < 1e-100 and low.min() > 0:  # rescale all prefixes that later matches can start from
                sums[max(0, done - longest) : done + 1] /= low
                logs += np.log(low)
        sums[end] += sums[start] * (LETTER if i < 0 else np.asarray(p[i]))
    return np.log(sums[n]) + logs


def expected_counts(path: str, words: list[str], counts: list[int], p: list[float]) -> dict[int, float]:
    """Expected uses of each piece in one language's words, by forward and backward sums."""
    out: Counter = Counter()
    for word, c in zip(words, counts):
        found, n = matches(path, word), len(word) + 1
        f, b = [1.0, *[0.0] * n], [0.0] * n + [1.0]
        for s, e, i in found:
            f[e] += f[s] * (LETTER if i < 0 else p[i])
        for s, e, i in reversed(found):
            b[s] += b[e] * (LETTER if i < 0 else p[i])
        if f[n] > 0:
            for s, e, i in found:
                if i >= 0:
                    out[i] += c * f[s] * p[i] * b[e] / f[n]
    return out


class LanguageModel:
    """languages in ascending order, and per piece a probability a language."""

    def __init__(self, languages: list[str], p: np.ndarray, path: str | None = None):
        self.languages, self.p, self.path = languages, p, path


def train(docs: DataFrame, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, path: str | None = None) -> LanguageModel:
    """Fits the piece probabilities of each language on about `rows` of its rows (doc_id, text, lang) by EM.

    Word counts and expected counts are Spark aggregations; the driver gets one number per piece and language.
    Rows with a null text or lang teach nothing.
    """
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    size = len(vocabulary(path or default_path()))
    if not languages:
        return LanguageModel([], np.zeros((size, 0)), path)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for t, lang in zip(texts(b), b.column(1).to_pylist()):
                for w, n in Counter(words_of(t)).items():
                    if len(w) <= LONG:
                        seen[lang, w] += n
            lang, word = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    words = map_arrow(drawn.select("text", "lang"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    p = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast({lang: p[:, k].tolist() for k, lang in enumerate(languages)})

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            where = path or default_path()
            for b in batches:
                by: dict = {}
                for lang, w, n in zip(*(b.column(c).to_pylist() for c in range(3))):
                    by.setdefault(lang, ([], []))
                    by[lang][0].append(w)
                    by[lang][1].append(n)
                for lang, (w, n) in by.items():
                    got = expected_counts(where, w, n, shared.value[lang])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(list(got), pa.int32()), pa.array(list(got.values()), pa.float64())], ["lang", "piece", "n"])

        part = map_arrow(words, expect, "lang string, piece int, n double")
        # at most pieces times languages rows, in a fixed order so that sums and results repeat
        got = part.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts = np.full(p.shape, SMOOTHING)
        at = {lang: k for k, lang in enumerate(languages)}
        for r in got:
            counts[r["piece"], at[r["lang"]]] += r["n"]
        p = counts / counts.sum(axis=0)
    words.unpersist()
    return LanguageModel(languages, p, path)


class Scorer:
    """One worker's scoring state: log scores of the words it has met. New words are scored together, position by position."""

    def __init__(self, model: LanguageModel):
        self.model, self.k, self.path = model, len(model.languages), model.path or default_path()
        self.p = np.vstack([model.p, np.full((1, self.k), LETTER)])  # the last row spells unknown letters
        self.room = max(1, min(CACHE_WORDS, CACHE_SCORES // max(1, self.k)))
        self.words: dict[str, int] = {}
        self.rows = np.empty((self.room, self.k))
        self.single = np.array(sorted(map(ord, _single(self.path))), np.uint32)

    def batch_scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities (word, language) of words of up to LONG letters: the forward sums of all words at once."""
        out, step = np.empty((len(words), self.k)), max(1, CACHE_SCORES // (2 * (LONG + 2) * max(1, self.k)))
        for k in range(0, len(words), step):
            part = words[k : k + step]
            text = "\n".join([_SPACE + w for w in part])  # no piece holds a line break
            lengths = np.fromiter(map(len, part), np.int64, len(part)) + 1
            first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            found = np.fromiter(chain.from_iterable(_automaton(self.path).iter(text)), np.int64).reshape(-1, 2)
            chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            spare = np.flatnonzero(~np.isin(chars, self.single) & (chars != 10))
            end = np.concatenate([found[:, 0], spare])
            piece = np.concatenate([found[:, 1] >> 6, np.full(len(spare), -1)])
            size = np.concatenate([found[:, 1] & 63, np.ones(len(spare), np.int64)])
            word = np.repeat(np.arange(len(part)), lengths + 1)[end]
            upto = end - first[word] + 1
            order = np.argsort(upto.astype(np.uint8), kind="stable")
            cuts = np.searchsorted(upto[order], np.arange(1, lengths.max() + 2))
            sums = np.zeros((int(lengths.max()) + 1, len(part), self.k))
            sums[0] = 1.0
            for e in range(1, int(lengths.max()) + 1):
                sel = order[cuts[e - 1] : cuts[e]]
                w = word[sel]
                mass = sums[e - size[sel], w] * self.p[piece[sel]]
                for c in range(self.k):
                    sums[e, :, c] = np.bincount(w, weights=mass[:, c], minlength=len(part))
            out[k : k + step] = np.log(sums[lengths, np.arange(len(part))])
        return out

    def score(self, texts_: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text; the texts are few enough to hold their words at once."""
        if not self.k:
            return [(UNKNOWN, 0.0)] * len(texts_)
        lists, known = [words_of(t) if t else [] for t in texts_], self.words
        short = lambda ws: {w for ws_ in ws for w in ws_ if w not in known and len(w) <= LONG}
        new = short(lists)
        if len(known) + len(new) > self.room:
            known.clear()
            new = short(lists)
            if len(new) > len(self.rows):
                self.rows = np.empty((len(new), self.k))
        if new:
            ordered, base = sorted(new), len(known)
            self.rows[base : base + len(ordered)] = self.batch_scores(ordered)
            known.update(zip(ordered, range(base, base + len(ordered))))
        out = []
        for ws in lists:
            if not ws:
                out.append((UNKNOWN, 0.0))
                continue
            ids = [i for i in map(known.get, ws) if i is not None]
            total = self.rows[ids].sum(axis=0)
            for w in ws if len(ids) < len(ws) else ():
                if len(w) > LONG:
                    total = total + log_scores(self.path, w, self.p, self.k)
            best = int(np.argmax(total))  # ties: the first language
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _groups(batch: pa.RecordBatch) -> Iterator[list[str | None]]:
    """The texts of a batch in groups of about TOGETHER characters; a longer text is a group of its own."""
    held, size = [], 0
    for t in texts(batch):
        if held and size + len(t or "") > TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score (posterior under equal priors) of every row's whole text.

    Null texts and texts without a letter are `und` with score 0, as is all where nothing was learned. Ties go to the
    first language in alphabetical order. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for b in batches:
            got = [r for group in _groups(b) for r in score.score(group)]
            lang, p = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(b.num_columns - 1)), pa.array(lang, pa.string()), pa.array(p, pa.float64())], names)

    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    names = ["doc_id", "held_out", "lang_pred", "score"]
    return map_arrow(slim, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, rows: int = TRAIN_ROWS, path: str | None = None) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score."""
    return predict(docs, train(docs.where(~held_out()), rows, path=path))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is found with a posterior of `least` or more, learned as identify() does; all columns stay and no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held_out())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for b in batches:
            got = [lang != UNKNOWN and p >= least for group in _groups(b) for lang, p in score.score(group)]
            yield b.filter(pa.array(got, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
