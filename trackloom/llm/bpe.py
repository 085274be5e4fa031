"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece the encoding ends in one token only; it is the match t ending there whose predecessor, the
last token of the prefix before t, stands next to t in an encoding (a pair-compatibility test on the merge tree). All
matches that end at a position come from an automaton with suffix links over the vocabulary. Following the last tokens
back from the end gives the ids that merging in rank order gives.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from trackloom.llm.common import map_arrow, texts

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the byte-level pre-tokenizer's pattern, as the vocabulary's public description states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this character all Unicode versions in use agree on what is a letter or a number.
SETTLED = "\u0530"
#: Entries of a worker's cache of words, emptied when full: it bounds memory, not results.
CACHE_WORDS = 700_000
CACHE_PAIRS = 2_000_000
LONGEST_CACHED = 64
#: A space is not certainly the start of a piece where white space stands on both its sides.
_LOOSE = regex.compile(r"\s (?:\s|\z)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The vocabulary and merges of a byte-level BPE file, with the caches of one worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = (bytes(alphabet[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, (k, whole))
            self.parts.setdefault(whole, (k, *pair))
        self.pattern, self.rare = regex.compile(PATTERN), ByteLevel(add_prefix_space=False)
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            # a token that its own merges don't rebuild never appears in an encoding
            if len(token) == 1 or (i in self.parts and self._rebuilt(i)):
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()

    def _rebuilt(self, token: int) -> bool:
        _, a, b = self.parts[token]
        return self.compatible(a, b, self.parts[token][0])

    def compatible(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether merging the bytes of a and b in rank order (below rank `limit`) leaves the two apart.

        The last merges of a's right edge and b's left edge are undone, latest first. x and y then stood side by side until
        x went into its parent at rank `upto_x` or y at `upto_y`; had their own merge come first, a and b couldn't both
        be left. Of equal ranks the one further left goes first.
        """
        memo = limit == float("inf")
        if memo and (known := self.fits.get((a, b))) is not None:
            return known
        x, y, upto_x, upto_y, ok = a, b, limit, limit, True
        while True:
            pair = self.rank.get((x, y))
            if pair is not None and pair[0] < upto_x and pair[0] <= upto_y:
                ok = False
                break
            of_x, of_y = self.parts.get(x), self.parts.get(y)
            if of_x is None and of_y is None:
                break
            if of_x is None or (of_y is not None and of_y[0] >= of_x[0]):
                upto_y, y = of_y[0], of_y[1]
            else:
                upto_x, x = of_x[0], of_x[2]
        if memo:
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            self.fits[a, b] = ok
        return ok

    def piece_ids(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: last tokens of all prefixes, then the way back from the end."""
        n = len(piece)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        fits, compatible = self.fits, self.compatible
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = fits.get((before, token))
                if not (compatible(before, token) if ok is None else ok):
                    continue
            last[end], size[end] = token, length
        out = []
        while n:
            if last[n] < 0:
                raise ValueError(f"the vocabulary cannot spell {piece!r}")
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text. Which rare characters are letters hangs on a Unicode version, so there the library cuts."""
        if not text or max(text) < SETTLED:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.rare.pre_tokenize_str(text)]

    def chunk(self, text: str) -> bytes:
        """Little-endian ids of a text without special strings, straight from its pre-tokens."""
        ids = []
        for piece in self.pieces(text):
            ids += self.piece_ids(piece.encode("utf-8"))
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if _LOOSE.search(text):
            return self.chunk(text)
        # a space between two other characters starts a piece whatever stands around it, so words can be cached
        head, *rest = text.split(" ")
        words = self.words
        out = [self.chunk(head)]
        for w in rest:
            ids = words.get(w)
            if ids is None:
                ids = self.chunk(" " + w)
                if len(w) <= LONGEST_CACHED:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; special strings in it are their special tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = []
        for part in self.cut.split(text):
            parts.append(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part) if part else b"")
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of such ids, special tokens as their strings; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", errors="replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process; its caches serve all tasks the worker runs."""
    return Encoder(path)


def _mapped(docs: DataFrame, row, schema: str, path: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path or default_path())
        for b in batches:
            cols = list(zip(*(row(e, t or "") for t in texts(b))))
            if cols:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], names)

    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text.

    path is the tokenizer file on the workers. Null and empty texts have no ids. Repeated rows, null doc_ids and very long
    texts are rows like others; other columns are ignored; an empty table gives no rows.
    """
    return _mapped(docs, lambda e, t: (np.frombuffer(e.encode(t), "<i4"),), "ids array<int>", path)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path or default_path())
        for b in batches:
            out = [e.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_arrow(tokens.select("doc_id", "ids"), run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def _round_trip(e: Encoder, text: str) -> tuple[int, str, str]:
    ids = e.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids).encode("utf-8")).hexdigest()


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encode() and decode() in one pass over the texts, with digests for results."""
    return _mapped(docs, _round_trip, "n_tokens long, ids_sha256 string, decoded_sha256 string", path)
