"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where both encodings surely agree."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from trackloom.llm.common import map_arrow, texts

#: The vocabulary of byte_bpe_50k.json as ranks, and its one special token.
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
LIMIT = 1024
CHUNK = 1 << 15
OVERLAP = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


class Counter:
    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counter", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def offsets(self, text: str) -> np.ndarray:
        """Byte offsets at which the tokens of a text end."""
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text)])

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text; the special string in it is one token and parts the text."""
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(self._count(p, chunk, overlap) for p in parts)

    def _count(self, text: str, chunk: int, overlap: int) -> int:
        if len(text) <= chunk:
            return len(self.encoding.encode_ordinary(text))
        return self._spliced(text, chunk, overlap)

    def _spliced(self, text: str, chunk: int, overlap: int) -> int:
        """Counts by chunks [start, start + chunk) whose overlaps are spliced.

        A token boundary in front of a single space between two other characters is stable: pieces never run across it,
        and what follows it is cut up alike from wherever encoding began. So the left chunk's tokens up to such a
        boundary and the right chunk's tokens from it are the whole text's tokens. Where an overlap holds none, it is widened.
        """
        total, start, taken = 0, 0, 0  # taken: bytes of the current chunk that are already counted
        end = min(chunk, len(text))
        left, wide = self.offsets(text[start:end]), overlap
        while end < len(text):
            begin = max(start, end - wide)
            stop = min(len(text), begin + max(chunk, 2 * wide))
            right = self.offsets(text[begin:stop])
            shift = len(text[start:begin].encode("utf-8"))
            agreed = np.intersect1d(np.intersect1d(left, right + shift), _stable(text[begin:end]) + shift)
            agreed = agreed[agreed > taken]
            if len(agreed):
                at = int(agreed[len(agreed) // 2])
                total += int(np.searchsorted(left, at, "right") - np.searchsorted(left, taken, "right"))
                start, end, left, taken, wide = begin, stop, right, at - shift, overlap
            elif begin > start:
                wide *= 2
            else:  # nothing stable in the whole chunk: it grows to what the wider one holds
                end, left = stop, right
        return total + int(len(left) - np.searchsorted(left, taken, "right"))


def _stable(text: str) -> np.ndarray:
    """Byte offsets of single spaces between two characters that are no white space."""
    at = [k for k, c in enumerate(text) if c == " " and 0 < k < len(text) - 1 and not text[k - 1].isspace() and not text[k + 1].isspace()]
    if not at:
        return np.zeros(0, np.int64)
    if text.isascii():
        return np.array(at, np.int64)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    width = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
    return width[at]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row's whole text.

    path is the vocabulary file on the workers; chunk and overlap are in characters and change no count. Null texts count
    as empty: no bytes, no tokens. Repeated rows and null doc_ids are rows like others; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path or default_path())
        for b in batches:
            n = np.array([(len(t.encode("utf-8")), c.count(t, chunk, overlap)) if t else (0, 0) for t in texts(b)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(n[:, 1] > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
