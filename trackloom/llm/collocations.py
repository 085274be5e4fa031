"""Phrase collocations by hierarchical pair naming.

Texts become blocks of word slots of one language, each with its own list of items. At level 1 an item is a word, at level
k a pair of adjacent, overlapping (k-1)-grams, written as their two names. Counting an item over all blocks gives frequent
ones a name: the least (block, slot) that holds it. The names go back to the blocks, whose pairs of adjacent names are the
next level's items. So a name's pair points to its two parents: following left parents gives the first words of a phrase,
right parents the last ones, and both are the phrases it subsumes at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import map_arrow, ready, texts
from trackloom.session import discard, materialize

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes when a longer one that holds it has so many hundredths of its count.
COVER = 80
SCALE = 2_000_000
#: Words of a block; one document more may follow. Slots have SLOT_BITS of a name, blocks of a task SEQ_BITS.
BLOCK_WORDS, SLOT_BITS, SEQ_BITS = 1 << 21, 30, 12
#: Pairs that a task counts at once; there are as many groups as the pairs of all blocks need.
COUNTED = 1 << 19
#: Parts of a language whose best are found first.
PARTS = 64

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
_BLOCK = "block long, lang string, n_words long, code binary, tie binary"


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


class _Open:
    """A language's words since the last flush."""

    def __init__(self):
        self.slots: defaultdict[bytes, int] = defaultdict()
        self.slots.default_factory = self.slots.__len__
        self.code, self.tie, self.n = [], [], 0

    def add(self, text: str) -> int:
        """Append a text; a word is tied to the one before it unless it begins a piece. Returns the number of words."""
        data = text.encode("utf-8").translate(_FOLD).replace(b"\n", b" \n ")
        words = [w for w in data.split(b" ") if w]
        code = np.fromiter(map(self.slots.__getitem__, words), np.int32, len(words))
        cut = self.slots.get(b"\n", -1)
        at = np.flatnonzero(code != cut)
        self.code.append(code[at])
        self.tie.append(np.diff(at, prepend=-2) == 1)
        self.n += len(at)
        return len(at)


def _words(docs: DataFrame, block_words: int) -> DataFrame:
    """Blocks of level 1: their words by slot with counts, and the text as slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << SEQ_BITS
        seq, held, langs = 0, 0, defaultdict(_Open)

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for lang, o in langs.items():
                if seq >> SEQ_BITS:
                    raise RuntimeError(f"over {1 << SEQ_BITS} blocks in one task: read the table in more partitions")
                code, words = np.concatenate(o.code), list(o.slots)
                counts = np.bincount(code, minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + seq]), pa.array([lang]), pa.array([o.n]), pa.array([code.tobytes()], pa.binary()), pa.array([np.packbits(np.concatenate(o.tie)).tobytes()], pa.binary()),
                     pa.array([[w.decode("utf-8") for w in words]], pa.list_(pa.string())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))],
                    ["block", "lang", "n_words", "code", "tie", "word", "c"],
                )
                seq += 1
            langs.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), texts(b)):
                if text:
                    held += langs["und" if lang is None else lang].add(text)
                    if held >= block_words:
                        yield from blocks()
                        held = 0
        yield from blocks()

    return map_arrow(docs.select(F.col("lang").cast("string").alias("lang"), "text"), run, f"{_BLOCK}, word array<string>, c array<int>")


def _named(blocks: DataFrame, least: int) -> DataFrame:
    """The words of `least` or more counts over all blocks of their language: own (block and slot), lang, word, f and its name id."""
    first = F.shiftleft(F.col("block"), SLOT_BITS).alias("first")
    slots = blocks.select(first, "lang", F.posexplode(F.arrays_zip("word", "c")).alias("slot", "x"))
    slots = slots.where("x.c > 0").select("lang", "x.word", "x.c", (F.col("first") + F.col("slot")).alias("own"))
    same = Window.partitionBy("lang", "word")
    return slots.select("*", F.sum("c").over(same).alias("f"), F.min("own").over(same).alias("id")).where(F.col("f") >= least)


def _squeezed(columns: list[np.ndarray]) -> bytes:
    """The columns' bytes by place (all first bytes, all second ones), since high ones are alike, with zstd."""
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), codec="zstd", asbytes=True)


def _restored(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in types]
    raw, at, out = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd", asbytes=True), np.uint8), 0, []
    for w, t in zip(widths, types):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(t))
        at += n * w
    return out


def _counted(blocks: DataFrame, groups: int, least: int, packed: bool = False, places: bool = True) -> DataFrame:
    """_named() for pairs: own (block and slot), the name id, and on the row with id = own also f, left and right.

    Pairs go to groups by their hash as packed arrays, a row for each block and group, and are counted there. packed: what is
    named comes as arrays, too: a row for each group and block with n slots and their names in data, if `places` are wanted,
    and a row without a block for each group with its names' id, f, left and right.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *arrays in zip(*b.columns):
                left, right, c = (x.values.to_numpy() for x in arrays)
                h = left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                group = ((h >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")  # slots stay sorted in a group
                group = group[order]
                cuts = np.flatnonzero(np.diff(group, prepend=-1))
                ends = np.append(cuts[1:], len(group))
                parts = [order[x:y] for x, y in zip(cuts, ends)]
                data = [_squeezed([np.diff(left[at], prepend=0), right[at], c[at], np.diff(at, prepend=0).astype(np.int32)]) for at in parts]
                yield pa.RecordBatch.from_arrays([pa.array(group[cuts]), pa.array(np.full(len(cuts), block.as_py(), np.int64)), pa.array((ends - cuts).astype(np.int32)), pa.array(data, pa.binary())], ["g", "block", "n", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def named() -> Iterator[pa.RecordBatch]:
            left, right, c, own = map(np.concatenate, zip(*held))
            order = np.lexsort((own, right, left))
            left, right, c, own = left[order], right[order], c[order], own[order]
            first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
            many = np.diff(np.append(first, len(own)))
            f = np.repeat(np.add.reduceat(c.astype(np.int64), first), many)
            name = np.repeat(own[first], many)
            on = f >= least
            own, name, f, left, right = (x[on] for x in (own, name, f, left, right))
            if not packed:
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(name), *(pa.array(x, mask=own != name) for x in (f, left, right))], names)
                return
            if not len(own):
                return
            head = np.flatnonzero(own == name)
            lists = [pa.array([x[head]], pa.list_(pa.int64())) for x in (own, f, left, right)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *lists], names)
            if places:
                order = np.argsort(own)
                block, slot, name = own[order] >> SLOT_BITS, (own[order] & ((1 << SLOT_BITS) - 1)).astype(np.int32), name[order]
                cuts = np.flatnonzero(np.diff(block, prepend=-1))
                ends = np.append(cuts[1:], len(block))
                data = [_squeezed([np.diff(slot[x:y], prepend=np.int32(0)), name[x:y]]) for x, y in zip(cuts, ends)]
                none = pa.nulls(len(cuts), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array((ends - cuts).astype(np.int32)), pa.array(data, pa.binary()), *[none] * 4], names)

        for b in batches:
            for g, block, n, data in zip(*(b.column(x).to_pylist() for x in range(4))):
                if g != now:
                    if held:
                        yield from named()
                    now, held = g, []
                left, right, c, step = _restored(data, n, "i8", "i8", "i4", "i4")
                held.append((np.cumsum(left), right, c, (block << SLOT_BITS) + np.cumsum(step, dtype=np.int64)))
        if held:
            yield from named()

    names = ["block", "n", "data", "id", "f", "left", "right"] if packed else ["own", "id", "f", "left", "right"]
    kinds = "block long, n int, data binary, id array<long>, f array<long>, left array<long>, right array<long>" if packed else "own long, id long, f long, left long, right long"
    posted = map_arrow(blocks.select("block", "left", "right", "c"), post, "g long, block long, n int, data binary")
    return map_arrow(posted.repartition("g").sortWithinPartitions("g"), count, kinds)


def _pairs(blocks: DataFrame, named: DataFrame, text: bool) -> DataFrame:
    """Blocks of the next level: each block meets the names of its items, and its tied neighbours with names become items.

    named: as _named() or a packed _counted() gives it. Items are in the order of their parents' names, so that those of a block
    pack well. text: whether the block's text is wanted at all, that is whether a further level follows.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("block", "lang", "n_words", "code", "tie", "left", "right", "c")}
        if left.num_rows and right.num_rows:
            code = np.frombuffer(left["code"][0].as_py(), np.int32)
            tie = _flags(left["tie"][0].as_py(), len(code))
            if packed:
                each = [_restored(data, n, "i4", "i8") for n, data in zip(right["n"].to_pylist(), right["data"].to_pylist())]
                slot, name = np.concatenate([np.cumsum(x[0]) for x in each]), np.concatenate([x[1] for x in each])
            else:
                slot, name = right["slot"].to_numpy(), right["id"].to_numpy()
            order = np.argsort(name)
            slot, name = slot[order], name[order]
            new = np.full(max(int(code.max(initial=-1)), int(slot.max())) + 1, -1, np.int64)
            new[slot] = np.arange(len(slot))
            code = new[code]
            ok = code >= 0
            at = np.flatnonzero(ok[:-1] & ok[1:] & tie[1:])
            items, code, counts = np.unique(code[at] * len(slot) + code[at + 1], return_inverse=True, return_counts=True)
            if len(items):
                out["block"], out["lang"], out["n_words"] = [key[0].as_py()], [left["lang"][0].as_py()], [len(at)]
                out["code"] = [code.astype(np.int32).tobytes() if text else b""]
                out["tie"] = [np.packbits(np.diff(at, prepend=-2) == 1).tobytes() if text else b""]
                out["left"], out["right"], out["c"] = [name[items // len(slot)]], [name[items % len(slot)]], [counts.astype(np.int32)]
        kinds = {"lang": pa.string(), "code": pa.binary(), "tie": pa.binary(), "left": pa.list_(pa.int64()), "right": pa.list_(pa.int64()), "c": pa.list_(pa.int32())}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    ready(blocks.sparkSession)
    slim = blocks.select("block", "lang", "code", "tie")
    if packed := "data" in named.columns:
        places = named.where("block is not null").select("block", "n", "data")
    else:
        places = named.select(F.shiftright("own", SLOT_BITS).alias("block"), F.col("own").bitwiseAND((1 << SLOT_BITS) - 1).cast("int").alias("slot"), "id")
    return slim.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(run, f"{_BLOCK}, left array<long>, right array<long>, c array<int>")


def _levels(docs: DataFrame, least: int, longest: int, block_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words by language (lang, n), and per level the names: id, f, and the word with its lang or the parents left and right."""
    blocks = materialize(_words(docs, block_words), "phrase-blocks-1")
    totals = materialize(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    names = []
    for k in range(1, longest + 1):
        found = _named(blocks, least) if k == 1 else _counted(blocks, max(1, -(-(blocks.measured["items"] or 0) // COUNTED)), least, packed=True, places=k < longest)
        named = materialize(found, f"phrase-named-{k}", tidy=True)
        if k == 1:
            names.append(named.where("id = own").select("id", "f", "word", "lang"))
        else:
            names.append(named.where("block is null").select(F.explode(F.arrays_zip("id", "f", "left", "right")).alias("x")).select("x.*"))
        if k < longest:
            after = materialize(_pairs(blocks, named, k + 1 < longest), f"phrase-blocks-{k + 1}", tidy=True, items=F.sum(F.size("c")))
            discard(blocks)
            blocks = after
    discard(blocks)
    return totals, names


def _exact(column: Column | int) -> Column:
    """As a decimal whose products with SCALE don't overflow."""
    return (column if isinstance(column, Column) else F.lit(column)).cast("decimal(19,0)")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, scale: int = SCALE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All collocations of docs: lang, phrase, words, a, l, r, n, score.

    A-Z are lower-cased, [.,;:!?\\x0A-\\x0D] part pieces, words are [^\\x20\\x09]+. Per lang (null: und), phrases of 2 to `longest`
    words that stand `least` times or more in pieces, overlaps included, are candidates with a their count. Of the cuts of a
    candidate into l and r times found parts, the one with the lowest score floor(scale a / (l + r)) counts, the shortest
    first part if several have it. A candidate goes if a longer one that holds it has `cover` hundredths of its count.

    Null and empty texts have no words; repeated rows count each time; columns but lang and text are ignored; an empty table
    gives no rows. Blocks hold `block_words` words and at most one document more. A candidate's longer ones are looked up one
    word up only: what a still longer one covers, the one between covers too.
    """
    if not 2 <= longest or least < 1:
        raise ValueError("longest is 2 at least, least 1")
    totals, names = _levels(docs, least, longest, block_words)
    kinds = "cast(array() as array<long>)"
    level = names[0].select("lang", "id", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.expr(kinds).alias("heads"), F.expr(kinds).alias("tails"))
    found = None
    for k in range(2, longest + 1):
        left = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.concat("heads", F.array("f")).alias("heads"))
        right = level.select(F.col("id").alias("right"), "last", F.concat(F.array("f"), "tails").alias("tails"))
        joined = names[k - 1].join(left, "left").join(right, "right")
        level = materialize(joined.select("lang", "id", "f", "left", "right", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "heads", "tails"), f"phrase-level-{k}", tidy=True)
        if k < longest:
            up = names[k].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), F.col("f").alias("up")).groupBy("id").agg(F.max("up").alias("up"))
            kept = level.join(up, "id", "left").where(F.col("up").isNull() | (_exact(100) * _exact(F.col("up")) < _exact(cover) * _exact(F.col("f")))).drop("up")
        else:
            kept = level
        rows = kept.select("lang", "id", "phrase", F.lit(k).alias("words"), F.col("f").alias("a"), "heads", "tails")
        found = rows if found is None else found.unionByName(rows)
    cuts = F.transform(
        F.arrays_zip("heads", "tails"),
        lambda c, i: F.struct(_floor(scale, F.col("a"), c["heads"] + c["tails"]).alias("score"), i.alias("k"), c["heads"].alias("l"), c["tails"].alias("r")),
    )
    best = found.withColumn("cut", F.array_min(cuts))
    return best.join(totals, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def _floor(scale: int, a: Column, parts: Column) -> Column:
    """floor(scale a / parts) in decimals: what is left over is taken off first, so that the division is exact."""
    product = (F.lit(scale).cast("decimal(18,0)") * a.cast("decimal(19,0)")).cast("decimal(38,0)")
    rest = F.pmod(product, parts.cast("decimal(38,0)"))
    return ((product - rest) / parts.cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, top: int = TOP, parts: int = PARTS, **how: int) -> DataFrame:
    """The first `top` of phrases() of each language by score and a, falling, and phrase in byte order: lang, rank, phrase, a, l, r, n, score.

    The best of each of `parts` parts of a language are found first, so that one language's phrases are not one task.
    """
    found = phrases(docs, **how)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = first.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
