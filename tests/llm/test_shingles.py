"""Near-copies against brute force over five-word shingles."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from trackloom.llm import shingles, simhash
from trackloom.llm.common import table

from .test_tables import components


def shingle_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Least doc_id of each document's group of links at 0.8 or more; empty sets are equal."""
    sets = [(i, shingle_words(t)) for i, t in rows if i is not None]
    linked = [
        (i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x]
        if (5 * len(a & b) >= 4 * len(a | b) if a and b else a == b)
    ]
    return components({i for i, _ in sets}, linked)


def families(r):
    """Texts with copies on both sides of 0.8: edited inside, with new tails, cut, and short."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 8)))
    rows = []
    for n in (1, 4, 5, 6, 14, 20, 40, 100, 200, 300):
        for _ in range(6):
            w = [word() for _ in range(n)]
            copies = [list(w) for _ in range(3)]
            for c in copies[1:]:
                for at in r.sample(range(n), min(n, max(1, n // 40 if c is copies[1] else n // 20))):
                    c[at] = word()
            copies += [w + [word() for _ in range(k)] for k in (n // 10, n // 5, n // 4, n // 3)]
            copies += [w[: n - k] for k in (1, n // 8, n // 5, n // 4)] + [w[:-1] + [word()], [word(), *w]]
            rows += [" ".join(c) for c in copies]
    rows += [None, "", " \t", "One  two", "one TWO", "one two three"]
    r.shuffle(rows)
    out = list(enumerate(rows))
    return out + [out[5], out[5], (9, rows[70]), (None, rows[3]), (None, None)]


@pytest.mark.parametrize("tile", [3, shingles.TILE])
def test_groups_equal_brute_force(spark, tile):
    rows = families(random.Random(11))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = shingles.near_copies(df, tile).collect()
    want = brute(rows)
    ids = {r.doc_id: r.component_id for r in got}
    assert len(ids) == len(got)
    assert {i: ids.get(i, i) for i in want} == want
    assert 100 < sum(want[i] != i for i in want) < len(want) - 100


def test_pairs_that_no_bucket_end_links(spark):
    # a chain of copies under one common passage: most links are between texts that are neither end of their bucket
    r = random.Random(5)
    base = ["w%d" % k for k in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in r.sample(range(200), r.randint(2, 9)):
            w[at] = "x%d" % r.randint(0, 30)
        rows.append((i, " ".join(w)))
    want = brute(rows)
    got = {x.doc_id: x.component_id for x in shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_stage_keeps_the_first_by_shingles(spark, small):
    docs = table(spark, small, "documents")
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    want = brute(rows)
    got = {x.doc_id for x in P.near_duplicate_stage(spark, docs, small).collect()}
    assert got == {i for i in want if want[i] == i}


def test_similar_words_below_the_rule_stay(spark):
    words = ["v%d" % k for k in range(100)]
    edited = [("changed" if k % 20 == 10 else w) for k, w in enumerate(words)]  # 5 of 100 words, 0.59 of the shingles
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:-4]))]
    assert {x.doc_id for x in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2}


def test_empty_table(spark):
    assert shingles.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_met_grow_with_the_rows_of_a_group(spark, monkeypatch):
    # near-copies that bucket ends leave in many components: all their pairs were met at once
    r = random.Random(7)
    base = ["w%d" % k for k in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        for at in r.sample(range(200), r.randint(3, 6)):
            w[at] = "x%d" % r.randint(0, 400)
        rows.append((i, " ".join(w)))
    met = []

    def counted(df, name, **how):
        out = materialize(df, name, **how)
        if name == "shingle-left":
            met.append(out.count())
        return out

    materialize = shingles.materialize
    monkeypatch.setattr(shingles, "materialize", counted)
    got = {x.doc_id: x.component_id for x in shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {i: got.get(i, i) for i in want} == want
    assert max(met) < 4 * len(rows), met


def test_likeliest_mates_are_a_row_a_row_at_most():
    r = np.random.default_rng(3)
    m, words = 200, shingles.PARITY_BITS // 64
    base = r.integers(0, 1 << 63, words, dtype=np.uint64)
    bits = np.array([base ^ np.eye(1, words, k % words, dtype=np.uint64)[0] * np.uint64(1 << (k % 60)) for k in range(m)])
    k = np.arange(m, dtype=np.int64)
    cols = [k // 100, 0 * k, 0 * k, k, 0 * k + 300, k // 2, [x.tobytes() for x in bits]]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["b", "i", "j", "k", "n", "c", "bits"])

    def pairs(find, *parts):
        return {p for b in find(iter(parts)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}

    every, mates = pairs(shingles._pairs, rows), pairs(shingles._mates, rows)
    assert every == {(x, y) for x in range(m) for y in range(x + 1, m) if x // 100 == y // 100 and x // 2 != y // 2}
    assert mates <= every and len(mates) <= m and {x for p in mates for x in p} == set(range(m))
    assert pairs(shingles._pairs, rows[:37], rows[37:150], rows[150:]) == every
    gap = {p: int(np.bitwise_count(bits[p[0]] ^ bits[p[1]]).sum()) for p in every}
    assert all(min(gap[p] for p in mates if x in p) == min(gap[p] for p in every if x in p) for x in range(m))
