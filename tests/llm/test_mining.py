"""License scans, collocations and hard negatives against brute force and hand-worked cases, with edge rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trackloom.llm import collocations, licenses, negatives, queries

LONG_TEXT = " ".join(f"word{i % 977}" for i in range(200_000))


# licenses

def test_matching_statistics_and_places_equal_brute_force():
    rng = random.Random(1)
    sequences = [[rng.randrange(3) for _ in range(n)] for n in (1, 2, 7, 19, 40)] + [[0, 0, 0], [0, 0, 0]]
    a = licenses.Automaton(sequences)
    text = [rng.randrange(4) for _ in range(400)]
    state = matched = 0
    for i, word in enumerate(text):
        state, matched = a.step(state, matched, word)
        want = max((n for n in range(41) if n <= i + 1 and any(s[k : k + n] == text[i + 1 - n : i + 1] for s in sequences for k in range(len(s) - n + 1))), default=0)
        assert matched == want
        if matched:
            part = text[i + 1 - matched : i + 1]
            assert sorted(a.places(state)) == [(k, e) for k, s in enumerate(sequences) for e in range(matched, len(s) + 1) if s[e - matched : e] == part]


def base_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({label for _, label in at}))


def notice(label, n):
    return [t for k, t in licenses.TEMPLATES if k == label][n]


CASES = [
    ("mit", "Copyright someone\n" + notice("mit", 2) + "\nhello"),
    ("gpl,lgpl", "// " + notice("lgpl", 1).replace(" ", "\n// ")),  # the base phrase is part of the lesser licence's name
    ("agpl,gpl", notice("agpl", 1)),
    ("apache", notice("apache", 2)),
    ("bsd", notice("bsd", 0).replace("following disclaimer", "following long and changed disclaimer")),
    ("cc-by-nc", "x. Licensed under CC BY-NC 4.0. y"),
    ("isc", notice("isc", 0).upper()),
    ("", "Permission is hereby granted, free of charge, to any person"),  # a seventh of its template
    ("", "under the terms of the GNU"),
    ("apache,gpl,mit", "Apache License, MIT license and the General-Public License"),
    ("mit", "mit license " * 3 + LONG_TEXT + " MIT License"),
    ("", LONG_TEXT), ("", ""), ("", None), ("", "Ünïcode ßtraße 123 …"),
]


def test_labels_by_hand_and_base_columns(spark):
    rows = [(i, text, "x", i) for i, (_, text) in enumerate(CASES)] + [(1, CASES[1][1], "x", 0), (None, "the MIT License", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int")
    got = sorted(licenses.scan(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    want = [CASES[0], CASES[1], CASES[1], *CASES[2:], ("mit", "the MIT License")]
    for r, (labels, text) in zip(got, want):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(text)
        assert r.labels == labels and set(filter(None, r.base_labels.split(","))) <= set(labels.split(","))
        assert (r.score == 1.0) if r.n_base else 0 <= r.score <= 1
    assert 0 < [r for r in got if r.doc_id == 7][0].score < 0.5
    assert licenses.scan(docs.limit(0)).count() == 0


def test_spans_are_where_the_notice_stands(spark):
    words = "a b c d e f g h".split()
    text = " ".join([*words[:4], "z", *words[4:]])
    s = licenses._scanner((("q r", "q"),), (("one", " ".join(words)), ("two", "c d e f")), 3, 4)
    n, places, spans = s.scan("x y " + text + " " + " ".join("z" * 40) + " a b c d")
    assert (n, places) == (55, [])
    assert spans == [(1, 2, 9, 8, 1.0), (1, 51, 4, 4, 0.5)]
    rows = licenses.license_spans(spark.createDataFrame([(1, "a b c d")], "doc_id int, text string"), templates=(("one", "a b c d"),)).collect()
    assert [(x.label, x.template, x.first_word, x.n_words, x.covered, x.share) for x in rows[0].spans] == [("one", 0, 0, 4, 4, 1.0)]


def test_license_query_equals_brute_force_on_its_table(spark, small):
    got = {r.doc_id: r for r in queries.op11_licenses(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(d.text)


# collocations

def phrases_of(rows, least, longest=4, cover=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, counts in f.items():
        for g, a in counts.items():
            if len(g) < 2 or a < least:
                continue
            if any(len(q) > len(g) and 100 * b >= cover * a and any(q[i : i + len(g)] == g for i in range(len(q))) and b >= least for q, b in counts.items()):
                continue
            score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            out[lang, " ".join(g)] = (a, counts[g[:k]], counts[g[k:]], n[lang], score)
    return out


@pytest.mark.parametrize("block_words", [1, 50, 1 << 21])
def test_phrases_equal_brute_force_for_any_block_size(spark, block_words):
    rng = random.Random(block_words)
    words = ["a", "B", "b", "ö", "Ö", "x-y", "\xa0", "z\x00", "'", " "]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", "!"]) for _ in range(rng.randrange(40)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), ("fr", " .,\n "), ("en", "a b a b a b a b"), ("en", "a b a b a b a b"), ("en", "q " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int").repartition(3)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.phrases(docs, least=3, block_words=block_words).collect()}
    assert got == phrases_of(rows, 3) and len(got) > 50


def test_collocations_rank_by_score_count_and_bytes(spark):
    rows = [("en", "a b. c d. c d. e f é f. e f é f. z z")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = sorted(((p, *v) for (_, p), v in phrases_of(rows, 2).items()), key=lambda x: (-x[5], -x[1], x[0].encode()))
    got = [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, least=2, top=4, parts=3).orderBy("rank").collect()]
    assert got == want[:4]
    assert collocations.collocations(docs.limit(0)).count() == 0
    none = collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string"))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_are_exact_beyond_64_bits(spark):
    a, p = 4_611_686_018_427_387_903, 9_223_372_036_854_775_806
    got = spark.range(1).select(collocations._floor(2_000_000, collocations.F.lit(a), collocations.F.lit(p)).alias("s"), collocations._floor(2_000_000, collocations.F.lit(a - 1), collocations.F.lit(p)).alias("t")).first()
    assert tuple(got) == (2_000_000 * a // p, 2_000_000 * (a - 1) // p)


# hard negatives

def mined(rows, every=5):
    v = sorted({(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in e)) for i, label, e in rows
                if None not in (i, label, e) and all(x is not None and math.isfinite(x) for x in e)})
    out = []
    for a in v:
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in v if len(b[2]) == len(a[2])]
        for ps, pid, _ in sorted(s for s in scored if s[2] == a[1] and s[1] != a[0])[:5]:
            inside = sorted(s for s in scored if s[2] != a[1] and -50 * ps <= -100 * s[0] <= -95 * ps)[:3]
            out += [(a[0], pid, k, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(inside, 1)]
    return sorted(out)


def hard(spark, rows, **how):
    F = collocations.F
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<double>, rank int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, label, **how).collect()))


@pytest.mark.parametrize("block,tile", [(1024, 8192), (7, 40)])
def test_negatives_equal_brute_force_on_clusters_ties_and_edges(spark, block, tile):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 12))
    rows = [(i, int(rng.integers(4)), (centres[i % 4] + 0.4 * rng.normal(size=12)).round(2).tolist()) for i in range(160)]
    rows += [(i, 1, rows[3][2]) for i in range(200, 215)] + rows[:10]  # copies of a vector, repeated rows
    rows += [(300, 1, None), (305, None, rows[0][2]), (None, 1, rows[0][2]), (310, 1, [float("nan")] + [0.0] * 11), (315, 2, [float("inf")] * 12), (320, 2, [0.1, None] * 6)]
    rows += [(325, 1, [0.0] * 12), (330, 1, []), (335, 2, []), (340, 1, [0.5] * 3), (341, 1, [0.4] * 3), (342, 2, [0.3] * 3), (0, 1, rows[9][2])]
    rows += [(345, 3, [1e18] * 2), (346, 3, [1e18, 1.0]), (347, 2, [1e-3, -1.0])]
    want = [r for r in mined(rows) if abs(r[4]) < 2**63]
    got = [r for r in hard(spark, rows, block=block, tile=tile) if r[4] < 2**63 - 1]
    assert got == want and len(want) > 300


def test_negatives_of_no_rows(spark):
    assert hard(spark, []) == [] and hard(spark, [(5, 1, [1.0])]) == []


def test_bounds_drop_no_pair_and_drop_most(spark):
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(3, 64))[rng.integers(3, size=900)] + 0.1 * rng.normal(size=(900, 64))))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :64]
    a = negatives.Side.of(np.arange(900), np.zeros(900, int), x, axes)
    exact = x[:50] @ x.T
    low = np.sort(exact, axis=1)[:, -20].astype(float)
    for turned in (axes, np.ascontiguousarray(axes[:, :8]), None):
        b = negatives.Side.of(np.arange(900), np.zeros(900, int), x, turned)
        i, j = negatives.survivors(b.pick(slice(0, 50)), b, low, np.full(50, np.inf), np.ones((50, 900), bool))
        kept = np.zeros((50, 900), bool)
        kept[i, j] = True
        assert kept[exact >= low[:, None]].all()
    i, _ = negatives.survivors(a.pick(slice(0, 50)), a, low, np.full(50, np.inf), np.ones((50, 900), bool))
    assert len(i) < 50 * 900 / 20


def test_pairs_are_counted_as_packed_arrays(spark):
    """A block's pairs are sent in fewer than 10 bytes each, and come back counted, named by their least place."""
    r = np.random.default_rng(5)
    rows, want = [], {}
    for block in (3, 5, 9, 1 << 20):
        both = np.unique(r.integers(0, 300, (20000, 2)), axis=0)
        names = (r.permutation(300) % 7 << collocations.SLOT_BITS) + 7 * np.arange(300)
        names = np.sort(names) if block == 9 else np.arange(300) * 1000 + (11 << collocations.SLOT_BITS)
        left, right, c = names[both[:, 0]], names[both[:, 1]], r.integers(1, 6, len(both))
        rows.append((block, left.tolist(), right.tolist(), c.tolist()))
        for slot, (a, b, n) in enumerate(zip(*rows[-1][1:])):
            want.setdefault((a, b), []).append(((block << collocations.SLOT_BITS) + slot, n))
    frame = spark.createDataFrame(rows, "block long, left array<long>, right array<long>, c array<int>")
    for groups in (1, 13):
        got = collocations._counted(frame, groups, 7).collect()
        expected = {own: min(x for x, _ in places) for places in want.values() if sum(n for _, n in places) >= 7 for own, _ in places}
        assert {x.own: x.id for x in got} == expected and len(got) == len(expected)
        heads = {(x.left, x.right): (x.id, x.f) for x in got if x.own == x.id}
        assert heads == {k: (min(x for x, _ in v), sum(n for _, n in v)) for k, v in want.items() if sum(n for _, n in v) >= 7}
    block, left, right, c = rows[0]
    columns = [np.array(left), np.array(right), np.array(c, np.int32), np.diff(np.arange(len(c)), prepend=0).astype(np.int32)]
    sent = collocations._squeezed(columns)
    assert len(sent) < 10 * len(c)
    assert all(np.array_equal(x, y) for x, y in zip(collocations._restored(sent, len(c), "i8", "i8", "i4", "i4"), columns))


def test_names_go_back_as_packed_arrays(spark):
    """Packed, a group gives a block's places as one row of few bytes, and its names as one row; both say what the rows say."""
    r = np.random.default_rng(6)
    rows = []
    for block in (3, 5, 1 << 20):
        both = np.unique(r.integers(0, 300, (20000, 2)), axis=0)
        left, right = ((both[:, k] * 1000 + (2 << collocations.SLOT_BITS)).tolist() for k in (0, 1))
        rows.append((block, left, right, r.integers(1, 6, len(both)).tolist()))
    frame = spark.createDataFrame(rows, "block long, left array<long>, right array<long>, c array<int>")
    plain = collocations._counted(frame, 4, 7).collect()
    got = collocations._counted(frame, 4, 7, packed=True).collect()
    places, names = [x for x in got if x.block is not None], [x for x in got if x.block is None]
    assert len(places) == 12 and len(names) == 4 and len(plain) > 8_000
    found = {}
    for x in places:
        step, name = collocations._restored(x.data, x.n, "i4", "i8")
        found |= zip(((x.block << collocations.SLOT_BITS) + np.cumsum(step)).tolist(), name.tolist())
    assert found == {x.own: x.id for x in plain} and sum(len(x.data) for x in places) < 9 * len(plain)
    assert {y for x in names for y in zip(x.id, x.f, x.left, x.right)} == {(x.id, x.f, x.left, x.right) for x in plain if x.own == x.id}
    last = collocations._counted(frame, 4, 7, packed=True, places=False).collect()
    assert sorted(last) == sorted(names) and collocations._counted(frame, 4, 10**6, packed=True).count() == 0
