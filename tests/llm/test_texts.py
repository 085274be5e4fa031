"""Text operators against brute force: language, quality, tokens, encoding, fingerprints."""

import hashlib
import math
import os
import pathlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import bpe, common, fingerprint, langid, quality, tokencount

TOKENIZERS = pytest.importorskip("tokenizers")
ALPHABET = "aaabbcdeEthTHEinging  \n\t 's're é漢字😀   0123 ,.!?ſ​　\x1c\x85"


def odd_texts(n: int, seed: int = 0) -> list[str]:
    r = random.Random(seed)
    out = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "a " * 300, "ab" * 400, "\n \n  a", "語" * 500]
    for k in range(n):
        t = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60)))
        if k % 5 == 0:
            t = "".join(chr(r.choice([r.randint(32, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(20))
        if k % 7 == 0:
            t = r.choice("aeo =-*") * r.randint(1, 200)
        out.append(t)
    return out


@pytest.fixture(scope="module")
def library():
    return TOKENIZERS.Tokenizer.from_file(bpe.default_path())


def test_bpe_ids_and_decoding_equal_the_library(library):
    e = bpe.encoder(bpe.default_path())
    for t in odd_texts(2000):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids, repr(t)
        assert e.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_bpe_decodes_broken_utf8_like_the_library(library):
    e = bpe.encoder(bpe.default_path())
    ids = library.encode("漢", add_special_tokens=False).ids[:1]
    assert e.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_counts_do_not_depend_on_chunks(library):
    c = tokencount.counter(tokencount.default_path())
    for t in odd_texts(800, 1):
        n = len(library.encode(t, add_special_tokens=False).ids)
        for chunk, overlap in ((7, 2), (20, 3), (1000, 100)):
            assert c.count(t, chunk, overlap) == n, (repr(t), chunk)


def test_huge_text_is_spliced_exactly(library):
    r = random.Random(3)
    t = " ".join("".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 9))) for _ in range(30_000))
    assert tokencount.counter(tokencount.default_path()).count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_forward_sums_all_segmentations():
    path = langid.default_path()
    vocab = {p: i for i, p in enumerate(langid.vocabulary(path))}
    r = np.random.default_rng(0)
    p = r.dirichlet(np.ones(len(vocab)), 2).T.tolist()

    def brute(s, k):
        if not s:
            return 1.0
        total = 0.0 if s[0] in vocab else langid.LETTER * brute(s[1:], k)
        return total + sum(p[vocab[s[:n]]][k] * brute(s[n:], k) for n in range(1, len(s) + 1) if s[:n] in vocab)

    for w in ("the", "thereé", "ß漢a", "ing"):
        got = langid.log_scores(path, w, p, 2)
        assert np.allclose(got, [math.log(brute("▁" + w, k)) for k in (0, 1)])
    words = ["the", "a", "ß漢a", "thereé", "x" * langid.LONG, "ing"]
    batch = langid.Scorer(langid.LanguageModel(["x", "y"], np.array(p))).batch_scores(words)
    assert np.allclose(batch, [langid.log_scores(path, w, p, 2) for w in words])
    long = "there" * 40
    cut, langid.LONG = langid.LONG, 10**6
    try:
        plain = langid.log_scores(path, long[:60], p, 2)
    finally:
        langid.LONG = cut
    assert np.allclose(langid.log_scores(path, long[:60], p, 2), plain)
    assert np.isfinite(langid.log_scores(path, long, p, 2)).all()


def test_language_accuracy_and_learning_boundary(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.identify(docs, rows=200).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", "x"), (3, None, "de", "x"), (4, "123 !!", "en", "x"), (None, "the dog", None, "x"), (1, "the cat and the dog", "en", "x"), (6, "the " * 50_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(df).toPandas()
    assert len(got) == 7
    assert set(got[got.doc_id.isin([3, 4])].lang_pred) == {"und"} and set(got[got.doc_id.isin([3, 4])].score) == {0.0}
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 5
    assert langid.identify(df.limit(0)).count() == 0
    assert set(langid.identify(df.withColumn("lang", df.lang.substr(0, 0))).toPandas().lang_pred) >= {"und"}


def test_letters_are_letters_and_marks():
    assert langid.words_of("½ ① Ⅷ ² 12 _ !") == []
    assert langid.words_of("नमस्ते दुनिया, Straße x²a İ 𝒜b") == ["नमस्ते", "दुनिया", "straße", "x", "a", "i̇", "𝒜b"]
    model = langid.LanguageModel(["de", "es"], np.full((len(langid.vocabulary(langid.default_path())), 2), 1e-4))
    assert langid.Scorer(model).score(["½ ① Ⅷ", None, "", "a"])[:3] == [("und", 0.0)] * 3


def test_pairwise_fit_equals_brute_force():
    """The fit's loss over its pairs, summed one by one, is no higher than at points around it."""
    r = np.random.default_rng(3)
    y = (r.random(60) < 0.7).astype(int)
    f = np.zeros((60, len(quality.FEATURES)))
    f[:, :3] = r.normal(size=(60, 3)) + y[:, None] * 0.5
    m = quality.fit(f, y, pairs=4, seed=1)
    x = (f - m.mean) / m.deviation
    left = np.random.default_rng(1).choice(np.flatnonzero(y == 1), size=((y == 0).sum(), 4)).ravel().tolist()
    right = np.repeat(np.flatnonzero(y == 0), 4).tolist()

    def loss(w):
        total = 0.0
        for a, b in zip(left, right):
            total -= math.log(1 / (1 + math.exp(-sum((x[a][k] - x[b][k]) * w[k] for k in range(len(w))))))
        return total / len(left) + quality.RIDGE / 2 * sum(v * v for v in w)

    best = loss(m.weights)
    assert all(loss(m.weights + r.normal(size=len(m.weights)) * s) >= best for s in (0.001, 0.01, 0.1) for _ in range(20))
    order = sorted(x @ m.weights)
    assert order[(y == 0).sum() - 1] <= m.cut <= order[(y == 0).sum()]


def test_ngrams_by_hand():
    import xxhash

    known = {}
    got = quality.grams("Ab ab C", known)
    words = [xxhash.xxh64_intdigest(w) for w in (b"ab", b"ab", b"c")]
    pairs = [((p * 0x9E3779B97F4A7C15 + q) * 0xBF58476D1CE4E5B9) % 2**64 for p, q in zip(words, words[1:])]
    want = np.zeros(quality.GRAMS)
    for h in words + pairs:
        want[h >> (64 - quality.WORD_BITS)] += 1 / 5
    raw = b"ab ab c"
    for k in range(5):
        t = ((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2_654_435_761) % 2**32
        want[(1 << quality.WORD_BITS) + (t >> (32 - quality.BYTE_BITS))] += 1 / 5
    assert np.allclose(got, np.sqrt(want), atol=1e-6) and not quality.grams(None, known).any()


def test_quality_of_very_long_texts_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here and there " * 40_000), (2, "&&& %%% $$$ !!!")] + [(3, "good plain prose")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 52 and len({r.score for r in got if r.doc_id == 3}) == 1


def test_bradley_terry_ranks_and_cuts():
    r = np.random.default_rng(0)
    y = (r.random(2000) < 0.8).astype(int)
    f = np.zeros((2000, len(quality.FEATURES)))
    f[:, 0] = y * 2 + r.normal(size=2000) * 0.4
    m = quality.fit(f, y)
    s = m.score(f)
    assert ((s >= quality.CUT) == y).mean() > 0.97
    assert abs((s < quality.CUT).mean() - (y == 0).mean()) < 0.01
    # the slope of the pairwise loss is zero at the fit
    x = (f - m.mean) / m.deviation
    left = np.random.default_rng(0).choice(np.flatnonzero(y), size=((y == 0).sum(), quality.PAIRS)).ravel()
    d = x[left] - x[np.repeat(np.flatnonzero(y == 0), quality.PAIRS)]
    slope = d.T @ (1 / (1 + np.exp(d @ m.weights))) / len(d) - quality.RIDGE * m.weights
    assert np.abs(slope).max() < 1e-5


def test_quality_on_the_tables(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.predicted == got.quality).mean() > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "fine words here and there", "a"), (2, "&&& %%% $$$ !!!", "b"), (3, None, "c"), (4, "", "d"), (None, "x", "e"), (1, "fine words here and there", "a")], "doc_id int, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == 6 and got.score.between(0, 1).all()
    assert quality.classify(docs, labels.limit(0)).where("predicted = 1").count() == 6
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_prefix_hashes_answer_spans_and_extensions():
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(40)]
    for a, b in zip(texts, texts[1:]):
        p, q = (fingerprint.Prefixes(fingerprint.code_points(x)) for x in (a, b))
        for _ in range(20):
            i, j = r.randint(0, len(a)), r.randint(0, len(b))
            n = r.randint(0, min(len(a) - i, len(b) - j))
            assert p.equal(i, q, j, n) == (a[i : i + n] == b[j : j + n])
            want = 0
            while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
                want += 1
            assert p.extension(i, q, j) == want


def test_likeness_estimates_shared_spans():
    r = random.Random(1)
    t = "".join(r.choice("abcdefgh ") for _ in range(4000))
    u = t[:3000] + "".join(r.choice("abcdefgh ") for _ in range(1000))
    a, b = fingerprint.fingerprint(t), fingerprint.fingerprint(u)
    spans = lambda x: {x[i : i + fingerprint.SPAN] for i in range(len(x) - fingerprint.SPAN + 1)}
    true = len(spans(t) & spans(u)) / len(spans(t) | spans(u))
    assert abs(fingerprint.likeness_of(a, b) - true) < 0.2
    assert fingerprint.likeness_of(a, a) == 1.0 and fingerprint.likeness_of(a, fingerprint.fingerprint("")) == 0.0


@pytest.mark.parametrize("bucket", [3, 10**6])
def test_fingerprints_of_rows_and_edits(spark, monkeypatch, bucket):
    monkeypatch.setattr(fingerprint, "ROWS_A_BUCKET", bucket)
    r = random.Random(2)
    rows = [(k * 3, "".join(r.choice("abc é漢😀") for _ in range(r.choice([0, 1, 3, 17, 90, 400]))), "z") for k in range(40)] + [(5, None, "z"), (-7, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    got = {x.doc_id: x for x in fingerprint.fingerprints(df).collect()}
    order = sorted(rows)
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        a, b, c = map(fingerprint.fingerprint, (t, edited, nxt))
        assert (got[i].n_chars, got[i].fingerprint, got[i].edited_fingerprint) == (len(t), a, b)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].near_edited, got[i].near_next) == (fingerprint.likeness_of(a, b), fingerprint.likeness_of(a, c))
    assert fingerprint.fingerprints(df.limit(0)).count() == 0


def test_fingerprint_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "abcd" * 9), (1, "xyz" * 30), (1, "xyz" * 30), (2, "q")], "doc_id long, text string")
    got = fingerprint.fingerprints(df).collect()
    assert len(got) == 4
    assert len({x.fingerprint for x in got if x.doc_id == 1}) == 1


def test_fingerprints_of_very_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_A_BUCKET", 20)
    r = random.Random(8)
    rows = [(None, "".join(r.choice("abc") for _ in range(30))) for _ in range(300)] + [(k, "t%d" % k) for k in range(50)] + [(None, "same")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint.fingerprints(df).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.fingerprint) for x in got) == sorted((-1 if i is None else i, fingerprint.fingerprint(t)) for i, t in rows)
    parts = fingerprint.with_next(df).where("ghost = 0").groupBy(F.spark_partition_id()).count().collect()
    assert max(p["count"] for p in parts) < 150
    lone = {x.doc_id: x for x in got if x.doc_id is not None}
    for k in range(49):
        t = "t%d" % k
        assert lone[k].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 4] + "t"[: len(t) // 4]).encode()).hexdigest()


def test_token_operators_on_edge_rows(spark, library):
    rows = [(1, "a b", 1), (None, "<|endoftext|>x", 2), (3, None, 3), (4, "", 4), (1, "a b", 1), (5, "word " * 40_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted((i or 0, len((t or "").encode()), n(t), n(t) > 1024) for i, t, _ in rows)
    assert sorted((x.doc_id or 0, x.n_bytes, x.n_tokens, x.over_limit) for x in tokencount.count_tokens(df).collect()) == want
    trip = bpe.round_trip(df).collect()
    assert sorted(x.n_tokens for x in trip) == sorted(n(t) for _, t, _ in rows)
    assert {x.decoded_sha256 for x in trip if x.doc_id == 5} == {hashlib.sha256(rows[5][1].encode()).hexdigest()}
    back = bpe.decode(bpe.encode(df)).toPandas()
    assert sorted(back.text) == sorted(t or "" for _, t, _ in rows)
    for op in (bpe.round_trip, tokencount.count_tokens):
        assert op(df.limit(0)).count() == 0


def test_language_scoring_stays_in_little_memory():
    """300,000 different words in texts of one worker: scores as those of a fresh worker, words and scores held within bounds."""
    path, draw = langid.default_path(), np.random.default_rng(3)
    p = draw.random((len(langid.vocabulary(path)), 4))
    model = langid.LanguageModel(["a", "b", "c", "d"], p / p.sum(axis=0))
    words = ["".join(map(chr, 97 + draw.integers(0, 26, 8))) for _ in range(300_000)]
    made = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
    score = langid.Scorer(model)
    score.score(["a"])
    batch = pa.record_batch([pa.array(made)], ["text"])
    tracemalloc.start()
    got = [r for group in langid._groups(batch) for r in score.score(group)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6 and score.rows.nbytes < 8e6, most
    assert got[::100] == langid.Scorer(model).score(made[::100])


def test_finished_tasks_give_memory_back(spark):
    """A worker that lives on after a task holds none of the 200 MB that the task has freed."""

    def run(batches):
        for b in batches:
            blocks = [bytes(60_000 + k % 7) for k in range(3500)]
            common._kept = blocks[-1]  # above what is freed, so that the heap can't shrink by itself
            del blocks
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * b.num_rows)], ["pid"])

    pid = common.map_arrow(spark.range(1).coalesce(1), run, "pid long").first()["pid"]
    rollup = pathlib.Path(f"/proc/{pid}/smaps_rollup").read_text()
    assert int(re.search(r"Pss_Anon:\s+(\d+)", rollup)[1]) < 150_000
