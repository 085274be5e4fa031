"""Sharding, near-duplicates, repeats, vectors and packing against brute force, with edge rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import packing, sharding, simhash, substring, vectors


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = sharding.permute(spark.range(n), "id", n, seed=3).toPandas()
    assert sorted(got.position) == list(range(n))
    if n >= 97:
        assert (got.position == got.id).mean() < 0.2


def test_shards_are_even_gapless_and_independent_of_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sharding.shard(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    again = sharding.shard(docs.repartition(7).withColumn("row_no", F.lit(1))).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(again)
    sizes = got.groupby("shard").size()
    assert set(got["shard"]) <= set(range(40)) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    texts = docs.select("doc_id", "text").toPandas().sort_values("doc_id").text
    assert got["size"].tolist() == [len(t.encode()) + 16 for t in texts] and got.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in texts]
    assert set(got.law) == {"rows"}


def rectangle(n: int) -> tuple[int, int]:
    """The least rectangle over n that permute() walks in."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    return a, b


def test_permutation_equals_a_plain_feistel_walk(spark):
    n, seed = 97, 5
    a, b = rectangle(n)
    hashes = {(r.i, r.r): r.h for r in spark.range(sharding.ROUNDS).selectExpr("cast(id as int) as i").crossJoin(spark.range(max(a, b)).selectExpr("id as r")).select("i", "r", F.xxhash64(F.lit(seed), "i", "r").alias("h")).collect()}

    def once(x):
        left, right = x % a, x // a
        for i in range(sharding.ROUNDS):
            m = a if i % 2 == 0 else b
            left, right = right, (left + hashes[i, right] % m) % m
        return left + right * a

    want = []
    for x in range(n):
        y = once(x)
        while y >= n:
            y = once(y)
        want.append(y)
    got = sharding.permute(spark.range(n), "id", n, seed=seed).orderBy("id").toPandas()
    assert got.position.tolist() == want


def test_rows_are_numbered_as_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    rows = [(k % 5, "abc"[k % 3]) for k in range(40)] + [(None, None)] * 30 + [(9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, t string")
    hashed = df.select("doc_id", "t", F.xxhash64("doc_id", "t").alias("h")).collect()
    n = len(rows)
    buckets = -(-n // 10)
    want = sorted(((r.h & (2**64 - 1)) >> 20) % buckets for r in hashed), sorted((((r.h & (2**64 - 1)) >> 20) % buckets, r.h, r.doc_id if r.doc_id is not None else -1, r.t or "") for r in hashed)
    got = sorted((r.row_no, r.doc_id if r.doc_id is not None else -1, r.t or "") for r in sharding.numbered(df.repartition(3), n, bucket_rows=10).collect())
    assert [g[0] for g in got] == list(range(n)) and [g[1:] for g in got] == [w[2:] for w in want[1]]


def test_shard_edges(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (1, "a"), (1, "a"), (2, "")], "doc_id long, text string")
    got = sharding.shard(df, shards=3).collect()
    assert sorted(r.slot * 3 + r.shard for r in got) == list(range(5))
    assert sharding.shard(df.limit(0)).count() == 0


def test_covering_meets_every_close_pair():
    r = random.Random(0)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << bit
        i, key = simhash.anchors_of(np.array([a, b], np.uint64))
        assert set(key[i == 0]) & set(key[i == 1])


def test_fingerprint_by_hand():
    import xxhash

    words = "The quick BROWN fox\tjumps Over É the".encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint("The quick BROWN fox\tjumps Over É the") == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("tile", [5, 4096])
def test_linked_fingerprints_are_all_connected(spark, tile):
    r = random.Random(1)
    fps = set()
    for _ in range(60):  # clouds of close ones
        c = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 3, 12])):
            fps.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.similar_fingerprints(df, 4, tile).collect()
    want = components(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4])
    assert components(signed, [(e.u, e.v) for e in edges]) == want


def test_simhash_groups_and_edges(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.lit(1).alias("fp"), F.lit(2).alias("component"))
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, " "), (9004, "a"), (9004, "a")], "doc_id long, text string")
    df = docs.unionByName(extra, allowMissingColumns=True)
    got = simhash.near_duplicates(df).toPandas()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fp = {i: simhash.fingerprint(t) for i, t in rows}
    want = components(fp, [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4])
    assert len(got) == len(rows)
    assert all(want[r.doc_id] == r.component_id and int(r.fingerprint, 16) == fp[r.doc_id] and len(r.fingerprint) == 16 for r in got.itertuples())
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and kept.count() < df.count()
    lone = simhash.near_duplicates(extra.select(F.lit(None).cast("long").alias("doc_id"), "text")).collect()
    assert len(lone) == 5 and {r.component_id for r in lone} == {None}


def test_near_copies_are_caught_and_others_left(spark):
    r = random.Random(4)
    make = lambda: ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(250)]
    rows, family = [], {}
    for k in range(30):
        words = make()
        rows.append((10 * k, " ".join(words)))
        for c in range(3):
            w = list(words)
            for at in r.sample(range(250), 3):
                w[at] = "changed" + str(r.random())[2:6]
            rows.append((10 * k + c + 1, " ".join(w)))
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.component_id // 10 == x.doc_id // 10 for x in got)
    assert sum(x.doc_id != x.component_id for x in got) >= 88


def brute_repeats(rows, window=50):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i if i is not None else -1, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats_equal_brute_force(spark, batches):
    r = random.Random(7)
    vocab = ["w%d" % k for k in range(300)]
    passage = [[r.choice(vocab) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for k in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [r.choice(vocab) for _ in range(r.randint(0, 90))] + r.choice(passage)
        rows.append((k * 2 % 61, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "same " * 200), (205, "same " * 70), (None, rows[3][1]), (3, rows[1][1])]
    rows.append(rows[5])  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("version", F.lit("x")).repartition(3)
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_words, x.n_removed, x.kept_sha256) for x in substring.remove_repeats(df, batches=batches).collect())
    assert got == brute_repeats(rows)
    kept = substring.keep_texts(df, batches=batches)
    assert kept.columns == df.columns
    want = sorted(s for _, n, g, s in brute_repeats(rows) if g < n or n == 0)
    assert sorted(hashlib.sha256(b" ".join((x.text or "").encode().split())).hexdigest() for x in kept.collect()) == want


def test_repeats_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(df).count() == 0 and substring.keep_texts(df).count() == 0


def test_index_compacts_to_the_same_rows(spark, tmp_path):
    index = substring.WindowIndex(spark, str(tmp_path / "index"), max_runs=2)
    for k in range(4):
        ids = spark.range(k * 10, k * 10 + 10)
        index.append(ids.select(F.col("id").alias("mark"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("version")), ids.select(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"), F.col("id").alias("first")))
    assert index.compactions == 1 and len(index.runs["marks"]) <= 2 and sorted(r.mark for r in index.read().collect()) == list(range(40))
    again = substring.WindowIndex(spark, str(tmp_path / "index"))
    assert again.runs == index.runs and again.version == index.version
    index.compact()
    assert [tuple(r) for r in index.read("windows").collect()] == [(1, 2, 0)]
    index.drop()
    assert substring.WindowIndex(spark, str(tmp_path / "index")).read() is None


def test_batches_against_a_reopened_index_equal_brute_force(spark, tmp_path):
    r = random.Random(9)
    vocab = ["w%d" % k for k in range(300)]
    passage = [[r.choice(vocab) for _ in range(n)] for n in (50, 60, 120)]
    rows = []
    for k in range(80):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [r.choice(vocab) for _ in range(r.randint(0, 70))] + r.choice(passage)
        rows.append((k, " ".join(w)))
    rows += [(80, rows[3][1]), (81, None), (None, rows[4][1])]
    path, got = str(tmp_path / "index"), []
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    for lo in range(0, len(rows), 14):
        index = substring.WindowIndex(spark, path, max_runs=2)  # opened anew each time
        out = substring.remove_repeats_from(index, frame(rows[lo : lo + 14]), frame(rows[:lo]))
        got += [(x.doc_id if x.doc_id is not None else -1, x.n_words, x.n_removed, x.kept_sha256) for x in out.collect()]
    assert index.version > 6 and len(index.runs["marks"]) <= 2
    assert sorted(got) == brute_repeats(rows)


def test_query_compacts_and_writes_no_run_unread(spark, monkeypatch):
    made, read = [], []
    monkeypatch.setattr(substring.WindowIndex, "append", lambda self, *a, f=substring.WindowIndex.append: (made.append(1), f(self, *a))[1])
    monkeypatch.setattr(substring.WindowIndex, "compact", lambda self, f=substring.WindowIndex.compact: (read.append(1), f(self))[1])
    rows = [(k, " ".join(f"w{k % 7}-{j}" for j in range(60))) for k in range(50)]
    substring.remove_repeats(spark.createDataFrame([(k, t + f" x{k}") for k, t in rows], "doc_id long, text string"))
    assert len(made) == substring.BATCHES - 1 > substring.MAX_RUNS and read


def test_bounds_never_lose_a_pair():
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 64))
    x = np.concatenate([base + r.normal(size=base.shape) * s for s in (0.0, 0.1, 0.14, 0.2, 0.3)])
    got = {(int(a), int(b)) for i, j in vectors.close_pairs(x, x, 0.98, step=37) for a, b in zip(i, j)}
    n = np.linalg.norm(x, axis=1)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero((x @ x.T) / np.outer(n, n) >= 0.98))}
    assert got == want or all(abs((x[a] @ x[b]) / (n[a] * n[b]) - 0.98) < 1e-12 for a, b in got ^ want)


@pytest.mark.parametrize("tile", [7, 2048])
def test_vectors_equal_brute_force(spark, tile):
    r = np.random.default_rng(1)
    base = r.normal(size=(12, 8))
    rows = []
    for k in range(120):
        v = (base[r.integers(12)] + r.normal(size=8) * r.choice([0.0, 0.05, 0.2])).astype(np.float32)
        rows.append((k, int(r.integers(3)), [float(z) for z in v]))
    nan, inf = float("nan"), float("inf")
    rows += [(500, 1, None), (501, 1, [0.0] * 8), (502, 1, [nan] * 8), (503, 1, [inf] * 8), (504, None, rows[0][2]), (505, 1, []), (506, 1, [1.0, 2.0]), (507, 1, [2.0, 4.0]), (508, 1, [None] * 8), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rep", F.lit(0))
    good = [(i, lab, np.array(v, float)) for i, lab, v in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.98]
    want = components([r[0] for r in rows if r[0] is not None], pairs)
    for x in vectors.near_duplicates(df, tile=tile).collect():
        if x.vec_id is None:
            assert x.n_links == 0 and x.component_id is None
            continue
        assert (x.n_links, x.component_id, x.kept) == (sum(x.vec_id in p for p in pairs), want[x.vec_id], want[x.vec_id] == x.vec_id)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_a_vec_id_at_several_vectors_is_several_rows(spark):
    u, v, w = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    rows = [(1, 0, u), (1, 1, v), (2, 0, u), (2, 1, v), (3, 1, v), (4, 0, w), (5, 2, u), (5, 2, u), (1, 0, v)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect())
    # (1, 0, u) with 2 and 4; (1, 1, v) with 2 and 3; (5, 2, u) with its copy; (1, 0, v) alone
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (4, 2, 1, False), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (5, 1, 5, True), (5, 1, 5, True), (1, 0, 1, True)])


def test_best_fit_takes_the_tightest_compatible_bin():
    r = random.Random(0)
    items = [(r.randint(0, 100), r.choice(["a", "b", "c", "d", None]), r.choice([1, 2, 3, None])) for _ in range(300)]
    got = packing.pack_pool(items, 100)
    bins, want = [], {}
    for i in sorted(range(300), key=lambda i: -items[i][0]):
        size, s, c = items[i]
        fits = [(100 - sum(items[j][0] for j in b), k) for k, b in enumerate(bins) if 100 - sum(items[j][0] for j in b) >= size and all((s is None or items[j][1] != s) and (c is None or items[j][2] != c) for j in b)]
        fits = [f for f in fits if f[0] > 0]
        if fits:
            room, k = min(fits)
        else:
            room, k = 100, len(bins)
            bins.append([])
        want[i] = (k, 100 - room)
        bins[k].append(i)
    assert got == [want[i] for i in range(300)]


def test_packing_rules_and_edges(spark):
    rows = [(k, "x" * n, f"s{k % 3}") for k, n in enumerate([0, 5, 100, 101, 250, 40, 40, 60, 200])] + [(20, None, None), (None, "abc", "s0"), (2, "x" * 100, "s2"), (2, "x" * 100, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("pool", F.lit(1))
    got = packing.pack(df, capacity=100, pool_rows=6).toPandas()
    assert got.groupby("bin_id")["size"].sum().max() <= 100
    whole = got.groupby("doc_id", dropna=False)["size"].sum()
    assert whole[4] == 250 and whole[3] == 101 and whole[2] == 300 and len(got[got.doc_id == 4]) == 3
    part = got[got["size"] < 100]
    assert not part.dropna(subset=["source"]).duplicated(["bin_id", "source"]).any()
    assert not part.dropna(subset=["cluster"]).duplicated(["bin_id", "cluster"]).any()
    spans = sorted((r.bin_id, r.bin_offset, r.bin_offset + r.size) for r in got.itertuples() if r.size)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert packing.pack(df.limit(0)).count() == 0
