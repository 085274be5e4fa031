"""The pipeline, stage by stage, against what each operator says and brute force."""

import hashlib

import pytest

import corpus_pipeline as P
from trackloom.llm import langid, packing, quality
from trackloom.llm.common import table

from .test_shingles import brute
from .test_tables import brute_repeats


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = table(spark, small, "documents"), []
    for name, f in P.STAGES:
        done = f(spark, docs, small).cache()
        out.append((name, docs, done))
        docs = done
    return {name: (a, b) for name, a, b in out}


def test_columns_and_names(spark, small, stages):
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_duplicates", "substrings", "packing"]
    for name, (a, b) in stages.items():
        assert name == "packing" or b.columns == a.columns


def test_filters_take_the_operators_decisions(spark, small, stages):
    a, b = stages["quality"]
    want = {r.doc_id for r in quality.classify(a, table(spark, small, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in b.collect()} == want and len(want) < a.count()
    a, b = stages["language"]
    want = {r.doc_id for r in langid.identify(a).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r.doc_id for r in b.collect()} == want


def test_one_of_each_group_stays(stages):
    """Groups of links at 0.8 or more of five-word shingles, by brute force."""
    a, b = stages["near_duplicates"]
    root = brute([(r.doc_id, r.text) for r in a.collect()])
    assert {r.doc_id for r in b.collect()} == {i for i in root if root[i] == i}


def test_repeats_go_from_texts(stages):
    a, b = stages["substrings"]
    want = sorted((i, s) for i, n, g, s in brute_repeats([(r.doc_id, r.text) for r in a.collect()]) if g < n or n == 0)
    assert sorted((r.doc_id, hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()) for r in b.collect()) == want


def test_all_that_is_kept_is_packed_and_run_agrees(spark, small, stages):
    a, b = stages["packing"]
    sizes = {r.doc_id: len(r.text.encode()) for r in a.collect()}
    got = b.toPandas()
    assert got.groupby("doc_id")["size"].sum().to_dict() == sizes
    assert got.groupby("bin_id")["size"].sum().max() <= packing.CAPACITY
    whole = P.run(spark, small).toPandas()
    key = ["doc_id", "piece"]
    assert whole.sort_values(key).reset_index(drop=True).equals(got.sort_values(key).reset_index(drop=True))


def test_empty_documents_pass_through(spark, small):
    docs = table(spark, small, "documents").limit(0)
    for _, f in P.STAGES:
        docs = f(spark, docs, small)
    assert docs.count() == 0


def test_edge_rows_pass_all_stages(spark, small):
    """Null ids, null, empty and very long texts, repeated rows and columns named like the operators' own."""
    docs = table(spark, small, "documents")
    fine = [r.text for r in docs.where("n_chars > 300").orderBy("doc_id").limit(3).collect()]
    long = " ".join(fine * 300)
    rows = [(None, fine[0], "en", "a", 1), (None, None, None, None, None), (900001, None, "en", "b", 0), (900002, "", "en", "b", 0), (900003, long, "en", None, len(long)), (900004, fine[1], "en", "c", 1), (900004, fine[1], "en", "c", 1)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    start = docs.unionByName(extra).withColumn("version", docs.doc_id).withColumn("k", docs.doc_id).withColumn("_gone", docs.doc_id)
    done = start
    for name, f in P.STAGES:
        before, done = done, f(spark, done, small).cache()
        assert name == "packing" or done.columns == start.columns
    kept = before.collect()
    assert sum(r.doc_id is None for r in kept) <= 2 and all(r.doc_id != 900001 for r in kept)
    sizes = sorted(len((r.text or "").encode()) for r in kept)
    got = done.groupBy("doc_id", "source").agg({"size": "sum"}).collect()
    assert sum(r["sum(size)"] for r in got) == sum(sizes)
