import hashlib
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_stages_run_and_keep_columns(spark, documents):
    import corpus_pipeline

    docs = documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        assert 0 < out.count() <= docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns and out.schema.simpleString() == documents.schema.simpleString()
            assert out.filter("n_chars != length(text)").count() == 0
        docs = out
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    for r in docs.select("text", "text_sha256", "decoded_sha256").collect():
        assert r.text_sha256 == r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_stages_bear_clashing_columns_and_nulls(spark, documents):
    import corpus_pipeline

    odd = documents.withColumns({c: F.lit(1) for c in ("ids", "keys", "n_words", "label", "score", "n_lines", "ends", "ent", "component_id", "kept_id", "stat_log_words", "item_ids")})
    extra = spark.createDataFrame([(None, "a null id", None, None, None), (900_001, None, None, None, None), (900_002, "", "en", "s", 0)], documents.schema)
    odd = odd.unionByName(extra, allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert set(odd.columns) <= set(out.columns)
        assert out.count() > 0
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_near_copies_leave_one(spark, documents):
    from sparsewright.llm import ngram_join

    out = ngram_join.stage(spark, documents, SF)
    classes = {r.doc_id: r.component_id for r in ngram_join.NgramJoin(documents).components().collect()}
    kept = sorted(r.doc_id for r in out.select("doc_id").collect())
    assert kept == sorted(set(classes.values()))


def test_only_doubtful_rows_meet_the_join(spark, documents, monkeypatch):
    """The texts that are fetched or joined are those of ids that are asked for, not the table's."""
    from sparsewright.llm import ngram_join
    from sparsewright.llm.sieve import Sieve

    passed, split = [], Sieve.split
    monkeypatch.setattr(Sieve, "split", lambda self, docs, *a: passed.append(split(self, docs, *a)) or passed[-1])
    out = ngram_join.stage(spark, documents, SF)
    lost = documents.count() - out.count()
    assert lost and len(passed) >= 2
    assert passed[-1][0].count() <= lost + documents.count() // 5
    assert passed[-1][1].count() > documents.count() // 2


def test_repeated_rows_leave_one(spark):
    from sparsewright.llm import ngram_join

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a), (7, a), (7, b), (9, a + " more"), (3, b + " rest"), (None, None), (11, ""), (11, "")]
    out = ngram_join.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in out if r.doc_id is not None) == [(3, b + " rest"), (7, a), (7, b), (11, "")]
    assert sum(r.doc_id is None for r in out) == 1


def test_decontamination_leaves_no_window(spark, documents):
    from sparsewright.llm import decontaminate

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = bench.filter("item_id = 0").first().text
    planted = documents.limit(5).withColumn("text", F.concat(F.lit("clean words stand here. "), F.lit(text), F.lit(" and here again.")))
    found = decontaminate.find_spans(planted, bench).collect()
    assert all(r.item_ids for r in found)
    import unittest.mock

    with unittest.mock.patch.object(decontaminate, "MIN_ITEMS", 10**6):
        left = decontaminate.stage(spark, planted, SF).collect()
    assert len(left) == 5
    for r in left:
        assert re.sub(r"\s+", " ", r.text).startswith("clean words stand here.") and r.text.endswith("and here again.")
        assert text not in r.text


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
