from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from brightwater.llm import quality
from test_decontamination import brute as brute_leaks
from test_secret_scan import masked as brute_masked
from test_shingle_groups import brute_groups

DATA = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_chain_and_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "source_mixing"]

    good = corpus_pipeline.write_shared(stages["quality_rules"](spark, docs, DATA), "t")
    verdict = {r["doc_id"] for r in quality.judge(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect() if r["kept"]}
    assert rows_of(good) == rows_of(docs.where(F.col("doc_id").isin(list(verdict))))

    single = corpus_pipeline.write_shared(stages["simhash_near_dedup"](spark, good, DATA), "t")
    read = [(r["doc_id"], r["text"]) for r in good.collect()]
    first = [min(read[k][0] for k in group) for group in brute_groups(read)]
    assert rows_of(single) == rows_of(good.where(F.col("doc_id").isin(first)))
    assert single.count() < good.count()

    clean = corpus_pipeline.write_shared(stages["benchmark_decontamination"](spark, single, DATA), "t")
    leaking = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in single.collect()], items)}
    assert leaking and rows_of(clean) == rows_of(single.where(~F.col("doc_id").isin(list(leaking))))

    masked = corpus_pipeline.write_shared(stages["secret_scan"](spark, clean, DATA), "t")
    expected = [(r["doc_id"], brute_masked(r["text"]), r["lang"], r["source"], len(brute_masked(r["text"]))) for r in clean.collect()]
    assert rows_of(masked) == sorted(expected, key=str)
    for stage in (good, single, clean, masked):
        assert stage.dtypes == docs.dtypes

    assert rows_of(corpus_pipeline.run(spark, DATA)) == rows_of(stages["source_mixing"](spark, masked, DATA))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_through_all_stages(spark, tmp_path, empty):
    long = " ".join(f"word{i % 900} and{i}" for i in range(20_000))
    text = " ".join(f"w{i}" for i in range(80))
    alone = " ".join(f"v{i}" for i in range(90))
    rows = [
        (1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text + " more", None, None, None), (None, alone, None, None, None), (None, alone, None, None, None), (None, None, None, None, None),
        (2, "", "en", "b", 0), (3, long, None, "b", 9), (4, long + " secret=abcdefgh123", "de", None, 5), (5, text.upper(), "en", "a", 3),
        (1, long + " a different text of one id", "en", "a", 1),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([] if empty else rows, schema).withColumn("fp", F.lit("x")).withColumn("row_key", F.lit(1)).withColumn("rank", F.lit(2))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_shared(stage(spark, docs, str(tmp_path)), "t")
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "simhash_near_dedup" and not empty:
            # one of the short texts, one of the long ones, and the text of null ids alone
            assert sorted((r["doc_id"], r["text"][:2]) for r in docs.collect() if r["doc_id"]) == [(1, "w0"), (1, "wo")]
            assert [r["text"] for r in docs.collect() if r["doc_id"] is None] == [alone]
    assert docs.count() == (0 if empty else 3)
