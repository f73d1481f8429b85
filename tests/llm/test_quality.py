from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from brightwater.llm import quality
from brightwater.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    counts = (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
    )
    return (*counts, len(words) < 50 or 100 * len(covered) > 50 * len(words))


def checked(df, texts):
    rows = df.collect()
    assert sorted((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in rows if r["doc_id"] is not None) == sorted(
        (d, *brute(t)) for d, t in texts if d is not None
    )
    assert len(rows) == len(texts)
    return rows


def test_counts_equal_brute_force_and_verdicts_fit_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = checked(QUERIES["op5_quality_rules"](spark, data), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(r["kept"] == (not r["base_failed"] and r["p_good"] >= quality.THRESHOLD) for r in rows)

    # the model again, without the labels of a fifth of the documents
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels.where(~held)).collect()}
    truth = [(r["quality"], judged[r["doc_id"]]["kept"], judged[r["doc_id"]]["base_failed"]) for r in labels.where(held).collect()]
    by_model = [(q, k) for q, k, failed in truth if not failed]
    assert sum(q == k for q, k in by_model) / len(by_model) > 0.93
    good = [k for q, k in by_model if q == 1]
    assert sum(good) / len(good) > 0.95


def test_odd_rows(spark):
    texts = [
        (1, None), (2, ""), (3, " \n\n\t"), (4, "a\nb\na\n a\na"), (5, "x y z x y z"), (6, "é\u0085ö|| <>\n" * 60), (7, "\n"),
        (8, "a b c " * 40_000), (8, "a b c"), (None, "x"), (9, "last line\n\nlast line"), (10, "a\r\na\na"),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").select("*", F.lit(1).alias("quality"), F.lit(2).alias("kept"))
    nothing = spark.createDataFrame([(1, None, "x"), (None, 1, "x"), (2, 7, "x")], "doc_id bigint, quality int, text string")
    rows = checked(quality.judge(docs, nothing), texts)
    assert all(r["p_good"] is None and r["kept"] == (not r["base_failed"]) for r in rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] * 2, "doc_id bigint, quality int")
    assert all(0 <= r["p_good"] <= 1 for r in checked(quality.judge(docs, labels), texts))
    kept = quality.keep_good(docs, nothing)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute(t)[5] for _, t in texts)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.judge(docs, labels).collect() == []
    assert quality.keep_good(docs, labels).collect() == []
