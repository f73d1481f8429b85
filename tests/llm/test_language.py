from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brightwater.llm import language
from brightwater.llm.queries import QUERIES


def brute_phrases(sample, text, stretch=256):
    """Greedy longest matches found by substring search."""
    codes = "".join(c.lower() if c.isalpha() else " " for c in text)
    squeeze = lambda s: "".join(c for i, c in enumerate(s) if c != " " or i == 0 or s[i - 1] != " ")
    known = squeeze("".join(c.lower() if c.isalpha() else " " for c in " ".join(sample)))
    codes, n = squeeze(codes), 0
    for low in range(0, len(codes), stretch):
        part, begin = codes[low : low + stretch], 0
        n += 1
        for i in range(len(part)):
            if part[begin : i + 1] not in known:
                n += 1
                begin = i if part[i] in known else i + 1
    return n


def test_phrases_equal_substring_search():
    draw = random.Random(1)
    samples = {k: ["".join(draw.choice(letters) for _ in range(200)) for _ in range(3)] for k, letters in {"a": "abc d", "b": "abé  ", "c": "cdx.."}.items()}
    texts = ["".join(draw.choice("abcdxéZ .É") for _ in range(draw.choice([0, 1, 5, 255, 256, 257, 900]))) for _ in range(60)] + ["...", "", "ß"]
    model = language.fit(samples)
    counts, has_letter = language.phrases(model, pa.array(texts, pa.large_string()))
    for d, text in enumerate(texts):
        assert has_letter[d] == any(c.isalpha() for c in text)
        for k, name in enumerate(model.languages):
            assert counts[d, k] == brute_phrases(samples[name], text), (text, name)


def test_model_grows_with_edges_and_not_with_letters():
    draw = random.Random(2)
    few = {"a": ["".join(draw.choice("abcdefghij ") for _ in range(30_000))]}
    many = {"a": ["".join(chr(0x4E00 + draw.randrange(5_000)) for _ in range(30_000))], "b": few["a"]}
    assert language.fit(few).bytes() - language.fit({}).bytes() <= 72 * 30_000
    model = language.fit(many)
    assert model.width > 4_900
    assert model.bytes() - language.fit({}).bytes() <= 72 * 60_000
    texts = [many["a"][0][100:400], many["b"][0][5_000:5_300], "".join(chr(0x4E00 + draw.randrange(6_000)) for _ in range(700))]
    counts, _ = language.phrases(model, pa.array(texts, pa.large_string()))
    for d, text in enumerate(texts):
        assert list(counts[d]) == [brute_phrases(many[name], text) for name in model.languages]


def test_edges_are_found_and_others_not():
    draw = random.Random(5)
    keys = np.array(sorted({draw.randrange(1 << 20) for _ in range(20_000)}), np.int64)
    table = language.Edges.of(keys, np.arange(len(keys), dtype=np.int32))
    place = {k: i for i, k in enumerate(keys.tolist())}
    assert table.find(np.arange(1 << 20)).tolist() == [place.get(k, -1) for k in range(1 << 20)]
    assert language.Edges.of(keys[:0], np.zeros(0, np.int32)).find(keys[:3]).tolist() == [-1] * 3


def test_rows_of_edges_overlap():
    draw = random.Random(6)
    for letters, size in ((30, 12), (500, 17), (5_000, 17)):
        codes = [min(letters - 1, int(draw.paretovariate(0.6))) if letters == 30 else draw.randrange(letters) for _ in range(5_000)]
        edges = [(state, code, to) for state, out in enumerate(language._automaton(codes)) for code, to in out.items()]
        draw.shuffle(edges)
        keys = np.array([state * letters + code for state, code, _ in edges])
        table = language.Edges.of(keys, np.array([to for *_, to in edges], np.int32), letters)
        assert table.bytes() <= size * len(edges)
        assert table.find(keys).tolist() == [to for *_, to in edges]
        known = set(keys.tolist())
        others = np.array([k for k in range(0, (len(codes) * 2 + 9) * letters, max(1, letters // 7)) if k not in known])
        assert (table.find(others) == -1).all()
        assert len(np.unique(table.start[:-1][np.unique(keys // letters)])) == len(np.unique(keys // letters))


def test_stretches_in_any_grouping_give_the_same_phrases(monkeypatch):
    draw = random.Random(7)
    samples = {k: ["".join(draw.choice(letters) for _ in range(300))] for k, letters in {"a": "abcd ", "b": "bé d"}.items()}
    texts = ["".join(draw.choice("abcdé .") for _ in range(draw.choice([0, 1, 40, 255, 256, 257, 700, 3_000]))) for _ in range(25)]
    model = language.fit(samples)
    expected = [[brute_phrases(samples[name], text) if text else 0 for name in model.languages] for text in texts]
    for at_once in (1, 3, 1_000):
        monkeypatch.setattr(language, "_AT_ONCE", at_once)
        counts, _ = language.phrases(model, pa.array(texts, pa.large_string()))
        assert counts.tolist() == expected


def test_equal_costs_go_by_name_and_one_language_is_certain():
    texts = pa.array(["the dog", None, "...", "", "cat"])
    names, scores = language.predict(language.fit({k: ["the dog and the cat"] for k in ("b", "a", "c")}), texts)
    assert list(names) == ["a", "und", "und", "und", "a"] and scores.tolist() == [0.0] * 5
    names, scores = language.predict(language.fit({"b": ["the dog"]}), texts)
    assert list(names) == ["b", "und", "und", "und", "b"] and scores.tolist() == [1.0, 0.0, 0.0, 0.0, 1.0]


def test_the_sample_reads_the_texts_once(spark):
    docs = spark.createDataFrame([(i, f"the dog {i}", "en" if i % 2 else "fr") for i in range(200)], "doc_id bigint, text string, lang string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    assert set(language.sample(docs.mapInArrow(counted, docs.schema))) == {"en", "fr"}
    assert read.value == 200


def test_many_languages_share_the_sample(spark):
    draw = random.Random(4)
    words = {f"l{k:03}": ["".join(draw.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(30)] for k in range(200)}
    rows = [(i, " ".join(draw.choice(words[lang]) for _ in range(300)), lang) for i, lang in enumerate(list(words) * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8)
    pieces = language.sample(docs, characters=200_000)
    assert len(pieces) > 190 and sum(len(t) for p in pieces.values() for t in p) <= 200_000
    assert language.fit(pieces).bytes() <= 72 * 200_000 + (8 << 20)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    held = [got[i] == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 200 and sum(held) / len(held) > 0.95
    tiny = language.sample(docs, characters=2_000)
    assert all(len(t) <= 10 for p in tiny.values() for t in p)


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, data).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(held) > 1000 and sum(held) / len(held) > 0.97


def test_predictions_use_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(other).collect()} == before


def test_odd_rows(spark):
    rows = [
        (1, "the cat and the dog", "en"), (2, None, "en"), (3, "", "fr"), (4, "123 !!", "fr"), (None, "le chat et le chien", "fr"),
        (5, "le chat et le chien", "fr"), (5, "le chat et le chien", "fr"), (7, "the dog " * 20_000, None), (8, "\U0001f600ß", None),
        (9, "the dog and a cat", "en"), (10, "le chien et un chat", "fr"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select("*", F.lit(1).alias("score"), F.lit(2).alias("order"))
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3
    assert by_id[7]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "fr" and not by_id[None]["held_out"]
    untrained = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in untrained} == {("und", 0.0)}
    assert language.identify(docs.limit(0)).collect() == []
