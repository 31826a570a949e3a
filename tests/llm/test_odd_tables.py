"""Nulls, empty texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from sequela.llm import chat, graphdup, mixing, secrets, sharding, topk, toxicity, warc

DOCS = "doc_id long, text string, source string, size int, shard string, score double, n_chars long"


@pytest.fixture
def docs(spark):
    rows = [(1, "you idiot 1d", "a"), (1, "you idiot 1d", "a"), (2, None, None), (3, "", "b"), (None, "plain words", "b"),
            (5, "password=abcdef12 " * 3, None), (6, "word " * 5000, "a")]
    return spark.createDataFrame([(*r, 1, "x", 0.5, 0) for r in rows], DOCS)


def test_documents(spark, docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for lexicon in (toxicity.learn(docs, labels), toxicity.learn(docs, labels.limit(0)), toxicity.Lexicon({" idiot ": 9.0}, (" you idiot ",))):
        rows = toxicity.scored(docs, lexicon).collect()
        assert len(rows) == 7 and all(0 <= r._score <= 1 for r in rows)
    assert toxicity.scored(docs.limit(0), toxicity.Lexicon()).collect() == []
    assert toxicity.Lexicon({" idiot ": 9.0}).raw(toxicity.folded("IDI0T!"), toxicity.Lexicon({" idiot ": 9.0}).machine()) > 1
    formats = secrets.learn(docs)
    assert sum(r.n_assign for r in secrets.scan(docs, formats).collect()) == 3
    assert [r.text for r in secrets.redacted(docs, formats).where("doc_id = 5").collect()] == ["[SECRET] " * 3]
    assert secrets.scan(docs.limit(0), secrets.learn(docs.limit(0))).collect() == []


def test_mixing(spark, docs):
    rows = mixing.taken(mixing.plan(docs)).collect()
    assert len(rows) == 7 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).where("text IS NULL OR text = ''").count() == 0
    assert mixing.taken(mixing.plan(docs.limit(0))).collect() == []


def test_sharding(spark, docs):
    rows = sharding.balanced(docs).collect()
    assert len(rows) == 7 and sorted(r["size"] for r in rows)[:2] == [1, 1]
    assert sharding.balanced(docs.limit(0)).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u\r\n%", "é" * 50), (2, None, "é" * 50), (3, "x", None), (4, "x", ""), (None, "x", "q")],
                                  "page_id long, url string, html string")
    chunks = warc.read(warc.write(pages, chunk=7))
    got = {r.page_id: (r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.described(chunks).collect()}
    assert got == {1: ("u\r\n%", 100, "revisit", 2), 2: (None, 100, "response", None), 3: ("x", 0, "revisit", 4),
                   4: ("x", 0, "response", None), None: ("x", 1, "response", None)}
    assert warc.described(warc.read(warc.write(pages.limit(0)))).collect() == []


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "user", None), (1, 2, "assistant", "a<|im_end|>\\b"), (1, 3, "us\ner", "x"), (None, None, None, "y")],
                                  "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.told, r.trained) for r in chat.read_back(chat.examples(turns)).collect()}
    assert got == {1: (3, "user\n\nassistant\na<|im_end|>\\b\nus\ner\nx\n", "a<|im_end|>\\b"), None: (1, "\ny\n", "")}
    assert chat.read_back(chat.examples(turns.limit(0))).collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in graphdup.near_duplicates(v).collect()}
    assert got == {1: (1, 1), 2: (1, 1), **{i: (0, i) for i in (3, 4, 5, 6, 7)}}
    found = topk.search(v.select("vec_id", topk.integers(F.col("embedding")).alias("v")), F.col("vec_id") == 1, 2).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(found)] == [(1, 2, 64 * 128), (2, 3, 0)]
    assert graphdup.near_duplicates(v.limit(0)).collect() == []
