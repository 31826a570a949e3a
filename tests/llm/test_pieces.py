"""Pieces against the library, in chunks of any size."""

import random

import numpy as np
import pytest

from sequela.llm import pieces

LETTERS = [*"abcdeft hin  ", "é", "ß", "\n", "\t", "▁", "漢", "😀", "ー", "th", "ing ", "  ", "\x00", "ﬁ", "1", "23", "▁▁"]


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_model())


def texts(n, most=120):
    rng = random.Random(5)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 3, 7, 16, 50])
def test_chunks_give_the_ids_of_the_library(model, chunk):
    for text in texts(80):
        assert [i for part in pieces.encode_giant(model, text, chunk) for i in part] == model.model.encode(text)


def test_runs_give_the_ids_of_the_library(model):
    for text, ids in zip(texts(300), model.encode_many(texts(300))):
        assert list(np.frombuffer(ids, np.int32)) == model.model.encode(text)


def test_products_may_be_taken_in_any_order(model):
    text = pieces.prepared("thinking thing inthe  tinthe " * 6)
    cuts = [*range(0, len(text), 20), len(text)]
    m = [pieces.transfer(model, text, a, b, a == 0, b == len(text))[2] for a, b in zip(cuts, cuts[1:])]
    left = pieces.combine(pieces.combine(m[0], m[1]), m[2])
    assert left == pieces.combine(m[0], pieces.combine(m[1], m[2]))


def test_tables(spark, model):
    rows = [(1, "a  b"), (1, "a  b"), (2, None), (3, ""), (None, "x"), (4, "thing in the " * 60), (4, "thing in the " * 60), (5, " ")]
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, chunk int, key string")
    for frame in (pieces.round_trip(docs, giant=100, chunk=33), pieces.decode(pieces.encode(docs, giant=100, chunk=33))):
        got = sorted(((r.doc_id or 0, r.n_tokens, r.text) for r in frame.collect()), key=str)
        assert got == sorted(((i or 0, len(model.model.encode(t or "")), t or "") for i, t in rows), key=str)
    assert pieces.round_trip(docs.limit(0)).collect() == []
