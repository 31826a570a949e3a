"""Removal of repeated byte strings against all windows."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from sequela.llm import queries, repeats

FOLDER = "/root/testdata/sf0.001"
L = repeats.WINDOW


def brute(texts):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[j:j + L] for t in texts for j in range(len(t) - L + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - L + 1):
            if seen[t[j:j + L]] > 1:
                gone[j:j + L] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string, copies int, digest string, hashes string")
    got = sorted(map(tuple, repeats.without_repeats(frame, **how).collect()), key=str)
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]))), key=str)
    return got


def words(rng, n):
    return "".join(rng.choice("abcdé \n") for _ in range(n))


@pytest.mark.parametrize("shard", [700, 1 << 20])
def test_planted(spark, shard):
    rng = random.Random(3)
    passage, tail = words(rng, 420), words(rng, 260)
    texts = [words(rng, rng.randrange(0, 900)) for _ in range(25)]
    for i in range(12):  # a passage in many surroundings, cut short by a little more each time
        texts.append(words(rng, 40 * i) + passage[5 * i:] + words(rng, 30) + tail[:L - 6 + i])
    texts += [passage[:150] + words(rng, 3) + passage[150:], tail, tail, texts[3], texts[3]]
    texts += ["x" * (L - 1), "x" * L, "y" * (L + 1), "ab" * 400, "ab" * 99 + "a", words(rng, 90) * 9, None, "", "é" * 150]
    rows = [(i if i % 7 else None if i else 0, t, 1, "d", "h") for i, t in enumerate(texts)]
    got = check(spark, rows + rows[-3:], shard=shard)
    assert sum(r[2] for r in got) > 8000


def test_ends_of_parts():
    """Anchors do not depend on where a text is cut for hashing, and windows of equal text have equal ones."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 110, 5000).astype(np.uint8)
    whole = repeats.gram_hashes(data, 64)
    assert (repeats.gram_hashes(data[1234:2000], 64) == whole[1234:2000 - 63]).all()
    hashes, places = repeats.anchors(data)
    inner, at = repeats.anchors(data[700:3000])
    where = lambda h, p, w: h[np.searchsorted(p, w, "right") - 1]
    assert all(where(hashes, places, w + 700) == where(inner, at, w) for w in range(2300 - L + 1))


def test_order_of_a_shard():
    """Places of a shard's suffixes agree with equality of their first WINDOW bytes."""
    rng = random.Random(5)
    text = (words(rng, 300) * 3 + words(rng, 500)).encode()
    _, depth = repeats.suffix_ranks(np.frombuffer(text, np.uint8))
    kinds = {}
    for i, d in enumerate(depth):
        assert kinds.setdefault(int(d), text[i:i + L]) == text[i:i + L]
    assert len(kinds) == len({text[i:i + L] for i in range(len(depth))})


def test_empty(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    check(spark, [(1, None, 1, "d", "h"), (None, "short", 1, "d", "h")])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("shard", [30_000, None])
def test_query(spark, shard):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    got = repeats.without_repeats(docs, shard=shard) if shard else queries.QUERIES["op11_repeats"](spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows])))
