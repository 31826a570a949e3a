"""The mix of rows without a doc_id, and of rows that repeat one."""

import re
from collections import Counter

from sequela.llm import mixing


def test_words_of_the_mix_are_those_of_the_plan(spark):
    how = mixing.Mix(block=8, shard_rows=20)
    rows = []
    for i in range(120):
        text = " ".join(f"d{i}w{j}" for j in range(1 + i * 7 % 40))
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 else i, text, "ab"[i % 2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    by_size = Counter()
    planned = mixing.taken(mixing.plan(docs, how), how).collect()
    for r in planned:
        want[r.doc_id, r.source] += r.taken
        by_size[r.doc_id, r.source, r.size] += r.taken
    got, words, got_size = Counter(), Counter(), Counter()
    size = {i: len(r[1].split()) for i, r in enumerate(rows)}
    for r in mixing.mixed(docs, how).collect():
        for w in r.text.split():
            i = int(re.match(r"d(\d+)w", w)[1])
            assert (r.doc_id, r.source) == (rows[i][0], rows[i][2])
            got[r.doc_id, r.source] += 1
            got_size[r.doc_id, r.source, size[i]] += 1
            words[w] += 1
    assert +want == got and +by_size == got_size
    assert max(words.values()) <= how.most


def test_rows_without_an_id_are_dealt_over_shards(spark):
    how = mixing.Mix(shard_rows=20)
    docs = spark.createDataFrame([(k, f"w{i} x", "a") for k in (None, 7) for i in range(200)], "doc_id long, text string, source string")
    size = Counter((r.doc_id, r.shard) for r in mixing.plan(docs, how).collect())
    assert max(size.values()) <= 60
