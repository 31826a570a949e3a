"""The operators' queries on the small tables against brute-force versions."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sequela.llm import pieces, queries, topk

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark):
    def get(name):
        return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()
    return get


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_pieces(spark, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = {r.doc_id: r.text or "" for r in rows("documents")}
    for r in run(spark, "op2_pieces"):
        ids = model.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert r.decoded_chars == len(texts[r.doc_id])


def test_toxicity(spark, rows):
    truth = {r.doc_id: r.toxic for r in rows("labels") if r.toxic is not None}
    got = {r.doc_id: r for r in run(spark, "op4_toxicity")}
    assert len(got) == len(rows("documents"))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert np.mean([got[i].predicted == t for i, t in truth.items()]) > 0.9


def test_mixing(spark, rows):
    docs = rows("documents")
    got = {r.doc_id: r for r in run(spark, "op5_mixing")}
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    total = Counter()
    for i, s in source.items():
        total[s] += sizes[i]
    names = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    aim, full = {}, set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        rate = left / (sum(weight[s] for s in names if s not in full) or 1)
        more = {s for s in names if s not in full and rate * weight[s] >= 2 * total[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for i, r in got.items():
        s = source[i]
        aim[s] = 2 * total[s] if s in full else rate * weight[s]
        assert r.size == sizes[i] and r.source_size == total[s]
        assert r.target == pytest.approx(aim[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - aim[s]) <= max(300, 0.03 * aim[s]), (s, taken[s], aim[s])
    assert got == {r.doc_id: r for r in run(spark, "op5_mixing")}


def test_graph(spark, rows):
    found = {r.vec_id: r for r in run(spark, "op6_graphdup")}
    ids = sorted(r.vec_id for r in rows("embeddings"))
    x = {r.vec_id: np.array(r.embedding, float) for r in rows("embeddings")}
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))
    for a, b in zip(*np.nonzero(near)):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    assert sum(r.n_links for r in found.values()) >= 0.97 * near.sum()
    wrong = 0
    for k, i in enumerate(ids):
        assert found[i].n_links <= near[k].sum()
        assert found[i].kept == (found[i].component_id == i)
        wrong += found[i].component_id != ids[top(k)]
    assert wrong <= 0.02 * len(ids)


def test_secrets(spark):
    folder = FOLDER.replace("0.001", "0.01")  # the smallest tables hold no secret
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    patterns = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
    some = 0
    for r in queries.QUERIES["op7_secrets"](spark, folder).collect():
        spans = []
        for order, (kind, p) in enumerate(patterns.items()):
            for m in p.finditer(texts[r.doc_id]):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        want = [s for _, _, s in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in patterns)
        assert set(want) <= set(r.spans.split(",")) or not want
        assert r.n_scored >= len(want) and (r.least_score is None) == (r.n_scored == 0)
        some += len(want)
    assert some


def test_warc(spark, rows):
    pages = {r.page_id: (r.html or "").encode() for r in rows("pages")}
    same = defaultdict(list)
    for i, data in pages.items():
        same[data].append(i)
    got = {r.page_id: r for r in run(spark, "op8_warc")}
    assert got.keys() == pages.keys()
    for i, data in pages.items():
        r, first = got[i], max(same[data])
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))


def test_sharding(spark, rows):
    docs = {r.doc_id: r.text for r in rows("documents")}
    got = run(spark, "op9_sharding")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots, size = defaultdict(list), Counter()
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) + 1 for t in docs.values())
    assert max(size.values()) - min(size.values()) <= 2 * largest + 0.02 * sum(size.values()) / 8


def brute_groups(texts, k, num, den):
    sets, root = {}, {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        root[i] = i

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in by[s])
        for j, c in common.items():
            if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            by[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_groups(spark, rows):
    texts = {r.doc_id: r.text for r in rows("documents")}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op10_ngramjoin")}
    assert got == brute_groups(texts, 4, 85, 100)


def test_pruning_keeps_every_result():
    """Search in blocks of vectors of very different lengths, with and without thresholds."""
    rng = np.random.default_rng(1)
    c = (rng.normal(size=(400, 8)) * rng.exponential(20, size=(400, 1))).astype(np.int64)
    q = (rng.normal(size=(60, 8)) * 30).astype(np.int64)
    norms = np.sqrt((c * c).sum(1).astype(float))
    order = np.argsort(-norms)
    c, norms = c[order], norms[order]
    ids = rng.permutation(400)
    scores = q @ c.T
    for level in (-np.inf, None):
        least = np.full(60, -np.inf) if level else np.sort(scores, 1)[:, -7].astype(float)
        i, j, s = topk.best(np.arange(60) + 1000, q, np.sqrt((q * q).sum(1).astype(float)), least, ids, c, norms, 5)
        for a in range(60):
            want = sorted((-scores[a, b], ids[b]) for b in range(400))[:5]
            assert sorted((-x, ids[y]) for y, x in zip(j[i == a], s[i == a]))[:5] == want
