"""Vector codes and whitening against plain versions."""

import os

import numpy as np
import pytest

from sequela.llm import queries, treequant, whiten

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def lloyd(x, parts, entries, rounds):
    """Codes, errors and codebooks by comparing everything, ids in order."""
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))
    codes, error, books = [], 0, []
    for p in range(parts):
        y = x[:, p * width:(p + 1) * width]
        book = y[:entries].copy()
        for r in range(rounds + 1):
            far = ((y[:, None] - book[None]) ** 2).sum(2)
            code = far.argmin(1)
            if r < rounds:
                for e in set(code):
                    book[e] = y[code == e].sum(0) // (code == e).sum()
        codes.append(code)
        books.append(book)
        error = error + far[np.arange(len(y)), code]
    return np.column_stack(codes), error, np.array(books)


@pytest.mark.parametrize("dim,entries,block", [(10, 12, 64), (8, 5, 1000), (3, 300, 7)])
def test_lloyd(spark, dim, entries, block):
    rng = np.random.default_rng(dim)
    x = rng.integers(-3, 4, (400, dim)) * 700 + rng.integers(0, 3, (400, dim))  # clusters, ties and repeats
    x[50:90] = x[3]
    frame = spark.createDataFrame([(i, i % 3 or None, [float(v) / 1024 for v in row], 1, "b") for i, row in enumerate(x)],
                                  "vec_id long, label int, embedding array<double>, row int, block string").repartition(3)
    got, books = treequant.quantised(frame, entries=entries, block=block)
    codes, error, want = lloyd(x, 4, entries, treequant.ROUNDS)
    assert (books == want).all()
    rows = {r.vec_id: (r.code, r.error) for r in got.collect()}
    assert rows == {i: ("".join(f"{c:02x}" for c in codes[i]), int(error[i])) for i in range(400)}


def test_subtrees_are_taken_whole():
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 3, (600, 4)) + rng.integers(0, 4, (600, 1)) * 400).astype(np.int64)
    tree = treequant.cover_tree(x)
    assert (tree.points[tree.row] == x).all()
    for i in range(len(tree.centre)):  # every node covers its range, and children fill it
        inside = tree.points[tree.first[i]:tree.end[i]]
        assert np.sqrt(((inside - tree.points[tree.centre[i]]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-6
        if tree.children[i]:
            kids = slice(tree.child[i], tree.child[i] + tree.children[i])
            assert tree.first[kids][0] == tree.first[i] and tree.end[kids][-1] == tree.end[i]
    book = np.array([[0] * 4, [400] * 4, [800] * 4, [1200] * 4])
    entry, single = treequant.nearest(tree, book)
    assert (entry == treequant.squares(tree.points, book).argmin(1)).all() and single < 60


ODD = [(1, 1, [0.5, 1.0]), (None, None, [0.5, 2.0]), (2, None, [1.0]), (3, 1, None), (4, 1, [float("nan"), 0.0]), (5, 2, [None, 0.0]), (1, 1, [0.5, 1.0]), (6, 2, [])]
VECTORS = "vec_id long, label int, embedding array<double>"


def test_odd_codes(spark):
    frame = spark.createDataFrame(ODD, VECTORS)
    got = treequant.report(frame).collect()
    # Two components are filled up to four parts; the first entries are the two equal vectors, then that without an id.
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == [(0, "00020000", 0, 0), (1, "00000000", 0, 0), (1, "00000000", 0, 0)]
    assert len({r.codebooks_sha256 for r in got}) == 1
    assert treequant.report(frame.limit(0)).collect() == []


def test_odd_whitening(spark):
    frame = spark.createDataFrame(ODD, VECTORS)
    got = whiten.whitened(frame).collect()  # three vectors on a line: one component
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert all(abs(abs(r.whitened) - (2**0.5 if r.vec_id is None else 0.5**0.5)) < 1e-12 and r.explained == pytest.approx(1) for r in got)
    assert {r.deviation for r in got} == {(3 * 2048 - 4096) ** 2, (3 * 1024 - 4096) ** 2}
    assert whiten.whitened(frame.limit(0)).collect() == [] and whiten.whitened(frame.limit(1)).collect() == []


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    scale = 10.0 ** -np.arange(9)
    scatter = (scale[:, None] * (q @ np.diag(np.arange(1.0, 10)) @ q.T)) * scale  # graded, condition 1e17
    values, vectors = whiten.jacobi(whiten.pivoted_cholesky(scatter))
    assert len(values) >= 8 and (np.diff(values) <= 0).all()
    again = (vectors * values) @ vectors.T
    assert np.abs(again - scatter)[:7, :7].max() < 1e-14
    assert (np.abs(again - scatter) <= 1e-10 * np.sqrt(np.outer(scatter.diagonal(), scatter.diagonal())))[:7, :7].all()


@here
def test_whitened_query(spark):
    rows = [r for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    want = y @ u[:, :8] / np.sqrt(e[:8])
    got = queries.QUERIES["op13_whiten"](spark, FOLDER).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.identity_error for r in got}.pop() < 1e-9
    at = {r.vec_id: i for i, r in enumerate(rows)}
    mine = np.zeros((n, 8))
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == int(((n * x[at[r.vec_id]] - s) ** 2).sum())
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10
    assert np.abs(mine * np.sign((mine * want).sum(0)) - want).max() < 1e-9
