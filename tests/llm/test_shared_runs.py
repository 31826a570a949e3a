"""Signatures' members, however Arrow cuts the rows into batches."""

import random

import pyarrow as pa
import pytest

from sequela.llm.ngramjoin import _shared_runs


def members(rows, cuts):
    edges = [0, *sorted(cuts), len(rows)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[a:b]], pa.int64()), pa.array([r[1] for r in rows[a:b]], pa.int64())],
                                          ["sig", "node"]) for a, b in zip(edges, edges[1:])]
    return [tuple(r.values()) for out in _shared_runs(batches) for r in out.to_pylist()]


def brute(rows):
    nodes = {}
    for sig, node in rows:
        nodes.setdefault(sig, set()).add(node)
    return [(sig, node, min(of)) for sig, of in sorted(nodes.items()) if len(of) > 1 for node in sorted(of)]


@pytest.mark.parametrize("cut", range(10))
def test_a_batch_ends_inside_a_run_of_repeats(cut):
    rows = [(1, 4)] + [(1, 7)] * 4 + [(1, 9)] * 2 + [(2, 7)] * 2
    assert members(rows, [cut]) == brute(rows)


def test_random_cuts():
    rng = random.Random(2)
    for _ in range(2_000):
        rows = sorted((rng.randrange(-2, 3), rng.randrange(-2, 4)) for _ in range(rng.randrange(25)))
        assert members(rows, [rng.randrange(len(rows) + 1) for _ in range(rng.randrange(6))]) == brute(rows)
