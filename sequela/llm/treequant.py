"""Vector codes from Lloyd's rounds over cover trees.

Vectors are cut into equal consecutive parts and each part has a codebook of integer entries. Every
block of vectors gets one tree a part, built once: a node stands for the points within its radius of
its centre, its children's centres lie more than half that radius apart and cover them, and points stand
in the tree's order, so that a node's points are a range and cumulative counts and sums give their
totals. In a round a node whose centre is nearer to one entry than to any other by more than twice its
radius goes to that entry whole, by the triangle inequality; only other nodes are opened, down to
points, which are compared exactly. All arithmetic that decides is on integers. A task hands on
one sum a codebook component; the codebooks are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import release, staged
from sequela.llm.topk import integers, products
from sequela.operators.joins import lookup

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

BLOCK = 2048
"""Vectors that share a tree."""

LEAF = 8
"""Nodes of at most this many different points have no children."""

HAIR = 1e-9
"""Share by which distances are widened before they decide, for rounding."""


class Tree(NamedTuple):
    """``points`` in the tree's order with ``row``: the point of each of the block's rows. Nodes are
    given by a point (``centre``), a ``radius``, a range of points and a range of children."""

    points: np.ndarray
    row: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * products(x, y)


def cover_tree(rows: np.ndarray) -> Tree:
    """The tree of integer rows, equal rows as one point."""
    points, row = np.unique(rows, axis=0, return_inverse=True)
    apart = np.sqrt(squares(points, points).astype(np.float64)) * (1 + HAIR)
    order: list[np.ndarray] = []
    nodes: list[list] = []  # centre, radius, members, first child, number of children
    members = np.arange(len(points))
    nodes.append([0, float(apart[0].max(initial=0.0)), members, 0, 0])
    at = 0
    while at < len(nodes):
        centre, radius, members, _, _ = nodes[at]
        if len(members) > LEAF and radius > 0:
            free, centres = members, []
            nearest = centre
            while len(free):  # a net: each next centre lies outside half the radius of those before
                centres.append(nearest)
                free = free[apart[nearest, free] > radius / 2]
                nearest = free[0] if len(free) else -1
            owner = np.argmin(apart[np.ix_(members, centres)], 1)
            nodes[at][3:] = [len(nodes), len(centres)]
            by = np.argsort(owner, kind="stable")
            for c, own in zip(centres, np.split(members[by], np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])):
                nodes.append([c, float(apart[c, own].max()), own, 0, 0])
        at += 1
    # Points in depth-first order: children follow each other inside their parent's range.
    first, end = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    end[0] = len(points)
    for i, (_, _, members, child, many) in enumerate(nodes):
        if many:
            sizes = np.array([len(nodes[c][2]) for c in range(child, child + many)])
            end[child:child + many] = first[i] + np.cumsum(sizes)
            first[child:child + many] = end[child:child + many] - sizes
        else:
            order.append((first[i], members))
    order = np.concatenate([m for _, m in sorted(order, key=lambda x: x[0])]) if order else members
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    return Tree(points[order], place[row.reshape(-1)], place[np.array([n[0] for n in nodes])], np.array([n[1] for n in nodes]),
                first, end, np.array([n[3] for n in nodes]), np.array([n[4] for n in nodes]))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of several ranges."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def nearest(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, int]:
    """The entry of each point (the lowest of equally near ones) and how many points were compared one by one."""
    out = np.full(len(tree.points), -1, np.int64)
    open_, single = np.zeros(1, np.int64), []
    while len(open_):
        far = squares(tree.points[tree.centre[open_]], book)
        entry = far.argmin(1)
        roots = np.sqrt(far.astype(np.float64))
        best = roots[np.arange(len(open_)), entry]
        roots[np.arange(len(open_)), entry] = np.inf
        room = 2 * tree.radius[open_] + HAIR * (best + 1)
        settled = (tree.radius[open_] == 0) | (best + room < roots.min(1))
        done = open_[settled]
        out[ranges(tree.first[done], tree.end[done] - tree.first[done])] = np.repeat(entry[settled], tree.end[done] - tree.first[done])
        left = open_[~settled]
        leaf = tree.children[left] == 0
        single.append(ranges(tree.first[left[leaf]], (tree.end - tree.first)[left[leaf]]))
        open_ = ranges(tree.child[left[~leaf]], tree.children[left[~leaf]])
    single = np.concatenate(single)
    out[single] = squares(tree.points[single], book).argmin(1)
    return out, len(single)


# ── Blocks of vectors as rows ────────────────────────────────────────────────────────────────

TREE = "points binary, row binary, centre binary, radius binary, first binary, end binary, child binary, children binary"
BLOCKS = f"block long, ids array<long>, trees array<struct<{TREE.replace(' binary', ':binary')}>>"


def _build(parts: int, limit: int):
    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def pack():
            table = pa.Table.from_batches(held).combine_chunks()
            flat = table.column("v").combine_chunks()
            rows = np.asarray(flat.flatten()).reshape(len(flat), -1)
            width = -(-rows.shape[1] // parts)
            rows = np.pad(rows, ((0, 0), (0, width * parts - rows.shape[1])))
            trees = [cover_tree(rows[:, p * width:(p + 1) * width]) for p in range(parts)]
            packed = [dict(zip(Tree._fields, (np.ascontiguousarray(a).tobytes() for a in t))) for t in trees]
            return pa.RecordBatch.from_pylist(
                [{"block": number, "ids": table.column("row").to_pylist(), "trees": packed}],
                pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())),
                           ("trees", pa.list_(pa.struct([(f, pa.binary()) for f in Tree._fields])))]))

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, limit - size)
                held.append(part)
                size, at = size + len(part), at + len(part)
                if size == limit:
                    yield pack()
                    number, held, size = number + 1, [], 0
        if held:
            yield pack()
    return run


def _trees(batch: pa.RecordBatch, i: int, width: int) -> list[Tree]:
    out = []
    for packed in batch.column(2)[i]:
        raw = {f: np.frombuffer(packed[f].as_buffer(), np.float64 if f == "radius" else np.int64) for f in Tree._fields}
        out.append(Tree(**{**raw, "points": raw["points"].reshape(-1, width)}))
    return out


def _totals(books: np.ndarray):
    """Sum of the points that each entry takes, one row a component and task (place -1: how many)."""
    parts, entries, width = books.shape

    def run(batches):
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                for p, tree in enumerate(_trees(batch, i, width)):
                    entry, _ = nearest(tree, books[p])
                    weight = np.bincount(tree.row, minlength=len(tree.points))
                    # Runs of one entry: differences of cumulative counts and sums give their totals.
                    edge = np.append(np.flatnonzero(np.diff(entry, prepend=-1)), len(entry))
                    total = np.zeros((len(entry) + 1, width + 1), np.int64)
                    np.cumsum(np.column_stack([tree.points * weight[:, None], weight]), axis=0, out=total[1:])
                    np.add.at(sums[p], entry[edge[:-1]], np.diff(total[edge], axis=0))
        p, e, c = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(np.where(c == width, -1, c), pa.int32()),
                                          pa.array(sums[p, e, c])], ["part", "entry", "place", "total"])
    return run


def _codes(books: np.ndarray):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                codes, error = [], 0
                for p, tree in enumerate(_trees(batch, i, books.shape[2])):
                    entry, _ = nearest(tree, books[p])
                    off = tree.points - books[p][entry]
                    codes.append(entry[tree.row])
                    error = error + (off * off).sum(1)[tree.row]
                text = ["".join(f"{c:02x}" for c in row) for row in np.column_stack(codes).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(text), pa.array(error)], ["row", "code", "error"])
    return run


def moved(books: np.ndarray, totals: list[tuple]) -> np.ndarray:
    """The codebooks after a round: floor(sum / count), entries that nothing chose as they were."""
    sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
    for part, entry, place, total in totals:
        if place < 0:
            counts[part, entry] = total
        else:
            sums[part, entry, place] = total
    used = counts > 0
    out = books.copy()
    out[used] = sums[used] // counts[used][:, None]
    return out


def usual_length(rows: DataFrame, vector: str) -> int | None:
    """The most common length of the arrays, the longest of equally common ones."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else None


def quantised(vectors: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
              block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """Per vector ``vec_id``, its ``label`` as ``label``, ``code`` and ``error`` (exact squared distance,
    summed over the parts), and the codebooks as an array of parts, entries and components.

    Vectors that are null or empty, or hold null or non-finite components, are left out, and so are
    those whose length is not the most common one. A length that the parts do not divide is filled up with zeros.
    The first codebooks come from the smallest vec_ids (nulls last, ties by components); fewer vectors than
    ``entries`` give as many entries. Repeated vec_ids are rows of their own; other columns are not read.
    Distances are exact as long as they fit 64 bits.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"),
                          integers(F.col("embedding"), SCALE).alias("v"), F.monotonically_increasing_id().alias("row")).where("v IS NOT NULL")
    rows = staged(rows, "vectors")
    dim = usual_length(rows, "v")
    kept = rows.where(F.size("v") == (dim or 0))
    start = [r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    if not start:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    width = -(-dim // parts)
    books = np.pad(np.array(start, np.int64), ((0, 0), (0, width * parts - dim))).reshape(len(start), parts, width).transpose(1, 0, 2)
    blocks = staged(kept.select("row", "v").mapInArrow(_build(parts, block), BLOCKS), "trees")
    for _ in range(rounds):
        totals = blocks.mapInArrow(_totals(books), "part int, entry int, place int, total long")
        books = moved(books, [tuple(r) for r in totals.groupBy("part", "entry", "place").agg(F.sum("total")).collect()])
    codes = blocks.mapInArrow(_codes(books), "row long, code string, error long")
    coded = staged(kept.select("row", "vec_id", "label").join(codes, "row").drop("row"), "codes")
    release(rows, blocks)
    return coded, books


def report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of :func:`quantised`; the sums of equal labels
    are formed before they are joined back, nulls together."""
    coded, books = quantised(vectors)
    coded = coded.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = staged(coded.groupBy("_none", "_label").agg(F.sum("error").alias("label_error")), "labels")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return lookup(coded, sums, ["_none", "_label"], table_rows=sums.count()).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
