"""Exact top-k inner product search in norm buckets.

Vectors are grouped by length: ranges of about equal counts, longest first, cut into blocks of
bounded size. A query starts with the block of the longest vectors, whose k-th best score is its first
threshold. For every other block the local cosine threshold of a query is that score over the product
of the two lengths. Above 1 the block cannot hold a result, and the pair of blocks is never formed
when this holds for all queries of a block. Inside a block the cut-off by length follows from the
same bound; where the local threshold is high, vectors whose leading coordinate lies outside the
range that the threshold allows are left out too. What remains is verified by exact integer
products.

Queries go against all rows in blocks. What moves is one row a block (its matrix as bytes): each
candidate block meets each query block that it may serve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequela.llm.common import release, staged

BLOCK = 4096
"""Vectors in a block at most (about: blocks are dealt by hash inside a length bucket)."""

QUERY_BLOCK = 1024
STEEP = 0.5
"""Local cosine threshold from which coordinates are looked at."""


def integers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, or null where a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & (F.size(wide) > 0), F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def _matrix(blobs: pa.Array, i: int, dim: int) -> np.ndarray:
    return np.frombuffer(blobs[i].as_buffer(), np.int64).reshape(-1, dim)


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of a block as one row, longest first."""
    flat = table.column("v").combine_chunks()
    dim = len(flat[0])
    matrix = flat.flatten().to_numpy().reshape(-1, dim)
    ids, norms = table.column("vec_id").to_numpy(), table.column("norm").to_numpy()
    order = np.lexsort((ids, -norms))
    return pa.table({
        "block": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()),
        "ids": pa.array([ids[order].tobytes()], pa.binary()), "norms": pa.array([norms[order].tobytes()], pa.binary()),
        "matrix": pa.array([np.ascontiguousarray(matrix[order]).tobytes()], pa.binary()),
        "longest": pa.array([float(norms.max())])})


BLOCK_ROW = "block long, dim int, ids binary, norms binary, matrix binary, longest double"


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer matrices, by the narrowest floats that hold every sum."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if bound < 2**24:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -2**63, 2**63 - 1).astype(np.int64)


def best(q_ids, q, q_norms, thresholds, c_ids, c, c_norms, k):
    """(query position, candidate position, score) of at most ``k`` a query, ties to smaller ids,
    leaving out what scores below the query's threshold."""
    out = []
    # Rounding may move a bound a little: a hair of slack keeps it on the safe side.
    length = np.where(q_norms > 0, thresholds / np.maximum(q_norms, 1e-300), -np.inf) * (1 - 1e-12) - 1e-9
    local = length / max(c_norms[0], 1e-300)
    alive = np.flatnonzero(~(local > 1 + 1e-9) | (c_norms[0] == 0))
    steep = alive[(local[alive] >= STEEP) & (q_norms[alive] > 0)]
    flat = np.setdiff1d(alive, steep)
    for start in range(0, len(flat), 256):
        who = flat[start:start + 256]
        # Vectors stand by falling length: those past the cut-off cannot reach the threshold.
        end = int(np.searchsorted(-c_norms, -max(0.0, length[who].min()), "right")) if length[who].min() > 0 else len(c)
        scores = products(q[who], c[:end])
        for i, row in zip(who, scores):
            out.append(_top(i, np.arange(end), row, thresholds[i], c_ids, k))
    unit = c / np.maximum(c_norms, 1e-300)[:, None] if len(steep) else None
    for i in steep:
        direction = q[i] / q_norms[i]
        f = int(np.argmax(np.abs(direction)))
        t = min(1.0, local[i])
        slack = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - direction[f] ** 2)) + 1e-9
        # cos >= t' >= t for every vector that is wanted; the range below holds for t and widens no further
        # for larger t' only on the side away from the query's coordinate, so that side stays open.
        sign = np.sign(direction[f])
        place = np.flatnonzero(sign * unit[:, f] >= sign * direction[f] * t - slack)
        place = place[c_norms[place] >= length[i]]
        if len(place):
            out.append(_top(i, place, products(q[i:i + 1], c[place])[0], thresholds[i], c_ids, k))
    out = [x for x in out if len(x[0])]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def _top(i, place, scores, threshold, c_ids, k):
    good = scores >= threshold
    place, scores = place[good], scores[good]
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        good = scores >= edge
        place, scores = place[good], scores[good]
    order = np.lexsort((c_ids[place], -scores))
    return np.full(len(order), i), place[order], scores[order]


def _search(k: int):
    """Rows of (query block, thresholds, candidate block) to the best scores of each query."""
    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                dim = col["dim"][r].as_py()
                q, c = _matrix(col["q_matrix"], r, dim), _matrix(col["matrix"], r, dim)
                q_ids = np.frombuffer(col["q_ids"][r].as_buffer(), np.int64)
                c_ids = np.frombuffer(col["ids"][r].as_buffer(), np.int64)
                q_norms = np.frombuffer(col["q_norms"][r].as_buffer(), np.float64)
                c_norms = np.frombuffer(col["norms"][r].as_buffer(), np.float64)
                least = col["least"][r].as_buffer()
                least = np.full(len(q), -np.inf) if least is None else np.frombuffer(least, np.float64)
                # k + 1, since one of the rows may be the query itself
                i, j, s = best(q_ids, q, q_norms, least, c_ids, c, c_norms, k + 1)
                if len(i):
                    other = q_ids[i] != c_ids[j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[i][other]), pa.array(c_ids[j][other]), pa.array(s[other])],
                        ["query_id", "vec_id", "score"])
    return run


FOUND = "query_id long, vec_id long, score long"


def _first_pass(k: int):
    """As ``_search``, and the k-th best score of every query by block, as its threshold."""
    inner = _search(k)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                q_ids = np.frombuffer(row.column(row.schema.get_field_index("q_ids"))[0].as_buffer(), np.int64)
                least = np.full(len(q_ids), -np.inf)
                found = list(inner([row]))
                if found:
                    ids = np.concatenate([b.column(0).to_numpy() for b in found])
                    scores = np.concatenate([b.column(2).to_numpy() for b in found])
                    order = np.lexsort((-scores, ids))
                    ids, scores = ids[order], scores[order]
                    start = np.searchsorted(ids, q_ids)
                    full = np.searchsorted(ids, q_ids, "right") - start >= k
                    least[full] = scores[start[full] + k - 1]
                yield pa.RecordBatch.from_arrays(
                    [row.column(row.schema.get_field_index("q_block")), pa.array([least.tobytes()], pa.binary()),
                     pa.array([float(least.min())])], ["q_block", "least", "weakest"])
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query (all, if there are
    fewer), ties to the smaller vec_id, a query's own row left out.

    ``vectors`` has ``vec_id`` and ``v`` (array of long, see ``integers``). Rows with a null id or vector
    take no part; of rows that repeat a vec_id the greatest vector counts. Vectors of another length
    than the most common one raise an error. Scores beyond 64 bits stop at the limits of a long.
    """
    rows = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.max("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = staged(rows.select("vec_id", "v", norm.alias("norm"), is_query.alias("asks")), "vectors")
    count, asking, low, high = rows.agg(F.count("*"), F.sum(F.col("asks").cast("long")),
                                        F.min(F.size("v")), F.max(F.size("v"))).first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not asking:
        return empty
    if low != high:
        raise ValueError(f"vectors have {low} to {high} components")
    # Length buckets: quantiles of the norm; inside one, blocks by hash.
    buckets = max(1, min(256, count // BLOCK))
    cuts = sorted(set(rows.approxQuantile("norm", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)))) if buckets > 1 else []
    bucket = F.lit(0)
    for cut in cuts:
        bucket = bucket + (F.col("norm") < cut).cast("int")
    sizes = rows.groupBy(bucket.alias("bucket")).count().collect()  # at most 256
    split = {r["bucket"]: max(1, -(-r["count"] // BLOCK)) for r in sizes}
    first_block, total = {}, 0
    for b in sorted(split):
        first_block[b], total = total, total + split[b]
    start, ways = (F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), bucket)
                   for d in (first_block, split))
    block = (start + F.pmod(F.xxhash64("vec_id"), ways)).cast("long")
    parts = rows.select(block.alias("block"), "vec_id", "v", "norm")
    blocks = staged(parts.groupBy("block").applyInArrow(_pack, BLOCK_ROW), "blocks")

    q_ways = -(-asking // QUERY_BLOCK)
    q_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_ways)).cast("long")
    asked = staged(rows.where("asks").select(q_block.alias("block"), "vec_id", "v", "norm").groupBy("block")
                   .applyInArrow(_pack, BLOCK_ROW), "queries")
    asked = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("norms").alias("q_norms"),
                         F.col("matrix").alias("q_matrix"), F.col("longest").alias("q_longest"), "dim")

    # The first block (at most BLOCK rows) starts every query off.
    head = F.broadcast(blocks.where("block = 0").drop("dim"))
    started = asked.withColumn("block", F.pmod("q_block", F.lit(1).cast("long"))).join(head, "block").withColumn("least", F.lit(None).cast("binary"))
    started = started.repartition(max(1, q_ways), "q_block")
    least = staged(started.mapInArrow(_first_pass(k), "q_block long, least binary, weakest double"), "thresholds")
    begun = started.mapInArrow(_search(k), FOUND)

    # Pairs of blocks that may hold a result; both sides are listed by block, never by row.
    reach = least.join(asked.select("q_block", "q_longest"), "q_block")
    wanted = (blocks.where("block > 0").select("block", "longest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_ways - 1).cast("long"))).alias("q_block"))
              .join(reach, "q_block").where((F.col("longest") * F.col("q_longest") * (1 + 1e-9) >= F.col("weakest")) | F.col("weakest").isNull()))
    wanted = staged(wanted.select("block", "q_block"), "pairs")
    rest = (wanted.join(blocks.drop("dim"), "block").join(asked, "q_block").join(least.drop("weakest"), "q_block")
            .repartition(F.col("block"), F.col("q_block")).mapInArrow(_search(k), FOUND))
    found = staged(begun.union(rest), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    result = staged(found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k), "topk")
    release(rows, blocks, least, wanted, found)
    return result
