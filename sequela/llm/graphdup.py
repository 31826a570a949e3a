"""Near duplicates among vectors by a robust-pruned flat graph over overlapping cluster shards.

Centres are fitted on a bounded sample; every vector goes to its two nearest clusters. A cluster
larger than a shard may be is split by hash. In each shard a flat graph is built: candidates are near
neighbours and far ones, robust pruning keeps an edge only where no kept neighbour is much closer to
its end. A vector's adjacency lists from all its shards are united. Then every vector of a
cluster searches each shard of the cluster: best-first from the shard's medoids, and as soon as
vectors within range turn up, all of their neighbours are expanded until no new one is within range.
Hits are verified by cosine in double precision.

A pair that shares both clusters counts in the first one only. A task gives for each vector the number
of its links and the smallest vector of its part of the links found, not the pairs, so dense groups
cost no output. Recall is audited for a bounded set of vectors against all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import staged
from sequela.llm.components import components

SAMPLE = 20_000
"""Vectors the centres are fitted on, at most."""

SHARD = 2_048
"""Vectors in a shard, about, at most."""

CENTRES = 1_024
OVERLAP = 2
DEGREE, POOL, FAR, FAR_DEGREE, ALPHA = 24, 48, 16, 6, 1.2
BEAM, MEDOIDS, WIDE = 32, 48, 16
AUDIT = 128
"""Vectors whose links are also counted by brute force."""


def unit_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of double): of rows that repeat a vec_id the greatest vector; null ids out.
    ``v`` is null where the vector is null, empty, zero or holds null or non-finite components."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(wide, lambda x: x != 0)
    return (vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(~bad, wide).alias("v"))
            .where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.max("v").alias("v")))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def normed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres_of(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on the bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i:i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.sqrt((sums * sums).sum(1))
        centres = np.where(sizes[:, None] > 1e-12, sums / np.maximum(sizes, 1e-12)[:, None], centres)
    return centres


def _assign(centres: np.ndarray, overlap: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = normed(_matrix(batch.column(1)))
            order = np.argsort(-(x @ centres.T), 1, kind="stable")[:, :overlap]
            order = np.sort(order, 1).astype(np.int32)
            width = x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64())),
                 pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), order.shape[1]).cast(pa.list_(pa.int32()))],
                ["vec_id", "v", "clusters"])
    return run


# ── Graph ────────────────────────────────────────────────────────────────────────────────────


def robust_prune(x: np.ndarray, i: int, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of ``i`` from the pool: nearest first, leaving out those that are ``alpha`` times
    nearer to a neighbour already kept than to ``i``. Distances are 1 - cosine."""
    pool = pool[pool != i]
    if not len(pool):
        return pool
    near = 1 - x[pool] @ x[i]
    order = np.argsort(near, kind="stable")
    pool, near = pool[order], near[order]
    between = 1 - x[pool] @ x[pool].T
    alive, kept = np.ones(len(pool), bool), []
    for p in range(len(pool)):
        if alive[p]:
            kept.append(p)
            if len(kept) == degree:
                break
            alive &= alpha * between[p] > near
    return pool[kept]


def build(x: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Adjacency lists of a shard's graph, with reverse edges. A few places are kept for far vectors,
    so that a tight group never has edges among its own members only."""
    n = len(x)
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    for start in range(0, n, 512):
        scores = x[start:start + 512] @ x.T
        m = min(POOL, n)
        near = np.argpartition(-scores, m - 1, 1)[:, :m]
        for r in range(len(near)):
            far = rng.integers(0, n, FAR)
            out.append(np.union1d(robust_prune(x, start + r, near[r]), robust_prune(x, start + r, np.unique(far), FAR_DEGREE)))
    into: list[list[int]] = [[] for _ in range(n)]
    for i, to in enumerate(out):
        for j in to:
            into[j].append(i)
    done = []
    for i in range(n):
        back = np.array(into[i], np.int64)
        done.append(np.union1d(out[i], back if len(back) <= DEGREE else robust_prune(x, i, back)))
    return done


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """Starting points: the vectors nearest to the centres of ``count`` local clusters."""
    centres = centres_of(x, min(count, len(x)), rounds=4)
    return np.unique((x @ centres.T).argmax(0))


def search(x: np.ndarray, table: np.ndarray, q: np.ndarray, starts: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Boolean (query, vector): within range, found by greedy search that expands the range.

    ``table`` holds adjacency lists padded with the number of vectors. All queries move at once.
    ``own`` is each query's own place in the shard, a starting point too, or the number of vectors.
    """
    n, m = len(x), len(q)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    score = np.full((m, n + 1), -2.0, np.float32)
    done = np.zeros((m, n + 1), bool)
    done[:, n] = True
    score[:, starts] = q @ x[starts].T
    seen[:, starts] = True
    inside = np.flatnonzero(own < n)
    score[inside, own[inside]] = 1.0
    seen[inside, own[inside]] = True
    active = np.arange(m)
    margin = np.float32(least - 1e-4)
    padded = np.vstack([x, np.zeros((1, x.shape[1]))]).astype(np.float32)
    q32 = q.astype(np.float32)
    while len(active):
        # Open vectors: those of the beam (the best seen so far) and all within range.
        part = np.where(seen[active], score[active], -3.0)
        edge = np.partition(part, n - min(BEAM, n) + 1, 1)[:, n - min(BEAM, n) + 1]
        open_ = np.where(~done[active] & (part >= np.minimum(edge, margin)[:, None]), part, -4.0)
        wide = min(WIDE, n)
        take = np.argpartition(-open_, wide - 1, 1)[:, :wide]
        good = np.take_along_axis(open_, take, 1) > -3.5
        going = good.any(1)
        active, take, good = active[going], take[going], good[going]
        if not len(active):
            break
        take = np.where(good, take, n)
        done[active[:, None], take] = True
        next_ = table[take].reshape(len(active), -1)
        fresh = ~seen[active[:, None], next_]
        row, col = np.nonzero(fresh)
        who, what = active[row], next_[row, col]
        for i in range(0, len(who), 200_000):
            a, b = who[i:i + 200_000], what[i:i + 200_000]
            score[a, b] = np.einsum("ij,ij->i", q32[a], padded[b])
        seen[who, what] = True
    return seen[:, :n] & (score[:, :n] >= margin)


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    lists = build(x)
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "near": pa.array([ids[a] for a in lists], pa.list_(pa.int64()))})


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _search_shard(least: float):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """``left``: a shard's vectors with their lists; ``right``: a block of the cluster's vectors."""
        cluster = key[0].as_py()
        out = {"vec_id": [], "links": [], "root": []}
        if left.num_rows and right.num_rows:
            ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("v"))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            lists = left.column("near").combine_chunks()
            starts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            place = np.searchsorted(ids, values)
            inside = (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == values)
            place = np.where(inside, place, len(ids))
            width = int(np.diff(starts).max(initial=1))
            table = np.full((len(ids) + 1, max(1, width)), len(ids))
            for k, o in enumerate(order):
                row = place[starts[o]:starts[o + 1]]
                table[k, :len(row)] = row
            other = np.array(left.column("clusters").to_pylist(), np.int32)[order]
            q_ids, q = right.column("vec_id").to_numpy(), _matrix(right.column("v"))
            q_other = np.array(right.column("clusters").to_pylist(), np.int32)
            entry = medoids(x)
            for i in range(0, len(q), 512):
                own = np.searchsorted(ids, q_ids[i:i + 512])
                own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == q_ids[i:i + 512]), own, len(ids))
                hit = search(x, table, q[i:i + 512], entry, own, least)
                a, b = np.nonzero(hit)
                a += i
                keep = np.zeros(len(a), bool)
                for s in range(0, len(a), 200_000):
                    part = slice(s, s + 200_000)
                    keep[part] = np.einsum("ij,ij->i", q[a[part]], x[b[part]]) >= least
                keep &= q_ids[a] != ids[b]
                a, b = a[keep], b[keep]
                # Counted where both first meet: in no smaller cluster they share.
                earlier = np.zeros(len(a), bool)
                for c in range(q_other.shape[1]):
                    mine = q_other[a, c]
                    earlier |= (mine < cluster) & (other[b] == mine[:, None]).any(1)
                a, b = a[~earlier], b[~earlier]
                size = min(512, len(q) - i)
                links = np.bincount(a - i, minlength=size)
                all_ids = np.unique(np.concatenate([q_ids[a], ids[b]]))
                root = _roots(len(all_ids), np.searchsorted(all_ids, q_ids[a]), np.searchsorted(all_ids, ids[b]))
                out["vec_id"] += [q_ids[i:i + size], all_ids]
                out["links"] += [links, np.zeros(len(all_ids), np.int64)]
                out["root"] += [q_ids[i:i + size], all_ids[root]]
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in out.items()})
    return run


def _audit(ids: np.ndarray, q: np.ndarray, least: float):
    def run(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                other = batch.column(0).to_numpy()
                total += ((x @ q.T >= least) & (other[:, None] != ids[None, :])).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "true_links"])
    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, shard: int = SHARD, audit: int = AUDIT) -> DataFrame:
    """``vec_id, n_links, component_id, kept, true_links``: links have a cosine of at least ``least``.

    ``true_links`` is the brute-force number for the audited vectors, else null. Vectors that are null,
    zero or hold null or non-finite components link with nothing. Vectors of unequal lengths raise an
    error. Columns other than ``vec_id`` and ``embedding`` are not read.
    """
    rows = staged(unit_rows(vectors), "vectors")
    valid = rows.where("v IS NOT NULL")
    count, low, high = valid.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    blank = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                           F.lit(True).alias("kept"), F.lit(None).cast("long").alias("true_links"))
    if not count:
        return blank
    if low != high:
        raise ValueError(f"vectors have {low} to {high} components")
    picked = valid.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # bounded by SAMPLE
    sample = normed(_matrix(picked.column("v")))
    k = max(1, min(CENTRES, len(sample) // 16, 2 * OVERLAP * count // shard))
    centres = centres_of(sample, k)
    placed = staged(valid.mapInArrow(_assign(centres, min(OVERLAP, k)), "vec_id long, v array<double>, clusters array<int>"), "placed")
    member = placed.select("vec_id", "v", "clusters", F.explode("clusters").alias("cluster"))
    sizes = {r["cluster"]: r["count"] for r in member.groupBy("cluster").count().collect()}  # at most CENTRES
    ways = F.element_at(F.create_map(*[F.lit(int(x)) for c, s in sizes.items() for x in (c, -(-s // shard))]), F.col("cluster"))
    member = member.withColumn("ways", ways)
    nodes = member.withColumn("part", F.pmod(F.xxhash64("vec_id"), "ways").cast("int"))
    lists = nodes.select("cluster", "part", "vec_id", "v").groupBy("cluster", "part").applyInArrow(_build_shard, "vec_id long, near array<long>")
    # One list a vector: at most 2 * DEGREE + FAR_DEGREE from each of OVERLAP shards.
    graph = staged(lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    shards = nodes.join(graph, "vec_id").select("cluster", "part", "vec_id", "v", "clusters", "near")
    # A cluster's vectors search each of its shards, in blocks; a shard goes along with each block.
    blocks = member.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), "ways").cast("int"))
    asking = blocks.select("cluster", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("part"), "block", "vec_id", "v", "clusters")
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])  # its own columns beside those of ``shards``
    shards = shards.withColumn("ways", ways).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    keys = ["cluster", "part", "block"]
    found = staged(shards.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(
        _search_shard(least), "vec_id long, links long, root long"), "found")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    roots = components(found.select("vec_id", "root"), "vec_id", "root")
    audited = picked.slice(0, min(audit, picked.num_rows))
    q = normed(_matrix(audited.column("v")))
    true = placed.select("vec_id", "v").mapInArrow(
        _audit(audited.column("vec_id").to_numpy(), q, least), "vec_id long, true_links long").groupBy("vec_id").agg(F.sum("true_links").alias("true_links"))
    true = staged(true, "audit")
    out = links.join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left").join(F.broadcast(true), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), (component == F.col("vec_id")).alias("kept"), "true_links").union(blank)


def recall(found: DataFrame) -> float:
    """Share of the audited vectors' links that were found (1 if they have none)."""
    got, true = found.where("true_links IS NOT NULL").agg(F.sum("n_links"), F.sum("true_links")).first()
    return got / true if true else 1.0
