"""Exact self-join of texts on the Jaccard similarity of their word shingles, by PartEnum signatures.

A text is the set of its distinct shingles (64-bit hashes). Two sets with Jaccard similarity of at
least ``num / den`` differ in at most ``k`` elements, where ``k`` follows from their sizes, and the
smaller one is no smaller than ``num / den`` of the larger. Sets fall into bands of sizes; band ``i``
has its own ``k`` and its own signatures, and a set also signs for the band above if a partner may
lie there. For a band the domain of elements is dealt into ``n1 = k // 2 + 1`` parts by hash. In at
least one part a similar pair differs in at most one element; each part is dealt into three
sub-parts, and of every two of the three the elements there are hashed to a signature, so that a
similar pair shares one. What shares a signature is verified on the sets.

Equal sets are one node (named by a 64-bit digest, checked by a second one). Members of a signature
are not paired with one another: each is first compared with one centre and links become components. In
rounds of contraction each signature then names a forest of possible links between its members'
components, and what is verified merges them; in each round members take turns differently. Only pairs of
members that are still in different components are compared one by one at the end, which loses no link and
finds the same components as all pairs would. Before sets are fetched, sketches (half a byte for each sub-part)
rule out most pairs: one bit tells whether the sub-part holds an odd number of elements and three are of its
hash, so that a sub-part that differs tells of one element at least, and of two if the numbers are both even
or both odd.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import mix, release, semi, shingles, slices, staged, text_bytes, word_hashes
from sequela.llm.components import components

BAND_RATIO = 1.5
BLOCK = 4096
"""Members of a signature that are compared with one another in one go."""

DENSE = 512
"""Members of a signature from which their sets go along, so that only links that join components
come out of the group and not all of its close pairs. Sets are fetched only for members that the sketches
leave in some pair."""

PAIRS = 1 << 16
"""Pairs of members that a task looks at in one go (of one member at least, with all others of its group) ..."""

SKETCH_BYTES = 1 << 20
"""... and bytes of their sketches."""

TEXT_BYTES = 1 << 18
"""Bytes of texts that a task turns into sets in one go; the arrays made on the way take some 60 times that."""

BATCH = 2000
"""Texts or sets that a task is handed at once ..."""

SHORT_ROWS = 10_000
"""... and rows of signatures and sketches. Either way no more bytes than a stage bounds."""

CONTRACTIONS = 2
"""Rounds in which every signature names no more pairs than its members less one, before the pairs that are
still open are named."""

PAIR, TRIPLE = ((0, 1), (0, 2), (1, 2)), 3


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``k`` words; a link from ``num / den`` on."""

    k: int = 5
    num: int = 80
    den: int = 100

    def allowed(self, size: np.ndarray) -> np.ndarray:
        """Most elements in which two sets of at most ``size`` may differ."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def bands(self, largest: int) -> np.ndarray:
        """Smallest size of each band, up to two past that of ``largest``. A band is the same whatever
        ``largest`` is, as sets of different batches must agree on it."""
        ratio = max(BAND_RATIO, self.den / self.num)
        lows = [1]
        while len(lows) < 3 or lows[-2] <= largest:
            lows.append(int(np.ceil(lows[-1] * ratio)) if lows[-1] > 2 else lows[-1] + 1)
        return np.array(lows, np.int64)


def sets_of(column: pa.Array, how: Similarity, seed: int) -> Iterator[tuple]:
    """Per run of texts: first text, sorted hashes, sizes, digest of each set as two 64-bit values."""
    data, offsets = text_bytes(column)
    for first, end in slices(offsets, TEXT_BYTES):
        part = offsets[first:end + 1]
        words, counts = word_hashes(data[part[0]:part[-1]], part - part[0])
        hashes, sizes = shingles(words, counts, how.k)
        yield first, end, hashes, sizes, *digests(hashes, sizes, seed)


def digests(hashes: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    filled = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[filled]
    for turn in (2 * seed + 100, 2 * seed + 101):
        value = np.zeros(len(sizes), np.uint64)
        with np.errstate(over="ignore"):
            if len(starts):
                value[filled] = np.add.reduceat(mix(hashes, turn), starts)
            out.append(mix(value + sizes.astype(np.uint64), turn).view(np.int64))
    return out[0], out[1]


def sub_parts(hashes: np.ndarray, sizes: np.ndarray, how: Similarity, up: int):
    """Hashes of all sub-parts of the sets in their own band (``up`` 0) or the one above (1; only sets
    that may have a partner there): owner of each part, number of the part, band, and an array with a
    row of sub-parts for each part. Sets that are similar to equal ones only are left out."""
    lows = how.bands(int(sizes.max(initial=1)))
    band = np.searchsorted(lows, sizes, "right") - 1
    starts = np.cumsum(sizes) - sizes
    above = sizes * how.den >= lows[np.minimum(band + 1, len(lows) - 1)] * how.num
    who = np.flatnonzero((sizes > 0) & (above if up else True))
    place = band[who] + up
    allowed = how.allowed(lows[place + 1] - 1)
    who, place, allowed = who[allowed > 0], place[allowed > 0], allowed[allowed > 0]
    if not len(who):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TRIPLE), np.uint64)
    parts = allowed // 2 + 1
    length = sizes[who]
    inside = np.repeat(np.arange(len(who)), length)
    take = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    items = hashes[np.repeat(starts[who], length) + take]
    with np.errstate(over="ignore"):
        spread = mix(items, 21) >> np.uint64(20)
        cell = (spread % (parts[inside] * TRIPLE).astype(np.uint64)).astype(np.int64)
        base = np.cumsum(parts * TRIPLE) - parts * TRIPLE
        sums = np.zeros(int((parts * TRIPLE).sum()), np.uint64)
        target = base[inside] + cell
        order = np.argsort(target, kind="stable")
        target, terms = target[order], mix(items, 22)[order] | np.uint64(1)  # the sum is odd where the number is
        edge = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        sums[target[edge]] = np.add.reduceat(terms, edge)
    owner = np.repeat(who, parts)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    return owner, part, np.repeat(place, parts), sums.reshape(-1, TRIPLE)


def signatures(hashes: np.ndarray, sizes: np.ndarray, how: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of the sets that lie one after the other in ``hashes``. A signature's lowest bit
    is that of its band's number, which tells the sketches of a set in its two bands apart."""
    owners, values = [], []
    for up in (0, 1):
        owner, part, place, sums = sub_parts(hashes, sizes, how, up)
        with np.errstate(over="ignore"):
            name = mix((place << 40).astype(np.uint64) + part.astype(np.uint64), 23)
            for j, (x, y) in enumerate(PAIR):
                owners.append(owner)
                value = mix(mix(sums[:, x], 24) + mix(sums[:, y], 25) + name, 26 + j).view(np.int64)
                values.append(value & ~1 | place & 1)
    return np.concatenate(owners), np.concatenate(values)


def sketches(hashes: np.ndarray, sizes: np.ndarray, how: Similarity, up: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of the sets that have sub-parts in the band: owner, band, and half a byte for each sub-part."""
    owner, _, place, sums = sub_parts(hashes, sizes, how, up)
    who, first = np.unique(owner, return_index=True)
    cells = (mix(sums, 31) >> np.uint64(60)).astype(np.uint8) & 14 | (sums & np.uint64(1)).astype(np.uint8)
    flat, ends = cells.tobytes(), np.append(first[1:], len(owner)) * TRIPLE
    out = []
    for a, b in zip(first * TRIPLE, ends):
        cell = np.frombuffer(flat, np.uint8, b - a, a)
        if len(cell) % 2:
            cell = np.append(cell, np.uint8(0))
        out.append((cell[::2] | cell[1::2] << 4).tobytes())
    return who, place[first], out


def _digest_rows(how: Similarity, seed: int):
    def run(batches):
        for batch in batches:
            ids, text, told = batch.column(0), batch.column(1), batch.column(2)
            for first, end, _, sizes, one, two in sets_of(text, how, seed):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), told.slice(first, end - first), pa.array(sizes), pa.array(one), pa.array(two)],
                    ["doc_id", "told", "n_shingles", "node", "check"])
    return run


def _signature_rows(how: Similarity, seed: int):
    def run(batches):
        for batch in batches:
            for _, _, hashes, sizes, node, _ in sets_of(batch.column(1), how, seed):
                owner, value = signatures(hashes, sizes, how)
                both = np.stack([value, node[owner]], 1)
                both = both[np.lexsort((both[:, 1], both[:, 0]))]
                if len(both):
                    new = np.append(True, (both[1:] != both[:-1]).any(1))
                    both = both[new]
                for i in range(0, len(both), 200_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(both[i:i + 200_000, 0]), pa.array(both[i:i + 200_000, 1])], ["sig", "node"])
    return run


def _shared_runs(batches):
    """From rows sorted by signature and node: the signatures that several nodes share, with the
    smallest node of each, every node once. Holds one batch at a time; a run may go over many."""
    held = None  # last row seen, not yet known to share: (sig, node)
    current = first = None
    for batch in batches:
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        if held is not None:
            sig, node = np.append(held[0], sig), np.append(held[1], node)
        fresh = np.append(True, sig[1:] != sig[:-1])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), 0))
        lead = node[at]
        if current is not None:
            carried = np.cumsum(fresh) == 1
            same = carried & (sig == current)
            lead = np.where(same, first, lead)
        new = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        run = np.cumsum(fresh) - 1
        largest = np.zeros(run[-1] + 1, np.int64)
        np.maximum.at(largest, run, (node != lead).astype(np.int64))
        shared = (largest[run] > 0)
        open_ended = run == run[-1]
        out = shared & new
        if not shared[-1]:  # a single node so far: wait for the next batch
            out &= ~open_ended
            held, current, first = (sig[-1], node[-1]), None, None
        else:
            held, current, first = (sig[-1], node[-1]), sig[-1], lead[-1]
            out &= ~(open_ended & (node == node[-1]))  # the open run of repeats comes again with the next batch, as one row
        if out.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[out]), pa.array(node[out]), pa.array(lead[out])], ["sig", "node", "first"])
    if held is not None and current is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([first], pa.int64())],
            ["sig", "node", "first"])


def _set_rows(how: Similarity, seed: int):
    def run(batches):
        for batch in batches:
            for _, _, hashes, sizes, node, _ in sets_of(batch.column(1), how, seed):
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node),
                     pa.array([hashes[e - s:e].tobytes() for s, e in zip(sizes, ends)], pa.binary())],
                    ["node", "items"])
    return run


def _sketch_rows(how: Similarity, seed: int):
    def run(batches):
        for batch in batches:
            for _, _, hashes, sizes, node, _ in sets_of(batch.column(1), how, seed):
                for up in (0, 1):
                    who, place, data = sketches(hashes, sizes, how, up)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[who]), pa.array(place & 1), pa.array(place), pa.array(sizes[who]), pa.array(data, pa.binary())],
                        ["node", "odd", "band", "n", "sketch"])
    return run


SKETCH = "node long, odd long, band long, n long, sketch binary"
PAIR_ROWS = "a long, b long, sure boolean"


def may_be_similar(n: np.ndarray, sketch: np.ndarray, i: int, others: np.ndarray, how: Similarity) -> np.ndarray:
    """Which of ``others`` (sketches of the same band) may be similar to ``i``: similar sets differ in no more
    elements than their sizes allow, and the sketches tell a number of elements in which they do."""
    differ = (n[i] + n[others]) * (how.den - how.num) // (how.den + how.num)
    both = LEAST[sketch[others] ^ sketch[i]]
    return both.sum(1, dtype=np.int64) <= differ


def _least() -> np.ndarray:
    """For each byte by which two sketches differ (two sub-parts), the elements that differ at least."""
    half = np.array([0 if not x else 1 if x & 1 else 2 for x in range(16)], np.uint8)
    return half[np.arange(256) & 15] + half[np.arange(256) >> 4]


LEAST = _least()
LOWEST = np.uint64(0x1111111111111111)


def _close_pairs(how: Similarity, turn: int | None = None):
    """From rows of (signature, block, block) and band, sorted: pairs of members in different components
    whose sketches do not rule them out. Where the sets are there, pairs are verified at once and a
    pair that earlier links of the group have joined is skipped. With ``turn`` no pair is named that those
    named before would join if they were links: a forest. Holds a batch and one group, of two blocks at most."""
    return _by_groups(lambda rows: _named_pairs(rows, how, turn))


def _close_members(how: Similarity):
    """Of the same rows those whose member is in a pair that :func:`_close_pairs` would name, each once."""
    return _by_groups(lambda rows: _members_met(rows, how))


def _by_groups(step):
    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            last = _group_starts(rows[0])[-1]
            if last:
                yield from step(rows[0].slice(0, last))
            held = rows[0].slice(last)
        if held is not None:
            yield from step(held)
    return run


def _group_starts(rows: pa.RecordBatch) -> np.ndarray:
    """First row of each run of equal (key, band)."""
    key, band = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (band[1:] != band[:-1])))


def _may_link(rows: pa.RecordBatch, starts: np.ndarray, sizes: np.ndarray, root: np.ndarray, how: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of the pairs of whole groups in different components (as ``root`` is by then) that sizes and
    sketches do not rule out, some members at a time."""
    n, side = (rows.column(k).to_numpy() for k in (4, 5))
    end, sketch = np.repeat(starts + sizes, sizes), rows.column(6)
    offsets = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset:sketch.offset + rows.num_rows + 1]
    length = np.diff(offsets)
    tables, place = _sketch_tables(np.frombuffer(sketch.buffers()[2], np.uint8), offsets)

    after = end - 1 - np.arange(rows.num_rows)  # members that a row meets: those after it in its group
    total = np.append(0, np.cumsum(after))
    at = 0
    while at < rows.num_rows:
        stop = max(int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1, at + 1)
        met = after[at:stop]
        i = np.repeat(np.arange(at, stop), met)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(met) - met, met)
        at = stop
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        good = (root[i] != root[j]) & ((side[i] == 2) | (side[i] != side[j])) & (how.den * small >= how.num * large)
        i, j = i[good], j[good]
        good = _sketches_agree(tables, place, length, n, i, j, how)
        yield i[good], j[good]


def _members_met(rows: pa.RecordBatch, how: Similarity) -> Iterator[pa.RecordBatch]:
    """The rows of whole groups that are in a pair, see :func:`_close_members`."""
    starts = _group_starts(rows)
    met = np.zeros(rows.num_rows, bool)
    for i, j in _may_link(rows, starts, np.diff(np.append(starts, rows.num_rows)), rows.column(3).to_numpy(), how):
        met[i] = met[j] = True
    if met.any():
        yield rows.filter(pa.array(met))


def _named_pairs(rows: pa.RecordBatch, how: Similarity, turn: int | None) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups, see :func:`_close_pairs`."""
    starts = _group_starts(rows)
    sizes = np.diff(np.append(starts, rows.num_rows))
    if turn is not None:
        place = mix(rows.column(2).to_numpy().view(np.uint64), 31 + turn)
        rows = rows.take(pa.array(np.lexsort((place, np.repeat(np.arange(len(sizes)), sizes)))))
    node, root = (rows.column(k).to_numpy() for k in (2, 3))
    root = root.copy()
    first, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    items = rows.column(7)
    has_sets = items.is_valid().to_numpy(zero_copy_only=False)

    for i, j in _may_link(rows, starts, sizes, root, how):
        one_by_one = has_sets[i] if turn is None else np.ones(len(i), bool)
        a, b, sure = [node[i[~one_by_one]]], [node[j[~one_by_one]]], [np.zeros(int((~one_by_one).sum()), bool)]
        i, j = i[one_by_one], j[one_by_one]
        edges = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i)) if len(i) else []
        for low, high in zip(edges[:-1], edges[1:]):
            row, others = i[low], j[low:high]
            group = root[first[row]:end[row]]
            mine = np.frombuffer(items[row].as_buffer(), np.uint64) if has_sets[row] else None
            joined = []
            while len(others := others[root[others] != root[row]]):
                other, others = others[0], others[1:]
                if mine is None or similar(mine, np.frombuffer(items[other].as_buffer(), np.uint64), how):
                    group[group == root[other]] = root[row]
                    joined.append(other)
            a.append(np.full(len(joined), node[row]))
            b.append(node[np.array(joined, np.int64)])
            sure.append(np.full(len(joined), mine is not None))
        a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure)], ["a", "b", "sure"])


def _sketch_tables(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The sketches of each length as rows of 64-bit words, filled up with zeros, and the place of each sketch among those of its length."""
    length = np.diff(offsets)
    place, tables = np.zeros(len(length), np.int64), {}
    for size in np.unique(length).tolist():
        of = np.flatnonzero(length == size)
        place[of] = np.arange(len(of))
        rows = np.zeros((len(of), -(-size // 8) * 8), np.uint8)
        step = max(1, SKETCH_BYTES // max(size, 1))
        for k in range(0, len(of), step):
            rows[k:k + step, :size] = data[offsets[of[k:k + step]][:, None] + np.arange(size)]
        tables[size] = rows.view(np.uint64)
    return tables, place


def _sketches_agree(tables: dict[int, np.ndarray], place: np.ndarray, length: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, how: Similarity) -> np.ndarray:
    """Which of the pairs (i, j), rows of the same bands, :func:`may_be_similar` would let pass. Of half a byte that
    differs one element does where the lowest bit differs, and two where others do only."""
    differ = (n[i] + n[j]) * (how.den - how.num) // (how.den + how.num)
    good = np.zeros(len(i), bool)
    size_of = length[i]
    for size in np.unique(size_of).tolist():
        of, table = np.flatnonzero(size_of == size), tables[size]
        step = max(1, SKETCH_BYTES // max(table.shape[1] * 8, 1))
        for k in range(0, len(of), step):
            part = of[k:k + step]
            x = table[place[i[part]]] ^ table[place[j[part]]]
            one = np.bitwise_count(x & LOWEST).sum(1, dtype=np.int64)
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            good[part] = 2 * np.bitwise_count(x & LOWEST).sum(1, dtype=np.int64) - one <= differ[part]
    return good


def _close_stars(how: Similarity):
    def run(batches):
        for batch in batches:
            c = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            good = []
            for na, nb, x, y in zip(c["na"], c["nb"], c["x"], c["y"]):
                n, data = np.array([na, nb]), np.frombuffer(x + y, np.uint8).reshape(2, -1)
                good.append(how.den * min(na, nb) >= how.num * max(na, nb) and bool(may_be_similar(n, data, 0, np.array([1]), how)[0]))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def similar(x: np.ndarray, y: np.ndarray, how: Similarity) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return how.den * common >= how.num * (len(x) + len(y) - common)


def _verified(how: Similarity):
    def run(batches):
        for batch in batches:
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), how)
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def sets_for(docs: DataFrame, nodes: DataFrame, reps: DataFrame, how: Similarity, seed: int) -> DataFrame:
    """``node, items`` of the given nodes, from one document each."""
    wanted = staged(reps.join(nodes.distinct(), "node").select(F.col("rep").alias("doc_id")), "reps")
    sets = staged(semi(docs, wanted, "doc_id").mapInArrow(_set_rows(how, seed), "node long, items binary")
                  .dropDuplicates(["node"]), "sets", BATCH)
    release(wanted)
    return sets


def linked(docs: DataFrame, pairs: DataFrame, reps: DataFrame, how: Similarity, seed: int) -> DataFrame:
    """Those of the staged pairs (a, b) whose sets are similar enough; sets are made for them only."""
    sets = sets_for(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), reps, how, seed)
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    good = staged(rows.mapInArrow(_verified(how), "a long, b long"), "similar", BATCH)
    release(sets)
    return good


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``sig, node, root, size`` of the signatures with members in several components, each set of members once."""
    labelled = staged(members.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root")), "labelled")
    alike = labelled.groupBy("sig").agg(
        F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"), F.count("*").alias("size"),
        F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    mixed = staged(alike.groupBy("x", "y", "size").agg(F.min("sig").alias("sig")).select("sig", "size"), "mixed")
    found = staged(labelled.join(mixed, "sig"), "open")
    release(labelled, mixed)
    return found


def _met(open_: DataFrame) -> DataFrame:
    """The members of each signature by pairs of blocks: ``key, node, root, side, size, odd``."""
    ways = F.ceil(F.col("size") / BLOCK).cast("int")
    blocked = open_.withColumn("ways", ways).withColumn("own_block", F.pmod("node", "ways").cast("int"))
    met = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    low, high = F.least("own_block", "other"), F.greatest("own_block", "other")
    side = F.when(low == high, 2).when(F.col("own_block") == low, 0).otherwise(1)
    return met.select(F.xxhash64("sig", low, high).alias("key"), "node", "root", side.alias("side"), "size",
                      F.col("sig").bitwiseAND(F.lit(1)).alias("odd"))


def groups(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id reachable
    by links, itself included.

    Null and blank texts have the empty set and link with nothing. Rows without a doc_id link with nothing
    and have no component_id; rows that repeat a doc_id are listed as often as they come and link like any others.
    Columns other than ``doc_id`` and ``text`` are not read.
    """
    return _grouped(docs, how).select("doc_id", "n_shingles", "component_id")


TOLD = "xxhash64(coalesce(cast(text AS string), ''))"
"""Tells texts of one doc_id apart."""

DIGESTS = "doc_id long, told long, n_shingles long, node long, check long"


def _grouped(docs: DataFrame, how: Similarity) -> DataFrame:
    """The columns of :func:`groups` with ``told`` and the component's node ``root`` (null for empty sets)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr(TOLD).alias("told"))
    unnamed, read = read.where("doc_id IS NULL"), read.where("doc_id IS NOT NULL")
    docs = read.select("doc_id", "text")
    for seed in range(100):  # a 64-bit name that two different sets share is found and another taken
        named = staged(read.mapInArrow(_digest_rows(how, seed), DIGESTS), "digests", BATCH)
        nodes = staged(named.where("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"),
            F.min("check").alias("c0"), F.max("check").alias("c1")), "nodes")
        if nodes.where("c0 <> c1").isEmpty():
            break
        release(named, nodes)

    signed = docs.mapInArrow(_signature_rows(how, seed), "sig long, node long")
    members = staged(signed.repartition("sig").sortWithinPartitions("sig", "node")
                     .mapInArrow(_shared_runs, "sig long, node long, first long"), "members", SHORT_ROWS)
    wanted = members.select("node").distinct()
    reps = staged(nodes.join(wanted, "node").select("node", "rep"), "named")
    sketched = staged(semi(docs, staged(reps.select(F.col("rep").alias("doc_id")), "reps"), "doc_id")
                      .mapInArrow(_sketch_rows(how, seed), SKETCH).dropDuplicates(["node", "odd"]), "sketches", BATCH)

    # Each node against the centre it shares most signatures with ...
    odd = F.col("sig").bitwiseAND(F.lit(1)).alias("odd")
    shared = members.where("node <> first").groupBy(F.col("node").alias("b"), F.col("first").alias("a"), odd).agg(F.count("*").alias("c"))
    star = shared.groupBy("b").agg(F.max_by(F.struct("a", "odd"), F.struct("c", "a", "odd")).alias("to")).select("b", "to.*")
    x = sketched.select(F.col("node").alias("a"), "odd", "band", F.col("n").alias("na"), F.col("sketch").alias("x"))
    y = sketched.select(F.col("node").alias("b"), "odd", "band", F.col("n").alias("nb"), F.col("sketch").alias("y"))
    star = staged(star.join(x, ["a", "odd"]).join(y, ["b", "odd", "band"]).mapInArrow(_close_stars(how), "a long, b long"), "stars", SHORT_ROWS)
    links = linked(docs, star, reps, how, seed)
    roots = staged(components(links, "a", "b"), "roots")

    # ... then forests between components, and at the end what is still open.
    row = ["key", "band", "node", "root", "n", "side", "sketch"]
    for turn in range(CONTRACTIONS):
        open_ = _open(members, roots)
        named_pairs = (_met(open_).join(sketched, ["node", "odd"]).select(*row, F.lit(None).cast("binary").alias("items"))
                       .repartition("key").sortWithinPartitions("key", "band").mapInArrow(_close_pairs(how, turn), PAIR_ROWS))
        forest = staged(named_pairs.select("a", "b").distinct(), "forest", SHORT_ROWS)
        more = linked(docs, forest, reps, how, seed)
        before, links = (links, roots), staged(links.union(more), "links")
        roots = staged(components(links, "a", "b"), "roots")
        release(open_, forest, more, *before)
    open_ = _open(members, roots)
    rows = _met(open_).join(sketched, ["node", "odd"]).select(*row, F.lit(None).cast("binary").alias("items"), "size")
    few = rows.where(F.col("size") <= DENSE).drop("size").repartition("key").sortWithinPartitions("key", "band")
    few = staged(few.mapInArrow(_close_pairs(how), PAIR_ROWS).distinct(), "close", SHORT_ROWS)
    many = rows.where(F.col("size") > DENSE).drop("size").repartition("key").sortWithinPartitions("key", "band")
    many = staged(many.mapInArrow(_close_members(how), many.schema), "dense", SHORT_ROWS)
    sets = sets_for(docs, many.select("node"), reps, how, seed)
    met = many.drop("items").join(sets, "node").select(*row, "items").repartition("key").sortWithinPartitions("key", "band")
    sure = staged(met.mapInArrow(_close_pairs(how), PAIR_ROWS).distinct(), "close", BATCH)
    more = sure.select("a", "b").union(linked(docs, few, reps, how, seed))
    roots = staged(components(links.union(more), "a", "b"), "roots")

    by_node = nodes.join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "rep")
    smallest = by_node.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = by_node.join(smallest, "root").select("node", "root", "component_id")
    release(members, open_, reps, sketched, few, many, sets, sure, star)
    alone = unnamed.mapInArrow(_digest_rows(how, seed), DIGESTS).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "told", F.lit(None).cast("long").alias("root"))
    return named.join(classes, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "told", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root")).union(alone)


def one_of_each(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """The documents, of each component only the row with the smallest doc_id (then the smallest hash of its
    text). A doc_id that comes with different texts is a document for each text. All columns are kept, and so are
    rows without a doc_id and rows whose text has no words."""
    found = staged(_grouped(docs, how).where("doc_id IS NOT NULL AND root IS NOT NULL")
                   .groupBy("root", "doc_id", "told").agg(F.count("*").alias("many")), "found", BATCH)
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "told", "many")).alias("best")).select("best.*")
    best = staged(best, "best")
    key = ["doc_id", "told"]
    gone = staged(found.join(best, key, "left_anti").select(*key), "gone")
    twice = staged(best.where("many > 1").select(*key), "twice")
    names = {"doc_id": "_one_id", "told": "_one_told"}
    rows = docs.withColumns({"_one_id": F.col("doc_id").cast("long"), "_one_told": F.expr(TOLD)})
    gone, twice = (t.withColumnsRenamed(names) for t in (gone, twice))
    key = [*names.values()]
    kept = rows.join(gone, key, "left_anti")
    out = kept.join(twice, key, "left_anti").union(kept.join(twice, key, "left_semi").dropDuplicates(key))
    release(found, best)
    return out.select(*docs.columns)
