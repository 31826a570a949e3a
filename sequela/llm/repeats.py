"""Removal of byte strings that occur more than once, by merged Burrows-Wheeler transforms.

A byte goes where a string of ``WINDOW`` bytes that covers it also starts anywhere else. The work has
three parts.

*Sieve.* Every window has an anchor: of its strings of ``GRAM`` bytes the one with the smallest hash,
the last of equals. Equal windows have equal anchors at equal places, so a window whose anchor comes
once is unique. What is left is cut into pieces and sorted by the pieces' smallest anchor, which
brings copies of a passage near each other, and dealt into shards of bounded size.

*Shards.* A window is a word of ``DEPTH`` letters of ``LETTER`` bytes (letters are ordered by 64-bit
hashes of their bytes). Each shard sorts its suffixes by one letter after the other; neighbours with a
common prefix of ``DEPTH`` letters are repeated windows.

*Merge.* An anchor's windows lie in its context, a few hundred bytes. Where shards hold the same context,
all its windows are repeated and the first of these shards brings them to the merge for all. Windows of an anchor
that then still lies in several shards are merged without sorting suffixes again: in round h the merged order by h letters follows from that by h - 1 letters and the letter that comes
before (the Burrows-Wheeler letter), by a stable counting of (letter, interval) pairs. A pair's place in the
order is the new interval. An interval held by one shard only is settled, since shards know
their own repeats, and leaves; what is in an interval of several shards after the last round has a
common prefix of ``WINDOW`` bytes with another shard and is repeated. Counts are combined before
they are shuffled, so a passage in very many documents is one row a task.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import BYTE, STEP, mix, release, semi, shared_folder, slices, staged, text_bytes
from sequela.operators.joins import lookup

GRAM = 64
LETTER, DEPTH = 50, 4
WINDOW = LETTER * DEPTH
"""Strings of this many bytes that occur twice are removed."""

SHARD = 1 << 20
"""Bytes of pieces in a shard, about (the last piece may exceed it); ``rep`` has room for 8 million windows."""

PIECE = 16
"""Anchors of a piece on average (a piece ends where the text says so), at most 32 times as many."""

PART = 1 << 19
"""Positions hashed at a time."""

TEXTS = "text_no long, copies long, digest binary, text string, hashes array<long>, places array<long>"
PIECES = "key long, text_no long, first long, copies long, data binary, hashes array<long>, places array<long>"
SHARDS = ("shard long, data binary, ends array<long>, text_nos array<long>, firsts array<long>, copies array<long>, "
          "anchors array<long>, hashes array<long>, places array<long>, contexts array<long>")
FOUND = "text_no long, lo long, hi long, rep long, l1 long, l2 long, l3 long, l4 long"
"""A run of repeated windows, or (with ``rep``: 40 bits for the shard, 23 for the window, a bit if it is the
only one of its kind there) a window for the merge with its letters."""


# ── Hashes and anchors ───────────────────────────────────────────────────────────────────────

@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and STEP ** -i modulo 2 ** 64."""
    out = []
    with np.errstate(over="ignore"):
        for base in (STEP, pow(STEP, -1, 1 << 64)):
            row = np.full(n, np.uint64(base))
            row[:1] = 1
            out.append(np.cumprod(row))
    return tuple(out)


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every string of ``length`` bytes."""
    count = len(data) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(PART + 256)
    out = np.empty(count, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, count, PART):
            part = data[at:at + PART + length - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE[part] * up[:len(part)], out=sums[1:])
            n = len(part) - length + 1
            out[at:at + n] = (sums[length:] - sums[:n]) * down[:n]
    return mix(out, 21)


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each string data[first:end], lengths as they come."""
    up, down = _powers(1 << max(21, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[data] * up[:len(data)], out=sums[1:])
        return mix((sums[end] - sums[first]) * down[first] + mix((end - first).astype(np.uint64), 4), 22)


def _smallest(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours, by doubling."""
    width = 1
    while 2 * width <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = span - width
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each anchor and the first window that has it, with the number of windows at the end.

    Windows with the same anchor are neighbours, so one anchor's end where the next one's begin.
    """
    windows = len(data) - WINDOW + 1
    span = WINDOW - GRAM + 1
    hashes = gram_hashes(data, GRAM)
    bits = np.uint64(20)
    mask = np.uint64((1 << 20) - 1)
    at = np.empty(windows, np.int64)
    for low in range(0, windows, PART):  # places within a part fit the low bits
        part = hashes[low:low + PART + span - 1]
        place = mask - np.arange(len(part), dtype=np.uint64)
        small = _smallest((part >> bits << bits) | place, span)
        at[low:low + PART] = low + (mask - (small & mask)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return hashes[at[new]].view(np.int64), np.append(new, windows)


def _lists(arrays: list[np.ndarray], kind=pa.int64()) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _anchor_rows(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        for first, end in slices(offsets):
            found = [anchors(data[offsets[i]:offsets[i + 1]]) for i in range(first, end)]
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], part.column(3).cast(pa.string()), _lists([f[0] for f in found]), _lists([f[1] for f in found])],
                [c.split()[0] for c in TEXTS.split(", ")])


# ── Pieces and shards ────────────────────────────────────────────────────────────────────────

def _cuts(hashes: np.ndarray, marked: np.ndarray):
    """Runs (first, end) of marked anchors, ended early where the text says so."""
    edge = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
    stops = mix(hashes.view(np.uint64), 9) % np.uint64(PIECE) == 0
    for first, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        inner = first + 1 + np.flatnonzero(stops[first + 1:end])
        for a, b in zip([first, *inner], [*inner, end]):
            for c in range(a, b, 32 * PIECE):
                yield c, min(c + 32 * PIECE, b)


def _piece_rows(batches):
    """Columns text_no, copies, text, hashes, places, shared -> pieces."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        numbers, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows, size = [], 0
        for i in range(len(batch)):
            hashes, places = (np.asarray(batch.column(c)[i].values) for c in (3, 4))
            marked = np.isin(hashes, np.asarray(batch.column(5)[i].values))
            for a, b in _cuts(hashes, marked):
                lo, hi = places[a], places[b]
                rows.append((hashes[a:b].min(), numbers[i], lo, copies[i],
                             data[offsets[i] + lo:offsets[i] + hi - 1 + WINDOW].tobytes(), hashes[a:b], places[a:b + 1] - lo))
                size += hi - lo
                if size > PART:
                    yield _piece_batch(rows)
                    rows, size = [], 0
        yield _piece_batch(rows)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["key", "text_no", "first", "copies", "data", "hashes", "places"]
    plain = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
    return pa.RecordBatch.from_arrays(
        [*plain, pa.array([r[4] for r in rows], pa.binary()), _lists([r[5] for r in rows]), _lists([r[6] for r in rows])], names)


def _packed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    data = table.column("data").to_pylist()
    plain = {c: table.column(c).to_numpy() for c in ("text_no", "first", "copies")}
    lists = {c: pa.concat_arrays(table.column(c).chunks) for c in ("hashes", "places")}
    ends, counts = np.cumsum([len(d) for d in data]), np.asarray(pc.list_value_length(lists["hashes"])).astype(np.int64)
    places = np.asarray(lists["places"].flatten())
    data = b"".join(data)
    # An anchor's context is the text of all its windows: from its first to the end of its last.
    last = np.cumsum(counts + 1) - 1
    base = np.repeat(np.append(0, ends[:-1]), counts)
    first, end = base + np.delete(places, last), base + np.delete(places, last - counts) + WINDOW - 1
    contexts = span_hashes(np.frombuffer(data, np.uint8), first, end).view(np.int64)
    arrays = [ends, *plain.values(), counts, np.asarray(lists["hashes"].flatten()), places, contexts]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([data], pa.binary()), *(_lists([a]) for a in arrays)],
        [c.split()[0] for c in SHARDS.split(", ")])


def _shard_rows(limit: int):
    """Pieces of one sorted partition -> one row for about every ``limit`` bytes."""
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 18
        held, size = [], 0
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(4)))
            at = 0
            while at < len(batch):
                room = int(np.searchsorted(np.cumsum(sizes[at:]), max(limit - size, 1), "left")) + 1
                held.append(batch.slice(at, room))
                size += int(sizes[at:at + room].sum())
                at += room
                if size >= limit:
                    yield _packed(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield _packed(number, held)
    return run


# ── One shard's transform ────────────────────────────────────────────────────────────────────

def _ranks(codes: np.ndarray) -> np.ndarray:
    """Dense rank of every value."""
    order = np.argsort(codes)
    sorted_ = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    out = np.empty(len(codes), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32) - 1
    return out


def suffix_ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all positions, and each position's place among all strings of DEPTH letters:
    equal places, and only they, have that prefix in common."""
    letters = gram_hashes(data, LETTER)
    first = _ranks(letters)
    depth = first
    for _ in range(DEPTH - 1):
        n = len(depth) - LETTER
        if n <= 0:
            return letters, np.zeros(0, np.int32)
        depth = _ranks(first[:n].astype(np.int64) * (len(first) + 1) + depth[LETTER:LETTER + n])
    return letters, depth


def _runs(mask: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values within one owner."""
    go = np.zeros(len(mask), bool)
    go[1:] = mask[1:] & mask[:-1] & (owner[1:] == owner[:-1])
    first = np.flatnonzero(mask & ~go)
    last = np.flatnonzero(mask & ~np.append(go[1:], False))
    return first, last


def _shard_found(batches):
    """Per shard, with the contexts that other shards hold too (``whole``) and those that it brings to the
    merge (``split``): runs of repeated windows, and one window of each kind for the merge."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(batch.schema.get_field_index(c))[i] for c in batch.schema.names}
            data = np.frombuffer(row["data"].as_buffer(), np.uint8)
            ends, text_nos, firsts, copies, counts, contexts, places = (
                np.asarray(row[c].values) for c in ("ends", "text_nos", "firsts", "copies", "anchors", "contexts", "places"))
            whole, split = (np.zeros(0, np.int64) if row[c].values is None else np.asarray(row[c].values) for c in ("whole", "split"))
            starts = np.append(0, ends[:-1])
            # ``places`` holds an anchor's first window and, after a piece's last, the number of windows.
            last = np.cumsum(counts + 1) - 1
            windows = places[last]
            piece = np.repeat(np.arange(len(ends), dtype=np.int32), windows)
            inside = (np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
            where = (starts[piece] + inside).astype(np.int32)
            spans = np.delete(np.diff(places), last[:-1])
            letters, depth = suffix_ranks(data)
            kinds = depth[where]
            weight = np.bincount(kinds, weights=copies[piece], minlength=1)
            again = (weight[kinds] > 1) | np.repeat(np.isin(contexts, whole), spans)
            a, b = _runs(again, piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(text_nos[piece[a]]), pa.array(firsts[piece[a]] + inside[a]), pa.array(firsts[piece[a]] + inside[b] + 1),
                 *[pa.nulls(len(a), pa.int64())] * 5], names)

            met = np.flatnonzero(np.repeat(np.isin(contexts, split), spans))
            met = met[np.unique(kinds[met], return_index=True)[1]]
            for low in range(0, len(met), 100_000):
                m = met[low:low + 100_000]
                lo = firsts[piece[m]] + inside[m]
                rep = row["shard"].as_py() << 24 | np.arange(low, low + len(m)) << 1 | ~again[m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text_nos[piece[m]]), pa.array(lo), pa.array(lo + 1), pa.array(rep), *[pa.array(letters[where[m] + LETTER * d].view(np.int64)) for d in range(DEPTH)]], names)


# ── The merge ────────────────────────────────────────────────────────────────────────────────

def _places(batches):
    """Running place of each interval within its sorted partition."""
    from pyspark import TaskContext

    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.column(2).to_numpy()
        before = done + np.cumsum(size) - size
        done += int(size.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.full(len(size), part), pa.int32()), pa.array(before), batch.column(2)],
            ["letter", "interval", "part", "before", "size"])


def refined(rows: DataFrame, letter: str) -> DataFrame:
    """One round: staged ``rows`` with an ``interval`` by the next letter in front of it. Rows in an interval
    of one shard are left out; the others' ``interval`` is its place in the merged order."""
    keys = ["letter", "interval"]
    pairs = rows.groupBy(F.col(letter).alias("letter"), "interval").agg(
        F.count("*").alias("size"), F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("shiftright(r0, 24) < shiftright(r1, 24)")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select(*keys, "size").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    pairs = staged(pairs.mapInArrow(_places, "letter long, interval long, part int, before long, size long"), "intervals")
    totals = dict(sorted(tuple(r) for r in pairs.groupBy("part").agg(F.sum("size")).collect()))
    offsets = dict(zip(totals, [0, *accumulate(totals.values())]))
    offset = rows.sparkSession.createDataFrame([*offsets.items()] or [(0, 0)], "part int, offset long")
    pairs = pairs.join(F.broadcast(offset), "part").select(*keys, (F.col("offset") + F.col("before")).alias("merged"))
    kept = [c for c in rows.columns if c not in (letter, "interval")]
    out = (rows.withColumnRenamed(letter, "letter").join(pairs, keys)
           .select(*kept, F.col("merged").alias("interval")))
    return staged(out, "refined")


def _shared(pairs: DataFrame, key: str, enough, by: str, name: str) -> DataFrame:
    """``by`` and the list ``name`` of its keys that pass ``enough``, an aggregate over the key's rows."""
    keys = staged(pairs.groupBy(key).agg(enough.alias("_enough")).where("_enough").select(key), "shared")
    return staged(semi(pairs, keys, key).groupBy(by).agg(F.collect_set(key).alias(name)), name)


def repeated(texts: DataFrame, shard: int = SHARD) -> DataFrame:
    """``text_no, lo, hi``: runs of window starts that are repeated, for staged rows as ``TEXTS`` of
    different texts, which are released. Runs of one text may overlap or touch."""
    spark = texts.sparkSession
    pairs = texts.select("text_no", "copies", F.explode("hashes").alias("hash"))
    marks = _shared(pairs, "hash", F.sum("copies") > 1, "text_no", "marks")
    pieces = staged(texts.join(marks, "text_no").select("text_no", "copies", "text", "hashes", "places", "marks").mapInArrow(_piece_rows, PIECES), "pieces")
    release(texts, marks)
    size = pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(1, size // (4 * shard))
    order = ["key", F.xxhash64("text_no", "first"), "text_no", "first"]
    shards = staged(pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_shard_rows(shard), SHARDS), "shards")
    held = shards.select("shard", F.explode(F.arrays_zip("hashes", "contexts")).alias("a")).select(
        "shard", F.col("a.hashes").alias("hash"), F.col("a.contexts").alias("context")).distinct()
    contexts = staged(held.groupBy("hash", "context").agg(F.min("shard").alias("owner"), F.count("*").alias("n")), "contexts")
    whole = held.join(contexts.where("n > 1"), ["hash", "context"]).groupBy("shard").agg(F.collect_set("context").alias("whole"))
    met = staged(contexts.groupBy("hash").agg(F.min("owner").alias("o0"), F.max("owner").alias("o1")).where("o0 < o1").select("hash"), "met")
    split = semi(contexts, met, "hash").groupBy(F.col("owner").alias("shard")).agg(F.collect_set("context").alias("split"))
    columns = [c for c in shards.columns if c != "hashes"]
    found = staged(shards.select(*columns).join(whole, "shard", "left").join(split, "shard", "left").mapInArrow(_shard_found, FOUND), "found")
    release(pieces, shards, contexts, met)

    rows = found.where("rep IS NOT NULL").select("rep", "l1", "l2", "l3", "l4", F.lit(0).cast("long").alias("interval"))
    old = None
    for letter in ("l4", "l3", "l2", "l1"):
        rows = refined(rows, letter)
        release(*([old] if old else []))
        old = rows
    across = found.where("rep % 2 = 1").select("rep", "text_no", "lo", "hi").join(rows.where("rep % 2 = 1").select("rep"), "rep").drop("rep")
    return found.where("rep IS NULL").select("text_no", "lo", "hi").union(across)


def _kept(batches):
    """Columns digest, text, runs -> what is left of each text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for first, end in slices(offsets, PART):
            out = []
            for i in range(first, end):
                text = data[offsets[i]:offsets[i + 1]]
                change = np.zeros(len(text) + 1, np.int32)
                runs = batch.column(2)[i].values
                np.add.at(change, np.asarray(runs.field(0)), 1)
                np.add.at(change, np.asarray(runs.field(1)) + WINDOW - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = text[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            columns = zip((pa.int64(), pa.int64(), pa.string()), zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), *(pa.array(c, t) for t, c in columns)], ["digest", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs) and
    ``kept_sha256`` of the remaining bytes joined.

    Texts are read as UTF-8 bytes, null as empty; matches never cross documents. Rows that repeat a
    doc_id, or have none, are documents of their own, and equal texts of ``WINDOW`` bytes or more remove
    each other whole. Other columns are not read. Letters and anchors are compared by 64-bit hashes: two
    different windows pass for equal only if they share an anchor and a hash of different letters agrees.
    """
    shared_folder(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    long_ = rows.where(F.octet_length("text") >= WINDOW).groupBy("digest").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = staged(long_.select(F.monotonically_increasing_id().alias("text_no"), "copies", "digest", "text").mapInArrow(_anchor_rows, TEXTS), "texts")
    names = staged(texts.select("text_no", "digest", "copies"), "names")
    runs = staged(repeated(texts, shard).groupBy("text_no").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")
    hit = staged(names.join(runs, "text_no", "left").where("runs IS NOT NULL OR copies > 1").select("digest", "copies", "runs"), "hit")
    release(names, runs)
    few = hit.where("copies = 1").select("digest", "runs")
    left = rows.join(few, "digest").select("digest", "text", "runs").mapInArrow(
        _kept, "digest binary, n_removed long, n_spans long, kept_sha256 string")
    left = staged(left.union(hit.where("copies > 1").select(
        "digest", F.lit(None).cast("long"), F.lit(1).cast("long"), F.sha2(F.lit(b""), 256))), "left")
    every = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = lookup(every, left, ["digest"])
    hit_ = F.col("n_spans").isNotNull()
    return out.select("doc_id", "n_bytes", F.when(hit_, F.coalesce("n_removed", "n_bytes")).otherwise(0).cast("long").alias("n_removed"),
                      F.when(hit_, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
