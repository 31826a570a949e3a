"""SentencePiece encoding and decoding, giant texts by a parallel scan of transfer matrices.

The model is a byte-pair model: a sequence of pieces is the encoding of a text exactly if every two
neighbours are *compatible*, that is, encoding the two pieces' joined text gives these two pieces back. So
encoding is a best path over positions whose steps weigh 0 (compatible) or minus infinity, and no
two texts' parts need be looked at in order. A text longer than ``GIANT`` code points is cut into
chunks. A boundary's states are the pieces of the vocabulary that lie on it. Each chunk yields the
max-plus matrix from the states at its left boundary to those at its right one (weights 0 and minus
infinity, so a row is a set of bits and the product an OR of ANDs), the matrices are combined
associatively, and each chunk is traced back on its own between the two states found for it.

Other texts are encoded a run of white space plus word at a time, which no piece of the vocabulary
crosses, each distinct run once a worker. Ids equal those of the ``sentencepiece`` library.

The path of the model file is a parameter, read on every executor.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import few_rows, staged

GIANT = 65_536
"""Code points from which a text is encoded in chunks."""

CHUNK = 16_384
CACHE = 150_000
"""Distinct runs, and pairs of pieces, that a worker remembers, at most."""

SPACE = "▁"
RUN = re.compile(" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary with its library processor, its compatible pairs and the runs seen so far."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.names = [self.model.id_to_piece(i) for i in range(size)]
        self.ids, self.rank, self.bytes = {}, {}, [b""] * size
        self.of_byte = [self.model.unk_id()] * 256
        for i, name in enumerate(self.names):
            if self.model.is_byte(i):
                self.of_byte[int(name[3:5], 16)] = i
                self.bytes[i] = bytes([int(name[3:5], 16)])
            elif self.model.is_unknown(i):
                self.bytes[i] = " ⁇ ".encode()
            elif not self.model.is_control(i):
                self.ids[name] = i
                self.rank[name] = -self.model.get_score(i)
                self.bytes[i] = name.encode()
        self.longest = max(map(len, self.ids))
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError("a piece of this vocabulary goes over a word's start")
        self.lengths: dict[str, list[int]] = {}  # by the first two characters, shortest first
        for name in sorted(self.ids, key=len):
            if len(name) > 1 and len(name) not in self.lengths.setdefault(name[:2], []):
                self.lengths[name[:2]].append(len(name))
        self.sizes = np.array([len(b) for b in self.bytes])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.runs: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}

    # Ordinary texts

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        # The library puts one mark in front and reads marks as spaces; so do the runs, which all
        # begin with a space.
        cut = [RUN.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        seen = self.runs
        new = list({r for runs in cut for r in runs if r not in seen})
        if len(seen) + len(new) > CACHE:
            seen.clear()
            new = list({r for runs in cut for r in runs})
        seen.update(zip(new, (array("i", ids).tobytes() for ids in self.model.encode([r[1:] for r in new], num_threads=1)) if new else ()))
        if " " in new:
            seen[" "] = array("i", self.ids_of(SPACE)).tobytes()
        return [b"".join(map(seen.__getitem__, runs)) for runs in cut]

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.of_byte[b] for b in piece.encode()]

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or not ends[-1]:
            return b""
        return self.joined[np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    # Compatible pairs

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best-ranked neighbours join first, the leftmost of equals."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, piece: str) -> bool:
        known = self.alone.get(piece)
        if known is None:
            known = self.alone[piece] = self.merged(piece) == [piece]
        return known

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def starting(self, text: str, i: int, end: int) -> list[int]:
        """Ends of the pieces that begin at ``i``; a character outside the vocabulary is its own piece."""
        return [i + 1] + [i + n for n in self.lengths.get(text[i:i + 2], ())
                          if i + n <= end and text[i:i + n] in self.ids and self.stable(text[i:i + n])]

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces (start, end) that hold the character before ``at``: the states of a boundary."""
        return sorted((i, j) for i in range(max(0, at - self.longest), at)
                      for j in self.starting(text, i, len(text)) if j >= at)

    def sweep(self, text: str, entries: list, end: int, keep: bool = False):
        """Bits of the entry states that reach each piece ending at or after ``end``.

        ``entries``: pieces (start, end) or None for the start of the text. With ``keep`` also the
        pieces before each piece.
        """
        waiting: dict[int, dict[tuple[int, int], int]] = {}
        back: dict[tuple[int, int], list] = {}
        done: dict[tuple[int, int], int] = {}
        for bit, entry in enumerate(entries):
            if entry is None:
                for j in self.starting(text, 0, len(text)):
                    waiting.setdefault(j, {}).setdefault((0, j), 0)
                    waiting[j][0, j] |= 1 << bit
            else:
                waiting.setdefault(entry[1], {}).setdefault(entry, 0)
                waiting[entry[1]][entry] |= 1 << bit
        place = min(waiting, default=end)
        while waiting:
            here = waiting.pop(place, None)
            if here:
                if place >= end:
                    for piece, bits in here.items():
                        done[piece] = done.get(piece, 0) | bits
                else:
                    after = [(j, text[place:j]) for j in self.starting(text, place, len(text))]
                    for (i, _), bits in here.items():
                        left = text[i:place]
                        for j, right in after:
                            if self.compatible(left, right):
                                into = waiting.setdefault(j, {})
                                into[place, j] = into.get((place, j), 0) | bits
                                if keep:
                                    back.setdefault((place, j), []).append((i, place))
            place += 1
        return done, back


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def prepared(text: str | None) -> str:
    """Spaces as marks, one more in front; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


# ── The scan, text by text (tests) and over the cluster ──────────────────────────────────────


def transfer(pieces: Pieces, text: str, first: int, end: int, is_first: bool, is_last: bool) -> tuple[list, list, list[int]]:
    """(states in, states out, bits of the states in for each state out) of a chunk ``[first, end)``."""
    entries = [None] if is_first else pieces.states(text, first)
    exits = [(None, end)] if is_last else pieces.states(text, end)
    done, _ = pieces.sweep(text, entries, end)
    if is_last:
        bits = 0
        for (_, j), b in done.items():
            bits |= b if j == end else 0
        return entries, exits, [bits]
    return entries, exits, [done.get(e, 0) for e in exits]


def combine(one: list[int], two: list[int]) -> list[int]:
    """Max-plus product of two matrices given as, for each state out, the bits of the states in."""
    out = []
    for bits in two:
        total = 0
        for k, row in enumerate(one):
            if bits >> k & 1:
                total |= row
        out.append(total)
    return out


def boundaries(matrices: list[list[int]]) -> list[int]:
    """For each inner boundary the one state on the path from the text's start to its end.

    Products of all prefixes and of all suffixes, each by doubling steps of associative products."""

    def scan(items: list, product) -> list:
        items, step = list(items), 1
        while step < len(items):
            items = [items[i] if i < step else product(items[i - step], items[i]) for i in range(len(items))]
            step *= 2
        return items

    prefix = scan(matrices, combine)
    suffix = scan(matrices[::-1], lambda a, b: combine(b, a))[::-1]
    out = []
    for c in range(len(matrices) - 1):
        reached = [bool(row & 1) for row in prefix[c]]
        goes_on = suffix[c + 1][0]
        both = [k for k, ok in enumerate(reached) if ok and goes_on >> k & 1]
        if len(both) != 1:
            raise ValueError(f"{len(both)} paths over a boundary")
        out.append(both[0])
    return out


def trace(pieces: Pieces, text: str, entry, leave, end: int) -> list[int]:
    """Ids of the pieces after the entry state, the leaving state included."""
    done, back = pieces.sweep(text, [entry], end, keep=True)
    at = leave
    if at[0] is None:
        at = next(p for p in done if p[1] == end)
    spans = []
    while at != entry:
        spans.append(at)
        before = back.get(at)
        if before is None:
            break
        at = before[0]
    return [x for i, j in reversed(spans) for x in pieces.ids_of(text[i:j])]


def encode_giant(pieces: Pieces, text: str, chunk: int = CHUNK) -> list[list[int]]:
    """All steps for one text in one process: ids chunk by chunk."""
    text = prepared(text)
    cuts = [*range(0, len(text), chunk), len(text)]
    parts = list(zip(cuts, cuts[1:]))
    made = [transfer(pieces, text, a, b, a == 0, b == len(text)) for a, b in parts]
    chosen = boundaries([m[2] for m in made])
    out = []
    for c, (_, b) in enumerate(parts):
        entry = None if c == 0 else made[c][0][chosen[c - 1]]
        leave = made[c][1][0] if c == len(parts) - 1 else made[c][1][chosen[c]]
        out.append(trace(pieces, text, entry, leave, b))
    return out


def _cut_rows(chunk: int, margin: int):
    """Texts to chunk rows with as much text around as a piece can be long."""
    def run(batches):
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = prepared(text)
                n = -(-len(text) // chunk)
                for c in range(n):
                    low, high = max(0, c * chunk - margin), min(len(text), (c + 1) * chunk + margin)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], pa.int64()) for x in (doc_id, key, c, n, low, len(text))] + [pa.array([text[low:high]])],
                        ["doc_id", "key", "chunk", "chunks", "low", "chars", "text"])
    return run


CUT = "doc_id long, key long, chunk long, chunks long, low long, chars long, text string"


def _limits(row, chunk):
    first = row["chunk"] * chunk - row["low"]
    end = min((row["chunk"] + 1) * chunk, row["chars"]) - row["low"]
    return first, end, row["chunk"] == 0, row["chunk"] == row["chunks"] - 1


def _hex(bits: list[int]) -> list[str]:
    return [f"{b:x}" for b in bits]


def _transfers(path: str, chunk: int):
    def run(batches):
        pieces = load(path)
        for batch in batches:
            for row in batch.to_pylist():
                first, end, is_first, is_last = _limits(row, chunk)
                _, _, bits = transfer(pieces, row["text"], first, end, is_first, is_last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]]), pa.array([row["chunk"]]), pa.array([_hex(bits)], pa.list_(pa.string()))], ["key", "chunk", "bits"])
    return run


def _chosen(key: tuple, table: pa.Table) -> pa.Table:
    """The states at the boundaries of one text (its matrices are small: a few bits a state)."""
    rows = sorted(zip(table.column("chunk").to_pylist(), table.column("bits").to_pylist()))
    at = boundaries([[int(b, 16) for b in bits] for _, bits in rows])
    n = len(rows)
    return pa.table({"key": pa.array([key[0].as_py()] * n, pa.int64()), "chunk": pa.array([c for c, _ in rows], pa.int64()),
                     "enter": pa.array([-1, *at], pa.int64()), "leave": pa.array([*at, -1], pa.int64())})


def _traces(path: str, chunk: int):
    def run(batches):
        pieces = load(path)
        for batch in batches:
            for row in batch.to_pylist():
                first, end, is_first, is_last = _limits(row, chunk)
                entry = None if is_first else pieces.states(row["text"], first)[row["enter"]]
                leave = (None, end) if is_last else pieces.states(row["text"], end)[row["leave"]]
                ids = trace(pieces, row["text"], entry, leave, end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[c]], pa.int64()) for c in ("doc_id", "key", "chunk")] + [pa.array([ids], pa.list_(pa.int32()))],
                    ["doc_id", "text_no", "chunk", "ids"])
    return run


def _plain_rows(path: str):
    def run(batches):
        pieces = load(path)
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):  # a few MB of text at a time
                end, size = first, 0
                while end < len(texts) and (end == first or size + len(texts[end]) < 1_000_000):
                    size += len(texts[end])
                    end += 1
                ids = pieces.encode_many(texts[first:end])
                flat = np.frombuffer(b"".join(ids), np.int32)
                ends = (np.cumsum([0, *map(len, ids)]) // 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.full(end - first, -1)), pa.array(np.zeros(end - first, np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "text_no", "chunk", "ids"])
                first = end
    return run


ENCODED = "doc_id long, text_no long, chunk long, ids array<int>"


def _then(*steps):
    """One function of batches that runs the steps one after the other, in one worker."""
    def run(batches):
        for step in steps:
            batches = step(batches)
        yield from batches
    return run


def encode(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, text_no, chunk, ids``: the ids of every text, a giant text's in one row for each chunk.

    ``text_no`` tells texts of one doc_id apart (0 for those encoded whole). Null and empty texts have
    no ids and one row. Rows that repeat stay; a null doc_id is kept. A mark U+2581 in a text reads as
    a space, as in the library.
    """
    plain, giants = _encoded(docs, model or default_model(), giant, chunk, [], ENCODED)
    return plain if giants is None else plain.union(giants)


def _encoded(docs: DataFrame, model: str, giant: int, chunk: int, then: list, schema: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of plain texts and those of giant ones, as two frames: neither has to make the other's to leave them out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    large = F.coalesce(F.char_length("text") > giant, F.lit(False))
    plain = rows.where(~large).mapInArrow(_then(_plain_rows(model), *then), schema)
    giants = staged(rows.where(large).select("doc_id", F.monotonically_increasing_id().alias("key"), "text"), "giants")
    if giants.isEmpty():
        return plain, None
    cut = staged(giants.mapInArrow(_cut_rows(chunk, 2 * load(model).longest), CUT), "chunks")
    tasks = max(1, min(10_000, cut.count() // 4))  # long work on few bytes: dealt out by number
    matrices = cut.repartition(tasks, "key", "chunk").mapInArrow(_transfers(model, chunk), "key long, chunk long, bits array<string>")
    states = staged(matrices.groupBy("key").applyInArrow(_chosen, "key long, chunk long, enter long, leave long"), "states")
    traced = cut.join(states, ["key", "chunk"]).repartition(tasks, "key", "chunk").select(*cut.columns, "enter", "leave")
    return plain, traced.mapInArrow(_then(_traces(model, chunk), *then), schema)


def _decoded(path: str):
    def run(batches):
        pieces = load(path)
        for batch in batches:
            names = batch.schema.names
            at = names.index("ids")
            flat = batch.column(at)
            ids = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in flat]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(n)) for n in ("doc_id", "text_no", "chunk")] +
                [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<i4").tobytes() for x in ids], pa.binary()),
                 pa.array([pieces.decode(x) for x in ids], pa.binary())],
                ["doc_id", "text_no", "chunk", "n", "ids", "data"])
    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text_no, n_tokens, ids_sha256, text`` from the rows of ``encode``.

    ``ids_sha256`` is of the ids as 32-bit little-endian integers. Chunks of a giant text are joined
    as bytes, so a character whose bytes lie in two chunks is whole again.
    """
    step = _decoded(model or default_model())
    return _whole(*(encoded.where(rows).mapInArrow(step, DECODED) for rows in ("text_no < 0", "text_no >= 0")))


def round_trip(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """As ``decode(encode(docs))``, each text's ids decoded by the worker that made them."""
    model = model or default_model()
    return _whole(*_encoded(docs, model, giant, chunk, [_decoded(model)], DECODED))


DECODED = "doc_id long, text_no long, chunk long, n long, ids binary, data binary"


def _whole(plain: DataFrame, chunks: DataFrame | None) -> DataFrame:
    both = plain.select("doc_id", "text_no", F.col("n").alias("n_tokens"), "ids", "data")
    if chunks is not None:
        both = both.union(
            chunks.groupBy("doc_id", "text_no")
            .agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("chunk", "ids", "data"))).alias("c"))
            .select("doc_id", "text_no", "n_tokens",
                    F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                    F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data")))
    text = F.replace(F.decode("data", "UTF-8"), F.lit(SPACE), F.lit(" "))
    return both.select("doc_id", "text_no", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.when(F.startswith(text, F.lit(" ")), F.substr(text, F.lit(2))).otherwise(text).alias("text"))
