"""What the operators share: staged tables, sized broadcasts, words of texts as arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of anything but ASCII white space."""

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""Spark's setting under which a query's shuffle files are removed when it ends."""

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
"""Spark's setting for the rows that a Python step gets at once ..."""

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
"""... and for the bytes of these rows."""

STEP_BYTES = 1 << 20
"""Bytes of rows that a Python step gets at once where a stage bounds its rows: an executor holds a batch several
times (as it grows, in the pipe, and in the Python worker), and keeps most of the memory of its largest."""

BROADCAST_IDS = 2_000_000
"""At most this many ids (16 MB) are broadcast; more are joined by a shuffle."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one in local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage", batch: int | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: a cut of its lineage that any
    executor can read again. The shuffle files of the write go when it ends, as nothing reads them
    after that. ``batch`` bounds the rows that its Python steps get at once, and ``STEP_BYTES`` their
    bytes, for rows that are long. The session's own settings hold again afterwards."""
    spark = df.sparkSession
    path, before = new_path(spark, name), {CLEANUP: spark.conf.get(CLEANUP, "false")}
    if batch is not None:
        before |= {setting: spark.conf.get(setting) for setting in (BATCH_ROWS, BATCH_BYTES)}
    spark.conf.set(CLEANUP, "true")
    if batch is not None:
        most = int(before[BATCH_ROWS])  # zero or less: no bound
        spark.conf.set(BATCH_ROWS, str(min(batch, most) if most > 0 else batch))
        spark.conf.set(BATCH_BYTES, STEP_BYTES)
    try:
        df.write.parquet(path)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def semi(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``df`` whose key is in ``ids`` (one column, staged). The ids are broadcast after
    they were counted, and joined by a shuffle where there are more than ``limit``."""
    few = ids.count() <= limit
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_semi")


FEW_ROWS = 500
"""Rows that a Python step turns into Python's own objects in one go."""


def few_rows(batches, rows: int | None = None):
    """The same rows in batches of ``FEW_ROWS`` at most. A worker keeps most of the memory that its largest batch
    took, for the stages after it, too."""
    rows = rows or FEW_ROWS
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


# ── Words of texts as arrays ─────────────────────────────────────────────────────────────────

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(256, dtype=np.uint64), 77)
STEP = 0x2545F4914F6CDD1D


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(STEP))
        out[:1] = 1
        return np.cumprod(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each text; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset or column.buffers()[2] is None:
        column = pa.concat_arrays([column, pa.array([""], pa.large_string())]).slice(0, len(column))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 4 << 20):
    """Runs of whole texts of about ``limit`` bytes: (first, end) positions."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, in order, and the number of words of each text.

    ``fold`` lower-cases A-Z. A word never spans two texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    if fold:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = solid[inner]
    at = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(at, offsets))
    if not len(at):
        return np.zeros(0, np.uint64), counts
    first = at[0]
    solid, data = solid[first:], data[first:]
    at = at - first
    lengths = np.diff(np.append(at, len(data)))
    place = np.arange(len(data)) - np.repeat(at, lengths)
    table = powers(int(lengths.max()) + 1)
    with np.errstate(over="ignore"):
        terms = np.where(solid, BYTE[data] * table[place], np.uint64(0))
        ends = np.add.reduceat(solid.astype(np.uint64), at)
        return mix(np.add.reduceat(terms, at) + ends * np.uint64(STEP), 3), counts


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` words as sorted 64-bit hashes, text after text, and each text's
    number of them. A text of fewer words has its whole sequence as the one shingle; a text
    without words has none."""
    n = len(words)
    ends = np.cumsum(counts)
    starts = ends - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - starts[owner]
    span = np.minimum(counts, k)[owner]
    keep = place + span <= counts[owner]
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(k):
            part = np.zeros(n, np.uint64)
            if n > j:
                part[:n - j] = mix(words[j:], 11 + j)
            total += np.where(span > j, part, np.uint64(0))
        total = mix(total + span.astype(np.uint64), 5)
    owner, total = owner[keep], total[keep]
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(total), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    owner, total = owner[new], total[new]
    return total, np.bincount(owner, minlength=len(counts)).astype(np.int64)
