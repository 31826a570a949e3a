"""Contiguous shards of near equal bytes, cut from global prefix sums of sizes.

Rows are sorted over the cluster by (text hash, doc_id), so equal texts stand together. Each sorted
partition's total is summed, the totals give each partition the bytes and rows before it, and a
running sum inside the partition gives each row its place. A row's shard follows from the place
where its group of equal texts begins, as long as the group is small against a shard; a large group
is cut like any other rows. Only one total a partition and one row a shard go to the driver.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import shared_folder, staged

GROUP_SHARE = 0.01
"""Groups up to this share of a shard's bytes are kept in one shard."""


def _running(before: dict[int, tuple[int, int]]):
    def run(batches):
        from pyspark import TaskContext

        done, row = before.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("size")).to_numpy()
            place = done + np.cumsum(size) - size
            index = row + np.arange(len(size))
            done, row = done + int(size.sum()), row + len(size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.int64()), pa.array(index, pa.int64())],
                [*batch.schema.names, "place", "index"])
    return run


def balanced(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: ``size`` is the text's UTF-8 bytes plus 1 (null: 1),
    shards are contiguous in the sorted order and ``slot`` counts from 0 in each.

    A null text has the check sum of the empty one. Repeated rows and null doc_ids are rows like any
    others; rows alike in hash, doc_id and size are interchangeable.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = staged(rows, "sizes")
    order = ["h", "text_crc32", "doc_id", "size"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint()
    part = F.spark_partition_id()
    totals = sorted(map(tuple, ordered.groupBy(part.alias("p")).agg(F.sum("size"), F.count("*")).collect()))
    starts = [(0, 0), *accumulate(((s, n) for _, s, n in totals), lambda a, b: (a[0] + b[0], a[1] + b[1]))]
    whole = starts[-1][0]
    before = {p: start for (p, _, _), start in zip(totals, starts)}
    placed = staged(ordered.mapInArrow(
        _running(before), "doc_id long, size long, text_crc32 long, h long, place long, index long"), "placed")

    aim = max(1.0, whole / shards)
    groups = placed.groupBy("h", "text_crc32").agg(F.min("place").alias("g_place"), F.sum("size").alias("g_size"), F.count("*").alias("g_rows"))
    groups = staged(groups.where((F.col("g_rows") > 1) & (F.col("g_size") <= aim * GROUP_SHARE)), "groups")
    place = F.coalesce("g_place", "place")
    spread = placed.join(groups.select("h", "text_crc32", "g_place"), ["h", "text_crc32"], "left").withColumn(
        "shard", F.least(F.lit(shards - 1), F.floor(place * shards / max(1, whole))).cast("int"))
    spread = staged(spread, "spread")
    first = {r["shard"]: r["first"] for r in spread.groupBy("shard").agg(F.min("index").alias("first")).collect()}
    base = F.element_at(F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    return spread.select("doc_id", "size", "text_crc32", "shard", (F.col("index") - base).alias("slot"))
