"""Reading and writing: typed text, pruned scans, stages, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sequela.session import checkpointed


def read_typed_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    columns: list[str] | None = None,
    levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Text with declared types; nothing is inferred.

    ``levels`` lists the ordered values of a factor: others become null, and ``<c>_level`` holds
    the position. ``columns`` narrows the read.
    """
    rows = spark.read.schema(schema).option("header", True).csv(path)
    if columns:
        rows = rows.select(*columns)
    for c, values in (levels or {}).items():
        known = F.array(*map(F.lit, values))
        place = F.array_position(known, F.col(c))
        rows = rows.withColumn(f"{c}_level", F.when(place > 0, place)).withColumn(
            c, F.when(F.array_contains(known, F.col(c)), F.col(c))
        )
    return rows


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_table(
    spark: SparkSession, folder: str, name: str, columns: list[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """A parquet table with the filter and the columns pushed into the scan."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    if where is not None:
        rows = rows.where(where)
    return rows.select(*columns) if columns else rows


def stage(rows: DataFrame, path: str | None = None) -> DataFrame:
    """A result several later steps read: written once, then read back."""
    if path is None:
        return checkpointed(rows)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def keyed_map(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row with a map from key to its values: for summaries with few keys."""
    entry = F.struct(F.col(key).cast("string"), F.struct(*columns))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("entries"))


def build_report(spark: SparkSession, **sections: DataFrame) -> DataFrame:
    """One JSON document from one-row frames, each a section named after its argument.

    A section frame with a single map column (see :func:`keyed_map`) is keyed by it.
    """
    parts = []
    for name, frame in sections.items():
        if frame.columns == ["entries"]:
            value = frame.select("entries")
        else:
            value = frame.select(F.struct(*frame.columns))
        parts.append(value.scalar().alias(name))
    return spark.range(1).select(F.to_json(F.struct(*parts)).alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").text(path)
