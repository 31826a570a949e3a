"""Diagnosis codes: crosswalks, chapters, labels, prevalence, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.exprs import case, scalars, whole_hours_between
from sequela.operators.joins import lookup
from sequela.operators.ordered import COUNT_FIRST

# Chapter by leading characters of a version-10 code, longest prefix first per letter.
CHAPTERS_10 = [
    ("Infectious", ["A", "B"]),
    ("Neoplasms", ["C", "D0", "D1"]),
    ("Blood/Immune", ["D"]),
    ("Endocrine", ["E"]),
    ("Mental", ["F"]),
    ("Neurologic", ["G"]),
    ("Eye", ["H0", "H1"]),
    ("Ear", ["H"]),
    ("Circulatory", ["I"]),
    ("Respiratory", ["J"]),
    ("Digestive", ["K"]),
    ("Skin", ["L"]),
    ("Musculoskeletal", ["M"]),
    ("Genitourinary", ["N"]),
    ("Pregnancy", ["O"]),
    ("Perinatal", ["P"]),
    ("Congenital", ["Q"]),
    ("Symptoms", ["R"]),
    ("InjuryPoisoning", ["S", "T"]),
    ("ExternalCauses", ["V", "W", "X", "Y"]),
    ("SocialFactors", ["Z"]),
    ("SpecialCodes_e.g.COVID", ["U"]),
]

# Chapter by the three-digit category of a version-9 code, ends included.
CHAPTERS_9 = [
    ("Infectious", 1, 139),
    ("Neoplasms", 140, 239),
    ("Endocrine", 240, 279),
    ("Blood/Immune", 280, 289),
    ("Mental", 290, 319),
    ("Neurologic", 320, 389),
    ("Circulatory", 390, 459),
    ("Respiratory", 460, 519),
    ("Digestive", 520, 579),
    ("Genitourinary", 580, 629),
    ("Pregnancy", 630, 679),
    ("Skin", 680, 709),
    ("Musculoskeletal", 710, 739),
    ("Congenital", 740, 759),
    ("Perinatal", 760, 779),
    ("Symptoms", 780, 799),
    ("InjuryPoisoning", 800, 999),
]
CHAPTERS_9_LETTER = [("ExternalCauses", "^E[0-9]{3}"), ("FactorsInfluencingHealth", "^V[0-9]{2}")]
CHAPTER_9_DEFAULT = "OtherUnmapped"

# Two-character procedure code ranges counted as surgery.
SURGERY_RANGES = [("01", "05"), ("06", "07"), ("36", "39"), ("42", "54"), ("76", "84")]


def code_chapter(code: str | Column, version: str | Column) -> Column:
    """Chapter of a diagnosis code; null for versions other than 9 and 10."""
    code = F.col(code) if isinstance(code, str) else code
    version = F.col(version) if isinstance(version, str) else version
    tenth = case(
        [(F.substring(code, 1, len(p)) == p, F.lit(name)) for name, ps in CHAPTERS_10 for p in ps]
    )
    # Three digits compare as text in the same order as the numbers.
    category = F.substring(code, 1, 3)
    by_number = case(
        [(category.between(f"{lo:03}", f"{hi:03}"), F.lit(name)) for name, lo, hi in CHAPTERS_9],
        F.lit(CHAPTER_9_DEFAULT),
    )
    ninth = case(
        [(code.rlike("^[0-9]{3}"), by_number)]
        + [(code.rlike(p), F.lit(name)) for name, p in CHAPTERS_9_LETTER],
        F.lit(CHAPTER_9_DEFAULT),
    )
    return case([(version == 10, tenth), (version == 9, ninth)])


def is_respiratory(code: str, version: str) -> Column:
    """Version 9 categories 460 to 519, version 10 codes under J."""
    c, v = F.col(code), F.col(version)
    ninth = c.rlike("^[0-9]{3}") & F.substring(c, 1, 3).between("460", "519")
    return ((v == 9) & ninth) | ((v == 10) & c.startswith("J"))


def in_prefix_ranges(code: str, ranges: list[tuple[str, str]] = SURGERY_RANGES) -> Column:
    """Whether the first characters lie in one of the ranges, whatever the code version."""
    hit = F.lit(False)
    for lo, hi in ranges:
        hit = hit | F.substring(F.col(code), 1, len(lo)).between(lo, hi)
    return hit


def first_date_in_ranges(
    procedures: DataFrame, key: str, code: str, date: str,
    ranges: list[tuple[str, str]] = SURGERY_RANGES, out: str = "surgery_time",
) -> DataFrame:
    return procedures.where(in_prefix_ranges(code, ranges)).groupBy(key).agg(F.min(date).alias(out))


def count_where(rows: DataFrame, key: str, condition: Column, out: str) -> DataFrame:
    return rows.where(condition).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def classify_by_codes(
    events: DataFrame,
    surgery: DataFrame,
    respiratory: DataFrame,
    key: str,
    time: str = "event_time",
    hours: str = "episode_hours",
    surgery_time: str = "surgery_time",
    respiratory_count: str = "respiratory_count",
    window: int = 12,
    out: str = "category",
    heavy: DataFrame | None = COUNT_FIRST,
) -> DataFrame:
    """Surgical when surgery lies within ``window`` hours of the episode's start, else by codes."""
    rows = lookup(events, surgery, [key], heavy=heavy)
    rows = lookup(rows, respiratory, [key], heavy=heavy)
    offset = whole_hours_between(F.col(surgery_time).cast("timestamp"), time) + F.coalesce(
        F.col(hours), F.lit(0.0)
    )
    return rows.withColumn(
        out,
        case(
            [
                (F.col(surgery_time).isNotNull() & offset.between(-window, window),
                 F.lit("surgical")),
                (F.coalesce(respiratory_count, F.lit(0)) > 0, F.lit("medical-respiratory")),
            ],
            F.lit("medical-non-respiratory"),
        ),
    ).select(*events.columns, out)


def titled(code: str, title: str) -> Column:
    """``code: title``; null when either is."""
    return F.concat(F.col(code), F.lit(": "), F.col(title))


def normalised(code: str | Column) -> Column:
    return F.replace(F.col(code) if isinstance(code, str) else code, F.lit("."), F.lit(""))


def crosswalk(
    codes: DataFrame,
    table: DataFrame,
    code: str,
    table_code: str,
    version: str | None = None,
    wanted: int = 10,
    how: str = "left",
) -> DataFrame:
    """Attach crosswalk columns by the code without dots; only codes of the wanted version match.

    ``table`` has one row per code.
    """
    key = normalised(code)
    if version is not None:
        key = F.when(F.col(version) == wanted, key)
    added = [c for c in table.columns if c != table_code]
    table = table.withColumnRenamed(table_code, "_code")
    return lookup(codes.withColumn("_code", key), table, ["_code"], how).select(
        *codes.columns, *added
    )


def first_by_key(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    """Largest of each expression per key, nulls aside: one pass for all labels."""
    return rows.groupBy(key).agg(*[F.max(c).alias(n) for n, c in columns.items()])


def code_arrays(
    codes: DataFrame, key: str, arrays: dict[str, str], seq: str | None = None, upto: int = 10
) -> DataFrame:
    """Sorted distinct non-null values per key; a key has as many as the code list, not more."""
    if seq is not None:
        codes = codes.where(F.col(seq) <= upto)
    return codes.groupBy(key).agg(
        *[F.array_sort(F.collect_set(c)).alias(out) for out, c in arrays.items()]
    )


def nearest_code(
    events: DataFrame, codes: DataFrame, key: str, seq: str, code: str, label: str,
    out: str = "nearest_label",
) -> DataFrame:
    """The code nearest to an event of its stay.

    Codes carry no time of their own, so all of a stay's codes are equally near; the order is by
    sequence number, then code.
    """
    best = codes.groupBy(key).agg(F.min_by(label, F.struct(seq, code)).alias(out))
    return lookup(events, best, [key])


def explode_codes(rows: DataFrame, array: str, out: str = "code") -> DataFrame:
    """One row per element; rows with a null or empty array vanish."""
    return rows.withColumn(out, F.explode(array)).drop(array)


def code_prevalence(
    long: DataFrame,
    subject: str = "subject_id",
    code: str = "code",
    cohort: DataFrame | None = None,
    denominator: str = "coded",
) -> DataFrame:
    """Subjects per code and their share.

    ``coded`` divides by subjects with at least one code; ``cohort`` by all subjects of
    ``cohort``. With a cohort, only its subjects are counted.
    """
    if cohort is not None:
        subjects = cohort.select(subject).distinct()
        long = long.join(subjects, subject, "left_semi")
    pairs = long.select(subject, code).distinct()
    base = subjects if denominator == "cohort" else pairs
    value = scalars(base.select(subject).distinct(), n=F.count(F.lit(1)))
    return pairs.groupBy(code).agg(F.count(F.lit(1)).alias("n_subjects")).withColumn(
        "prevalence", F.col("n_subjects") / value("n")
    )


def select_codes(
    prevalence: DataFrame, threshold: float = 0.10, exclude: list[str] = (), code: str = "code"
) -> list[str]:
    """Codes at or above the threshold, sorted. At most ``subjects' mean code count / threshold``."""
    kept = prevalence.where((F.col("prevalence") >= threshold) & ~F.col(code).isin(list(exclude)))
    return sorted(r[0] for r in kept.select(code).collect())


def code_flags(
    rows: DataFrame,
    long: DataFrame,
    codes: list[str],
    subject: str = "subject_id",
    code: str = "code",
    prefix: str = "code_",
) -> DataFrame:
    """0/1 column per listed code; all zero for subjects without any."""
    names = {c: f"{prefix}{c}" for c in codes}
    wide = (
        long.where(F.col(code).isin(codes))
        .groupBy(subject)
        .pivot(code, codes)
        .agg(F.max(F.lit(1)))
    )
    wide = wide.select(subject, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return lookup(rows, wide, [subject]).fillna(0, subset=list(names.values()))


def array_flags(rows: DataFrame, array: str, codes: list[str], prefix: str = "code_") -> DataFrame:
    """As :func:`code_flags`, from an array column: no join and no shuffle."""
    present = F.coalesce(F.col(array), F.array().cast("array<string>"))
    return rows.withColumns(
        {f"{prefix}{c}": F.array_contains(present, c).cast("int") for c in codes}
    )


def flags_long(rows: DataFrame, keep: list[str], flags: list[str], code: str = "code") -> DataFrame:
    """Flag columns as rows ``(keep..., code, present)``."""
    return rows.unpivot(keep, flags, code, "present")


def prevalence_by_stratum(
    rows: DataFrame, stratum: str, flags: list[str], threshold: float = 0.15
) -> DataFrame:
    """Prevalence of each flag per stratum, kept from ``threshold`` on.

    Summed wide, one pass over the rows; only the summary is unpivoted.
    """
    wide = rows.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f).alias(f) for f in flags]
    )
    long = wide.unpivot([stratum, "_n"], flags, "code", "n_subjects")
    return (
        long.withColumn("prevalence", F.round(F.col("n_subjects") / F.col("_n"), 3))
        .where(F.col("prevalence") >= threshold)
        .drop("_n")
    )


def prevalence_range(rows: DataFrame, stratum: str, flags: list[str], top: int = 15) -> DataFrame:
    """The codes whose prevalence differs most between strata."""
    wide = rows.groupBy(stratum).agg(*[F.avg(f).alias(f) for f in flags])
    return (
        wide.unpivot([stratum], flags, "code", "prevalence")
        .groupBy("code")
        .agg(
            (F.max("prevalence") - F.min("prevalence")).alias("prev_range"),
            F.min("prevalence").alias("prev_min"),
            F.max("prevalence").alias("prev_max"),
        )
        .orderBy(F.round("prev_range", 9).desc(), "code")
        .limit(top)
    )


def parse_code_text(c: str | Column) -> Column:
    """Array from a text cell: ``['A', 'B']``, or a list split by commas or blanks."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    quoted = F.transform(F.regexp_extract_all(text, F.lit(r"""(['"])(.*?)\1"""), F.lit(2)),
                         lambda x: F.trim(x))
    plain = F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return case(
        [
            (text.isNull() | (text == "") | text.rlike(r"^\[\s*\]$"), empty),
            (text.startswith("[") & text.rlike("['\"]"), quoted),
        ],
        plain,
    )


