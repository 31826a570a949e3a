"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: every turn before it is context, and only its own
text is trainable. Turns after a conversation's last assistant turn make a last example without a
target, so that the formatted rows hold the whole conversation.

A turn is written ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control string; a newline in
a role gets a backslash. ``plain`` undoes it.

The written examples add up to every prefix of a conversation, which is what is asked for: their
size is quadratic in its turns. Formatting and reading back shuffle by conv_id once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TAIL = END + "\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def plain(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _written(turn: Column) -> Column:
    role = F.replace(escaped(turn["role"]), F.lit("\n"), F.lit("\\\n"))
    return F.concat(F.lit(START), role, F.lit("\n"), escaped(turn["text"]), F.lit(TAIL))


def examples(turns: DataFrame) -> DataFrame:
    """``conv_id, example, target_start, target_chars, text`` from rows ``conv_id, turn, role, text``.

    ``example`` counts from 1; ``target_start`` is the 0-based code point where the trainable text
    begins and ``target_chars`` its length (null and 0 for the example without a target). Turns are
    in the order of ``turn`` (null first), ties by role, then text. Null roles and texts read as
    empty; a null conv_id is a conversation like any other. Repeated rows are turns of their own.
    """
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    spots = whole.withColumn("w", F.transform("t", _written)).withColumn(
        "at", F.expr("filter(sequence(1, size(t)), i -> t[i - 1].role = 'assistant' OR i = size(t))"))
    each = spots.select("conv_id", "t", "w", F.posexplode("at").alias("example", "i"))
    text = F.array_join(F.slice("w", 1, F.col("i")), "")
    last = F.col("t")[F.col("i") - 1]
    target = last["role"] == "assistant"
    size = F.when(target, F.char_length(escaped(last["text"]))).otherwise(0)
    return each.select("conv_id", (F.col("example") + 1).alias("example"), size.cast("long").alias("target_chars"),
                       target.alias("trainable"), text.alias("text")).select(
        "conv_id", "example",
        F.when(F.col("trainable"), F.char_length("text") - len(TAIL) - F.col("target_chars")).cast("long").alias("target_start"),
        "target_chars", "text")


def turns_of(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.slice(F.split(text, r"<\|im_end\|>\n"), 1, F.size(F.split(text, r"<\|im_end\|>\n")) - 1)
    header = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n"
    return F.transform(parts, lambda p: F.struct(
        plain(F.regexp_extract(p, header, 1)).alias("role"),
        plain(F.regexp_replace(p, header, "")).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: its turns as text, the trained text, and the formatted length, all taken
    from the examples."""
    target = F.when(F.col("target_start").isNotNull(),
                    plain(F.substring("text", F.col("target_start") + 1, F.col("target_chars"))))
    whole = formatted.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", target.alias("text")))),
                                 lambda x: x["text"]), "").alias("trained"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.withColumn("turns", turns_of(F.col("whole"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), "trained",
        F.char_length("whole").cast("long").alias("formatted_chars"))
