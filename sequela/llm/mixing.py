"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Targets: a source's share of ``epochs`` times all words follows its weight and stops at ``most``
times the source's own words; what is cut off is shared again by weight until no source is above.
Shards: a source's documents are dealt by hash into shards of bounded size, so no task orders a
whole source. Blocks: within a shard the documents stand in seeded order, and their words are cut
into blocks of ``block`` words. Highest quotients (divisors 1, 3, 5, ...) give each shard an integer
number of blocks; a shard takes all of its blocks as often as they fit in, and the rest as the
blocks with the smallest seeded hashes. So every run takes the same words; rows without a doc_id, or
with one of more rows than a shard, are dealt by their place in the table, so theirs are the same
only if the table is read in the same splits.

Only DataFrame operations are used. Documents' texts are never shuffled: the tables that move hold
one row a document, a block, a shard or a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequela.llm.common import staged


ROW = "_mix_row"
"""Each row's own key."""


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order (null last)."""

    weights: tuple = (5, 2, 1)
    epochs: float = 1.5
    most: int = 2
    block: int = 128
    shard_rows: int = 1_000
    seed: int = 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, how: Mix = Mix()) -> DataFrame:
    """``source, source_size, n_rows, weight, target`` from rows ``source, size``.

    Sources are ranked in one task; there is one row for each."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in how.weights]), (rank % len(how.weights) + 1).cast("int"))
    per = staged(per.withColumn("weight", weight).withColumn("cap", F.lit(float(how.most)) * F.col("source_size")), "sources")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * float(how.epochs)
    rate, capped = 0.0, -1
    while True:  # each turn caps at least one more source
        full = F.col("cap") <= F.lit(rate) * F.col("weight")
        n, used, weight_left = per.agg(
            F.sum(full.cast("long")), F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not n and n != 0 or n == capped or not weight_left:
            break
        rate, capped = max(rate, (total - used) / weight_left), n
    return per.withColumn("target", F.least("cap", F.lit(rate) * F.col("weight"))).drop("cap")


def quotas(units: DataFrame, seats: int, by: list[str]) -> DataFrame:
    """Sainte-Lague: ``quota`` seats for each row of ``units`` (columns ``by``, ``votes``), ``seats`` in
    all; equal quotients go to the row that comes first in ``by``.

    Each row's first seats follow from one divisor that cannot give out too many; the others go to
    the highest remaining quotients, of which there are at most about two a row.
    """
    votes, n = units.agg(F.sum("votes"), F.count("*")).first()
    if not votes or seats <= 0:
        return units.withColumn("quota", F.lit(0).cast("long"))
    low = max(0.0, seats - 0.5 * n - 1) / votes  # seats a vote, surely too few
    high = (seats + 0.5 * n + 1) / votes  # surely enough
    first = units.withColumn("base", F.floor(F.col("votes") * low + 0.5)).withColumn(
        "enough", F.floor(F.col("votes") * high + 0.5) + 1)
    first = staged(first, "seats")
    left = seats - first.agg(F.sum("base")).first()[0]
    more = (first.select(*by, "votes", F.explode(F.sequence("base", "enough")).alias("seat"))
            .orderBy((F.col("votes") / (2 * F.col("seat") + 1)).desc(), *[F.asc_nulls_last(c) for c in by])
            .limit(max(0, left)).groupBy(*by).agg(F.count("*").alias("extra")))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    return first.alias("f").join(more.alias("m"), same, "left").select(
        *[F.col(f"f.{c}") for c in units.columns], (F.col("base") + F.coalesce("extra", F.lit(0))).alias("quota"))


def _block_hash(source: Column, shard: Column, block: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(source, F.lit("")), source.isNull(), shard, block)


def plan(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """Which words of each document the mix takes: ``doc_id, source, size, source_size, target, shard,
    start`` (words before it in its shard), ``whole`` (times every block is taken) and ``last`` (blocks
    with a hash up to it are taken once more; null for none).

    Null texts and texts without words have size 0 and are taken 0 times. Rows that repeat a doc_id
    or have none are documents of their own, told apart by ``_mix_row`` (made here if ``docs`` has
    none). A null source is one source.
    """
    size = words(F.col("text").cast("string"))
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    sized = staged(docs.select(row.alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               size.alias("size")), "sizes")
    aims = staged(targets(sized, how), "targets")
    # A doc_id of more rows than a shard, or none, would fill one shard: such rows are dealt one by one.
    many = staged(sized.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > how.shard_rows) | F.col("doc_id").isNull())
                  .select("doc_id", F.lit(True).alias("many")), "many")
    one_by_one = F.when(F.col("m.many"), F.col(f"s.{ROW}"))
    lane = F.pmod(F.xxhash64(F.lit(how.seed), "s.doc_id", one_by_one), F.ceil(F.col("n_rows") / how.shard_rows)).cast("int")
    s, a, m = sized.alias("s"), aims.alias("a"), F.broadcast(many).alias("m")
    placed = s.join(a, F.col("s.source").eqNullSafe(F.col("a.source"))).join(
        m, F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")), "left").select(
        f"s.{ROW}", "s.doc_id", "s.source", "s.size", "a.source_size", "a.target", lane.alias("shard"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(how.seed + 1), "doc_id"), "doc_id", "size", ROW)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = staged(placed.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")), "placed")

    units = placed.groupBy("source", "shard").agg(
        F.sum("size").alias("words"), (F.first("target") * F.sum("size") / F.first("source_size")).alias("votes"))
    units = staged(units.where("words > 0"), "shards")
    seats = round((units.agg(F.sum("votes")).first()[0] or 0.0) / how.block)
    given = quotas(units, seats, ["source", "shard"])
    # No block is taken more than ``most`` times: a shard's last block may be short.
    blocks = F.ceil(F.col("words") / how.block)
    given = given.withColumn("blocks", blocks).withColumn("quota", F.least("quota", blocks * how.most))
    given = given.withColumn("whole", F.floor(F.col("quota") / F.col("blocks"))).withColumn(
        "part", F.col("quota") - F.col("whole") * F.col("blocks"))
    given = staged(given, "quotas")
    hashed = given.where("part > 0").select(
        "source", "shard", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    hashed = hashed.withColumn("h", _block_hash(F.col("source"), F.col("shard"), F.col("block"), how.seed))
    nth = hashed.withColumn("n", F.row_number().over(Window.partitionBy("source", "shard").orderBy("h", "block")))
    last = nth.where("n <= part").groupBy("source", "shard").agg(F.max("h").alias("last"))
    g, t = given.alias("g"), last.alias("t")
    rule = g.join(t, F.col("g.source").eqNullSafe(F.col("t.source")) & (F.col("g.shard") == F.col("t.shard")), "left")
    rule = staged(rule.select("g.source", "g.shard", "g.whole", "t.last"), "rules")
    p, r = placed.alias("p"), rule.alias("r")
    return p.join(r, F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p.shard") == F.col("r.shard")), "left").select(
        "p.*", F.coalesce("r.whole", F.lit(0)).alias("whole"), "r.last")


def _copies(block: Column, seed: int) -> Column:
    """Times the mix takes a block of the document's shard."""
    once = F.coalesce(_block_hash(F.col("source"), F.col("shard"), block, seed) <= F.col("last"), F.lit(False))
    return F.col("whole") + once.cast("long")


def taken(planned: DataFrame, how: Mix = Mix()) -> DataFrame:
    """``plan`` with the words taken of each document, repeats counted."""
    end = F.col("start") + F.col("size")
    span = F.sequence(F.floor(F.col("start") / how.block), F.floor((end - 1) / how.block))

    def add(total: Column, block: Column) -> Column:
        words_in = F.least(end, (block + 1) * how.block) - F.greatest(F.col("start"), block * how.block)
        return total + words_in * _copies(block, how.seed)

    total = F.when(F.col("size") > 0, F.aggregate(span, F.lit(0).cast("long"), add)).otherwise(0)
    return planned.withColumn("taken", total.cast("long"))


def mixed(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mix itself: the documents' rows with the text each pass takes, ``most`` passes over the data
    at most. A document taken whole keeps its text as it is; of one taken in part the words taken
    stand with single spaces between. Documents of which nothing is taken go.
    """
    keep = docs.columns
    docs = staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")  # the same key in the plan and here
    planned = taken(plan(docs, how), how).where("taken > 0")
    rules = staged(planned.select(F.col(ROW).alias("_key"), F.struct("size", "source", "shard", "start", "whole", "last").alias("_rule")), "rules")
    rows = docs.join(rules, docs[ROW] == rules["_key"]).select(
        *[docs[c] for c in keep], F.explode(F.sequence(F.lit(1), F.lit(how.most))).alias("_turn"), "_rule")
    rule = F.col("_rule")
    once = lambda b: rule["whole"] + F.coalesce(
        _block_hash(rule["source"], rule["shard"], b, how.seed) <= rule["last"], F.lit(False)).cast("long")
    first, last = F.floor(rule["start"] / how.block), F.floor((rule["start"] + rule["size"] - 1) / how.block)
    least = F.array_min(F.transform(F.sequence(first, last), once))
    picked = F.array_join(F.filter(F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), 1),
                                   lambda w, i: once(F.floor((rule["start"] + i) / how.block)) >= F.col("_turn")), " ")
    text = F.when(least >= F.col("_turn"), F.col("text")).otherwise(picked)
    out = rows.withColumn("_text", text).where("_text <> ''")
    return out.select(*[F.col("_text").alias("text") if c == "text"
                        else F.char_length("_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c)
                        for c in keep])
