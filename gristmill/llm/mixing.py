"""Mixing sources to target weights: equal-token blocks go to sources by highest quotients, and a seed picks the blocks.

Everything here is a DataFrame expression. Texts are read once, for their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import settle

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its own words.
EPOCHS = 3
#: Words of a block; words and documents of a shard at most on average; shards that share quotas at a time.
BLOCK, SHARD_WORDS, SHARD_DOCS, SHARD_GROUP = 16, 1 << 18, 512, 1024
#: Equal rows that one task lists.
COPIES = 4096
SEED = 42
# A Lehmer generator, in arithmetic that any SQL engine repeats, and primes above any number of blocks of a shard.
_MODULUS, _FACTOR = 2147483647, 48271
_STRIDES = (1000000007, 1000000009, 1000000021, 1000000033)


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 of null: each word with what white space leads it becomes one letter."""
    bare = F.expr(f"rtrim(' \\t\\n\\u000b\\f\\r', {text})")
    return F.coalesce(F.length(F.regexp_replace(bare, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")), F.lit(0)).cast("long")


def _hash(column, salt: int):
    """A value in [0, 2**31 - 1) from an integer column; null is 0's."""
    start = F.pmod(F.coalesce(column, F.lit(0)), F.lit(_MODULUS))
    return F.pmod(F.pmod(start * _FACTOR + (SEED * 1009 + salt), F.lit(_MODULUS)) * _FACTOR, F.lit(_MODULUS))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``is_null, source, source_size, docs, target`` of each source of ``sizes (doc_id, source, size)``, each row as often as its ``copies`` say, if it has any.

    Sources in code point order, null last, weigh 5, 2, 1 and again; they share all words. A source stops at three times
    its size, the excess goes to the others by weight: with sources ordered by the share of their weight at which they
    stop, those before the first that the rest would not fill are full. One row for each source is all that is ordered.
    """
    copies = F.col("copies") if "copies" in sizes.columns else F.lit(1)
    sources = sizes.groupBy(F.col("source").isNull().alias("is_null"), "source").agg(F.sum(F.col("size") * copies).alias("source_size"), F.sum(copies).alias("docs"))
    rank = F.row_number().over(Window.orderBy("is_null", "source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = sources.select("*", rank.alias("sid"), weight.alias("weight"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    by_stop = Window.orderBy((F.col("source_size") * EPOCHS / F.col("weight")), "sid")
    before, rest = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing)
    spread = weighed.select("*", F.coalesce(F.sum(F.col("source_size") * EPOCHS).over(before), F.lit(0)).alias("filled"), F.sum("weight").over(rest).alias("open_weight"))
    stops = F.col("source_size") * EPOCHS * F.col("open_weight") <= (F.col("total") - F.col("filled")) * F.col("weight")
    marked = spread.withColumn("open_from", F.min(F.when(~stops, F.struct("filled", "open_weight"))).over(Window.partitionBy()))
    shared = (F.col("total") - F.col("open_from.filled")).cast("double") * F.col("weight") / F.col("open_from.open_weight")
    full = (F.col("source_size") * EPOCHS).cast("double")
    target = F.when(stops | F.col("open_from").isNull(), full).otherwise(F.least(shared, full))
    return marked.select("sid", "is_null", "source", "source_size", "docs", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], party: str, votes: str, seats: str, most: str) -> DataFrame:
    """``parties`` with ``quota``: Sainte-Laguë seats of each party among those of its group.

    ``votes`` are shares of the group's ``seats``; a seat's quotient is votes / (2 * seats before it + 1), highest first,
    then by party. A party gets at most ``most`` seats, one without votes none. The seats that a party surely has are given at once: with
    divisor V / (N - m / 2) for m parties, rounding gives no seat whose quotient is not among the N highest; and with
    V / (N + m / 2) it gives all that are. Only the few quotients between the two are ranked.
    """
    group = Window.partitionBy(*within)
    every = parties.select("*", F.sum(votes).over(group).alias("_v"), F.count(F.lit(1)).over(group).alias("_m"))
    seat = F.col(seats).cast("double")
    sure = F.when((F.col("_v") > 0) & (seat > F.col("_m") / 2), F.floor(F.col(votes) * (seat - F.col("_m") / 2) / F.col("_v") + 0.5)).otherwise(0)
    top = F.when(F.col("_v") > 0, F.ceil(F.col(votes) * (seat + F.col("_m") / 2) / F.col("_v") + 0.5)).otherwise(0)
    # One seat less and two more than that, so that no rounding error of a division can matter.
    bounded = every.withColumn("_sure", F.least(F.greatest(sure.cast("long") - 1, F.lit(0)), F.col(most))).withColumn("_top", F.least(top.cast("long") + 2, F.col(most)))
    open_seats = bounded.withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    steps = F.explode_outer(F.when((F.col(votes) > 0) & (F.col("_top") > F.col("_sure")), F.sequence("_sure", F.col("_top") - 1)))
    quotients = open_seats.select("*", steps.alias("_k"))
    order = group.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc_nulls_last(), party, "_k")
    won = quotients.select("*", (F.col("_k").isNotNull() & (F.row_number().over(order) <= F.col("_open"))).alias("_won"))
    keep = [F.first(c).alias(c) for c in parties.columns if c not in (*within, party)]
    return won.groupBy(*within, party).agg(*keep, (F.first("_sure") + F.sum(F.col("_won").cast("long"))).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every input row: how many of its words the mix takes, repeats counted.

    A source's documents fall into shards by a seeded hash of their ids and follow each other there in seeded order, cut
    into blocks of ``BLOCK`` words. Blocks go to sources, groups of shards and shards by Sainte-Laguë quotas. A shard's
    quota takes all its blocks as often as it goes, and of the rest those that a seeded stride reaches first; no block is
    taken more than three times, so no document either. Sources that are full take all their blocks three times.
    Null texts and texts without words have size 0, and texts may be of any length. Repeated rows are rows of their own. Rows of one
    id fall into one shard, null ids too, but rows of one id, source and size are one row with a count there, so that neither
    an id of very many rows nor null ids fill a task. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(f"`{text_col}`").alias("size"))
    sizes = settle(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    sources = source_targets(sizes).withColumn("blocks", F.round(F.col("target") / BLOCK).cast("long"))
    sources = settle(sources.coalesce(1), "sources")
    whole = sources.withColumn("all_blocks", F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long")).withColumn("most", F.ceil(F.col("source_size") / BLOCK) * EPOCHS)
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("docs") / SHARD_DOCS), F.lit(1)).cast("long")
    quotas = apportion(whole.select("sid", "is_null", "source", "source_size", "target", shards.alias("shards"), "all_blocks", "most"), [], "sid", "target", "all_blocks", "most")
    quotas = settle(quotas.coalesce(1), "quotas")
    own = quotas.select("sid", "is_null", F.col("source").alias("name"), "source_size", "target", "shards")
    placed = sizes.join(own, (F.coalesce("source", F.lit("")) == F.coalesce("name", F.lit(""))) & (F.col("source").isNull() == F.col("is_null"))).drop("name", "is_null", "source")
    placed = placed.withColumn("shard", _hash(F.col("doc_id"), 1) % F.col("shards"))

    line = Window.partitionBy("sid", "shard").orderBy(_hash(F.col("doc_id"), 2), "doc_id", "size")
    total = F.col("size") * F.col("copies")
    lined = placed.select("*", (F.sum(total).over(line.rowsBetween(Window.unboundedPreceding, 0)) - total).alias("start"))

    per_shard = placed.groupBy("sid", "shard").agg(F.sum(total).alias("words")).withColumn("shard_group", F.floor(F.col("shard") / SHARD_GROUP))
    per_shard = settle(per_shard.withColumn("most", F.ceil(F.col("words") / BLOCK) * EPOCHS), "shards")
    per_group = per_shard.groupBy("sid", "shard_group").agg(F.sum("words").alias("words"), F.sum("most").alias("most"))
    groups = apportion(per_group.join(quotas.select("sid", F.col("quota").alias("seats")), "sid"), ["sid"], "shard_group", "words", "seats", "most")
    inner = per_shard.join(groups.select("sid", "shard_group", F.col("quota").alias("seats")), ["sid", "shard_group"])
    by_shard = apportion(inner, ["sid", "shard_group"], "shard", "words", "seats", "most")
    n = F.ceil(F.col("words") / BLOCK)
    stride = F.element_at(F.array(*[F.lit(x) for x in _STRIDES]), (_hash(F.col("sid") * 7919 + F.col("shard"), 3) % len(_STRIDES) + 1).cast("int"))
    picks = by_shard.where("words > 0").select(
        "sid", "shard", n.alias("n"), F.floor(F.col("quota") / n).alias("every"), (F.col("quota") % n).alias("extra"), stride.alias("stride"), (_hash(F.col("sid") * 7919 + F.col("shard"), 4) % n).alias("shift")
    )
    merged = lined.join(picks, ["sid", "shard"], "left")
    # Equal rows follow each other in their shard; very many of them are listed by several tasks.
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    many = merged.where(F.col("copies") > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("from"))
    listed = many.repartition("sid", "doc_id", "size", "from").select("*", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (COPIES - 1), F.col("copies") - 1))).alias("copy")).drop("from")
    taken = merged.where(F.col("copies") <= COPIES).select("*", one).union(listed).withColumn("first", F.col("start") + F.col("copy") * F.col("size"))
    # Of the blocks that the document overlaps, the words inside those picked once more.
    more = F.expr(
        f"""CASE WHEN size > 0 AND extra > 0 THEN aggregate(
              sequence(first div {BLOCK}, (first + size - 1) div {BLOCK}), 0L,
              (acc, k) -> acc + IF((k * stride + shift) % n < extra, least(first + size, (k + 1) * {BLOCK}) - greatest(first, k * {BLOCK}), 0L))
            ELSE 0L END"""
    )
    words = F.coalesce(F.col("every") * F.col("size") + more, F.lit(0)).cast("long")
    return taken.select("doc_id", "size", "source_size", "target", words.alias("taken"))
