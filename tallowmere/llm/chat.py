"""Chat formatting: cumulative snapshots of a conversation collapse to the longest, which is rendered.

A logged conversation is a snapshot if its turns are the first turns of a longer one.  Each turn's hash
is keyed by its place, and rolling exclusive-or over the turns gives every prefix a hash of 128 bits; a
conversation whose whole hash is a strict prefix's hash elsewhere goes, in an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in marks; a mark inside a text gets a blank, so that no text can pose as a turn."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def placed_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, unit, place, role, text, h1, h2)``: the turns in order, each with the hash of the prefix that it ends.

    Turns are ordered by turn, then role and text; null turns come last, a null role is ``unknown``, a null
    text is empty.  A turn logged several times counts once.  A turn without conv_id belongs to no other:
    it is a conversation of its own, so such rows are no group however many they are.  ``unit`` names the
    conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    alone = F.concat(F.lit("none "), F.md5(role), F.md5(text))
    unit = F.coalesce(F.col("conv_id").cast("string"), alone)
    turn = F.when(F.col("conv_id").isNotNull(), F.col("turn"))
    t = turns.select(unit.alias("unit"), "conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"))
    t = t.repartition("unit").distinct()
    order = W.partitionBy("unit").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    t = t.withColumn("place", F.row_number().over(order))
    for k in (1, 2):
        own = F.xxhash64(F.lit(k), "place", "role", "text")
        t = t.withColumn(f"h{k}", F.bit_xor(own).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return t.select("conv_id", "unit", "place", "role", "text", "h1", "h2")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered of each conversation that is no prefix of a longer one.

    Of conversations with the same turns, the one with the least id stays (a null id only if there is no
    other).  The prefixes and the whole conversations are made distinct before the anti-join, so a first
    turn or a conversation that is very common is one row in it; only what stays is rendered.  Turns
    are read as :func:`placed_turns` says.  No rows give no rows.
    """
    with Scratch(turns.sparkSession) as scratch:
        t = scratch.keep(placed_turns(turns))
        lengths = t.groupBy("unit").agg(F.max("place").alias("n_turns"))
        ends = t.select("conv_id", "unit", "place", "h1", "h2").join(lengths, "unit").withColumn("last", F.col("place") == F.col("n_turns"))
        first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "unit", "n_turns")).alias("first")
        # one pass over the prefixes: a whole conversation goes if a longer one has the same prefix
        seen = ends.groupBy("place", "h1", "h2", "last").agg(first)
        seen = scratch.write(seen)
        prefix = ["place", "h1", "h2"]
        longest = seen.where("last").join(seen.where("not last").select(*prefix), prefix, "left_anti")
        longest = scratch.keep(longest.select(F.col("first.unit").alias("__unit"), F.col("first.n_turns").cast("long").alias("n_turns")))
    stays = t.join(longest, F.col("unit") == F.col("__unit"))
    lines = F.array_sort(F.collect_list(F.struct("place", rendered_turn(F.col("role"), F.col("text")).alias("line"))))
    whole = stays.groupBy("unit", "conv_id", "n_turns").agg(F.array_join(lines["line"], "").alias("rendered"))
    return whole.select("conv_id", "n_turns", "rendered")
