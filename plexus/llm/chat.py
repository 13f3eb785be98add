"""Chat formatting by cumulative-snapshot collapse.

Logs hold a conversation again and again as it grows. Every turn gets the hash
of the conversation up to it (a rolling sum of position-bound turn hashes, two
of 64 bits). A conversation whose full hash is another's prefix hash is a
snapshot of that longer one; an anti-join drops it. Of equal conversations the
one with the smallest conv_id stays. The rest is rendered.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.llm.rows import pick
from plexus.plans.scratch import materialise


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds k (turns up to this one), n (turns in all), a and b (the prefix's hashes); ordered by turn, role, text.

    The sums run in two steps, over blocks of 64 turn numbers and within them,
    so that a very long conversation is summed by many tasks.
    """
    t = turns.select("conv_id", "turn", "role", "text").withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / 64).cast("long"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("m"))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("m").over(over), F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy("conv_id")))
    same = lambda x, y: x["conv_id"].eqNullSafe(y["conv_id"]) & (x["block"] == y["block"])
    t = t.withColumn("i", F.row_number().over(inside))
    t = t.join(sizes, same(t, sizes)).select(t["conv_id"], t["block"], "turn", "role", "text", (F.col("i") + F.col("before")).alias("k"), "n")
    wide = lambda c: c.cast("decimal(20,0)")
    t = t.withColumn("ha", wide(F.xxhash64("k", "role", "text"))).withColumn("hb", wide(F.xxhash64(F.lit("b"), "text", "k", "role")))
    part = t.groupBy("conv_id", "block").agg(F.sum("ha").alias("sa"), F.sum("hb").alias("sb"))
    part = part.select(F.col("conv_id").alias("c"), F.col("block").alias("p"), *(F.coalesce(F.sum(x).over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)").alias(x) for x in ("sa", "sb")))
    run = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("ra", F.sum("ha").over(run)).withColumn("rb", F.sum("hb").over(run))
    return t.join(part, t["conv_id"].eqNullSafe(part["c"]) & (t["block"] == part["p"])).select("conv_id", "turn", "role", "text", "k", "n", (F.col("ra") + F.col("sa")).cast("decimal(38,0)").alias("a"), (F.col("rb") + F.col("sb")).cast("decimal(38,0)").alias("b"))


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hashed turns, conv_id of the conversations that stay)."""
    hashed = materialise(prefix_hashes(turns), "prefixes")
    whole = hashed.where("k = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.where("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    return hashed, whole.join(prefixes, ["n", "a", "b"], "left_anti").select("conv_id")


def collapse(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, rendered, rendered_sha256.

    Each turn is rendered as ``<|role|>``, a line break, its text and
    ``<|end|>``, and turns are joined by line breaks. Null roles and texts are
    as empty in both hash and rendering; turns with equal numbers are ordered by
    role, then text; null turn numbers come first; repeated rows are turns of
    their own. Turns of a null conv_id are one conversation, whose id is null
    and which yields to an equal one with an id. Ids may be of any type, other
    columns may have any names. Markers within a text are not escaped, as the
    rendering is fixed. An empty table gives an empty result.
    """
    plain = pick(turns, conv_id=conv_id, turn=turn, role=role, text=text).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")})
    hashed, stay = maximal_conversations(plain)
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>"))
    stay = stay.select(F.col("conv_id").alias("id"))
    kept = hashed.join(stay, hashed["conv_id"].eqNullSafe(stay["id"]), "left_semi")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("said")))), lambda x: x["said"])
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(lines, "\n").alias("rendered")).withColumn("rendered_sha256", F.sha2("rendered", 256))
