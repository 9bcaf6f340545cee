"""Multi-party chat formatting by perspective rotation. DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as
named users; system turns stay system turns. The rendering is one row a turn and perspective, with its place in the
whole dialogue and the stretch that counts for training (the assistant's text and its end mark), so that a conversation
of any length is never gathered into one cell; rendered() makes whole dialogues of it, for those who want that.

Places are summed once a turn, as if all speakers were users; a perspective's own turns before a turn correct the sum,
as each of them differs by the same length. So texts are shuffled once, before they are multiplied by the participants.
The turns are cut into parts by their order; totals of parts, without texts, are accumulated and joined back, so that a
conversation with very many turns is cut like any other.

Defined results: a null role is the participant `unknown`, a null text counts as empty, null turns come first and null
conversations are one of their own; equal turns stand in the order of role, then text (rows that are equal in all of
these, to the text's first 64 characters, lie in one part); repeated rows are turns of their own; a conversation with
system turns only has no perspective and no rows; an empty table gives an empty table; only the four columns are read, so
that clashing extra ones don't matter. `<|` in a text or name becomes `< |`, and line breaks in a name become spaces, so
that no text can forge a turn; the column perspective holds the role as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.operators.prefix import cuts_of, part_of, parts_for

# Marks of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _escaped(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.translate(_escaped(role), "\n\r", "  ")


def _as_user(role: Column) -> Column:
    return F.when(role == "system", role).otherwise(F.concat(F.lit("user name="), _name(role)))


def _length(head: Column) -> Column:
    """Code points of a turn without its text."""
    return F.length(head) + (len(OPEN) + len(CLOSE) + 2)


def rotated(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: int | None = None) -> DataFrame:
    """conv_id, perspective, turn, segment, start, train_start, train_end (code points; the last two null for others' turns)."""
    rows = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), _escaped(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    # one column that is never null, so that joins and windows share one partitioning
    keyed = rows.withColumns({"c": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), "has": F.col("turn").isNotNull().cast("int"), "at": F.coalesce("turn", F.lit(0)), "front": F.substring("text", 1, 64)})
    order = [(x, True) for x in ("c", "has", "at", "role", "front")]
    cuts = cuts_of(keyed, order, parts_for(turns, parts))
    placed = keyed.withColumn("part", part_of(order, cuts)).drop("front").withColumn("size", (_length(_as_user(F.col("role"))) + F.length("text")).cast("long"))
    # without texts: what each part of a conversation adds, and what lies before it
    added = placed.groupBy("c", "part", "role").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = added.groupBy("c", "part").agg(F.sum("size").alias("size"))
    totals = totals.select("c", "part", F.coalesce(F.sum("size").over(before.partitionBy("c")), F.lit(0)).alias("earlier"))
    people = added.where("role <> 'system'").select("c", F.col("role").alias("perspective")).distinct()
    own = added.select("c", "part", F.col("role").alias("perspective"), "n")
    bases = totals.join(people, "c").join(own, ["c", "part", "perspective"], "left")
    bases = bases.select("c", "part", "perspective", "earlier", F.coalesce(F.sum("n").over(before.partitionBy("c", "perspective")), F.lit(0)).alias("own_earlier"))

    inside = Window.partitionBy("c", "part").orderBy("has", "at", "role", "text")
    near = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # equal rows keep the place that they got here
    both = placed.withColumns({"near": near, "place": F.row_number().over(inside)}).join(bases, ["c", "part"])
    own = Window.partitionBy("c", "part", "perspective").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.col("role") == F.col("perspective")
    own_before = F.col("own_earlier") + F.coalesce(F.sum(mine.cast("long")).over(own), F.lit(0))
    shorter = F.lit(len("assistant")) - F.length(_as_user(F.col("perspective")))
    head = F.concat(F.lit(OPEN), F.when(mine, "assistant").otherwise(_as_user(F.col("role"))), F.lit("\n"))
    made = both.select("conv_id", "perspective", "turn", F.concat(head, "text", F.lit(CLOSE + "\n")).alias("segment"), (F.col("earlier") + F.col("near") + own_before * shorter).cast("long").alias("start"), mine.alias("mine"))
    train_start = F.col("start") + len(OPEN) + len("assistant") + 1
    return made.select("conv_id", "perspective", "turn", "segment", "start", F.when(F.col("mine"), train_start).alias("train_start"), F.when(F.col("mine"), F.col("start") + F.length("segment") - 1).alias("train_end"))


def rendered(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: int | None = None) -> DataFrame:
    """conv_id, perspective, dialogue, trained (a list of start and end): whole, so each dialogue has to fit in a cell."""
    made = rotated(turns, conversation, turn, role, text, parts)
    held = made.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("start", "segment", "train_start", "train_end"))).alias("s"))
    trained = F.transform(F.filter("s", lambda s: s["train_start"].isNotNull()), lambda s: F.struct(s["train_start"].alias("start"), s["train_end"].alias("end")))
    return held.select("conv_id", "perspective", F.array_join("s.segment", "").alias("dialogue"), trained.alias("trained"))
