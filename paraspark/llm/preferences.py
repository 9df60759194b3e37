"""Preference formatting: one prompt and two masked completions from a pair of conversations.

The prompt is the longest common prefix of turns of the chosen and the rejected
conversation, rendered once; what follows in each is its completion. Only assistant
turns of a completion are learnt from: their character ranges are its mask. Built-in
functions throughout; a conversation is one row of the result and so fits into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paraspark.llm.common import cut_lineage, shuffle_partitions

TURN = "struct<role:string,text:string>"


def conversation_turns(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, place, role, text): turns numbered from 0 by turn, then role, then text.

    NULL roles and texts are empty, NULL turns come first; rows without a conversation are left out.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return (
        turns.where(F.col(conv_col).isNotNull())
        .select(
            F.col(conv_col).alias("conv"),
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("place", (F.row_number().over(order) - 1).cast("int"))
        .select("conv", "place", "role", "text")
    )


def _followers(convs: DataFrame, wrap: bool) -> DataFrame:
    """(conv, next): each conversation and the one with the next id among ``convs``.

    Ids are dealt in ranges; the last of a range is followed by the first of the next one, of
    which the driver holds one id a range.
    """
    ranges = shuffle_partitions(convs.sparkSession)
    dealt = cut_lineage(
        cut_lineage(convs).repartitionByRange(ranges, "conv").withColumn("range", F.spark_partition_id())
    )
    firsts = dealt.groupBy("range").agg(F.min("conv").alias("first")).orderBy("range").collect()
    after = [r["first"] for r in firsts[1:]] + [firsts[0]["first"] if wrap else None for _ in firsts[:1]]
    borders = convs.sparkSession.createDataFrame(
        [(r["range"], n) for r, n in zip(firsts, after, strict=True)],
        T.StructType([T.StructField("range", T.IntegerType()), T.StructField("first", dealt.schema["conv"].dataType)]),
    )
    ahead = F.lead("conv").over(Window.partitionBy("range").orderBy("conv"))
    paired = dealt.withColumn("ahead", ahead).join(F.broadcast(borders), "range")
    return paired.select("conv", F.coalesce("ahead", "first").alias("next")).where("next IS NOT NULL")


def rejected_from_next(turns: DataFrame, wrap: bool = False) -> DataFrame:
    """Rejected counterparts of ``conversation_turns``: the last assistant turn, and what follows
    it, gives way to the last assistant turn of the conversation with the next id.

    The next id is the next that has an assistant turn, whatever lies between; the last
    conversation has the first one after it with ``wrap``, else no counterpart. Nor have
    those without an assistant turn.
    """
    last = turns.where("role = 'assistant'").groupBy("conv").agg(
        F.max("place").alias("at"), F.max_by("text", "place").alias("reply")
    )
    followers = _followers(turns.where("role = 'assistant'").select("conv").distinct(), wrap)
    following = followers.join(last.select(F.col("conv").alias("next"), F.col("reply").alias("other")), "next")
    paired = last.select("conv", "at").join(following.select("conv", "other"), "conv")
    kept = turns.join(paired.select("conv", "at"), "conv").where("place < at").select("conv", "place", "role", "text")
    return kept.unionByName(
        paired.select("conv", F.col("at").alias("place"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    )


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Ranges of the assistant's texts and end marks in the rendered turns: start:end,..."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"]) + 7
        return F.struct(
            (end + 1).alias("at"),
            F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.concat_ws(":", start, end))))
            .otherwise(s["spans"])
            .alias("spans"),
        )

    return F.aggregate(turns, state, step, lambda s: F.array_join(s["spans"], ","))


def _gathered(turns: DataFrame, name: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("place", "role", "text")))
    return turns.groupBy("conv").agg(
        F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name)
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(conv_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of each pair.

    Both inputs are (conv, place, role, text) and are paired by ``conv``; unpaired ones
    are left out. Equal conversations have empty completions, those that differ
    from the first turn on an empty prompt. Masks are code point ranges in the completion,
    end exclusive. Empty tables give an empty result.
    """
    both = _gathered(chosen, "good").join(_gathered(rejected, "bad"), "conv")
    shorter = F.least(F.size("good"), F.size("bad"))
    differs = F.filter(
        F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.get("good", i) != F.get("bad", i))
    )
    split = both.withColumn("n", F.get(differs, 0))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return split.select(
        F.col("conv").alias("conv_id"),
        F.col("n").cast("long").alias("prompt_turns"),
        _render(F.slice("good", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("good")).alias("chosen"),
        _render(rest("bad")).alias("rejected"),
        _mask(rest("good")).alias("chosen_mask"),
        _mask(rest("bad")).alias("rejected_mask"),
    )
