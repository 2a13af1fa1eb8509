"""Chat formatting: every participant's perspective of a dialogue.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logtab.llm.common import materialise, same

MAX_TURNS = 256
SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def plain(text: Column) -> Column:
    """Text that cannot be taken for a control token."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def ranked(turns: DataFrame) -> DataFrame:
    """Add ``rank``, each row's place in its dialogue (from 0), without
    bringing a dialogue into one task.

    Rows are dealt by ranges of the whole order, so a long dialogue lies in
    several partitions; each row is numbered among its dialogue's rows of its
    partition, and the counts of the partitions before are added.
    """
    order = ["conv", "turn", "speaker", "text", "tie"]
    dealt = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    dealt = materialise(dealt.withColumn("part_id", F.spark_partition_id()), "chat-turns")
    counts = dealt.groupBy("conv", "part_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counts.select(F.col("conv").alias("__conv"), F.col("part_id").alias("__part"),
                                        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "chat-offsets")
    own = Window.partitionBy("conv", "part_id").orderBy("turn", "speaker", "text", "tie")
    met = dealt.withColumn("own", F.row_number().over(own)).join(
        offsets, same((F.col("conv"), F.col("__conv")), (F.col("part_id"), F.col("__part"))))
    return met.select("conv", "turn", "speaker", "text", (F.col("offset") + F.col("own") - 1).alias("rank"))


def perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
                 text_col: str = "text", max_turns: int = MAX_TURNS) -> DataFrame:
    """``(conv_id, part, speaker, text, spans, n_turns)``: each dialogue once
    per participant.

    In a participant's rendering their own turns are the assistant's, every
    other speaker is a user named by ``name=``, and ``system`` turns stay the
    system's.  ``spans`` lists the stretches (start, end exclusive, in code
    points of ``text``) to train on: the participant's turns with their end
    tokens; all else is masked.  Turns follow (turn, speaker, text).  Control
    tokens within turns and names are broken up by a space.

    Dialogues of more than ``max_turns`` turns are rendered in parts of that
    many, so no row grows without bound and no turn is lost.  Every
    participant of the dialogue has every part, and each later part begins
    with the system turns that opened the dialogue, which ``n_turns`` does not
    count again.  A dialogue of system turns alone has no participant and no
    row.

    A null speaker is ``unknown``, a null text empty, a null turn comes
    first, and rows without a conversation id make up one dialogue of their
    own.  Repeated rows are repeated turns; an empty table has no row; other
    columns play no part.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        plain(F.coalesce(F.col(speaker_col).cast("string"), F.lit(UNKNOWN))).alias("speaker"),
        plain(F.col(text_col).cast("string")).alias("text"))
    placed = ranked(turns)
    turn = F.struct("rank", "speaker", "text")
    parts = placed.groupBy("conv", F.floor(F.col("rank") / max_turns).cast("long").alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = materialise(parts, "chat-parts")
    spoken = F.array_except(F.transform("turns", lambda t: t["speaker"]), F.array(F.lit(SYSTEM)))
    none = F.array().cast(parts.schema["turns"].dataType)
    long = parts.where("part > 0").select(F.col("conv").alias("__conv")).distinct()
    each = parts.select("conv", "part", "turns", none.alias("opening"), F.explode(spoken).alias("me"))
    if not long.isEmpty():
        long = materialise(long, "chat-long")
        cut = same((F.col("conv"), F.col("__conv")))
        whole, split = each.join(long, cut, "left_anti"), parts.join(long, cut, "left_semi")
        people = split.select(F.col("conv").alias("__conv"), F.explode(spoken).alias("me")).distinct()
        # the system turns before anyone else's
        others = F.transform("turns", lambda t: F.when(t["speaker"] != SYSTEM, t["rank"]))
        first = split.groupBy(F.col("conv").alias("__conv")).agg(F.min(F.array_min(others)).alias("first"))
        opening = (split.join(first, cut).where(F.col("part") * max_turns < F.col("first"))
                   .select("__conv", F.explode(F.filter("turns", lambda t: t["rank"] < F.col("first"))).alias("t"))
                   .groupBy("__conv").agg(F.sort_array(F.collect_list("t")).alias("opening")))
        heads = people.join(opening.withColumnRenamed("__conv", "__of"), same((F.col("__conv"), F.col("__of"))), "left")
        later = F.when(F.col("part") > 0, F.filter(F.coalesce("opening", none), lambda t: t["rank"] < F.col("part") * max_turns)).otherwise(none)
        each = whole.unionByName(split.join(heads, cut).select("conv", "part", "turns", later.alias("opening"), "me"))

    def message(t: Column, me: Column) -> Column:
        head = (F.when(t["speaker"] == SYSTEM, F.lit(SYSTEM)).when(t["speaker"] == me, F.lit("assistant"))
                .otherwise(F.concat(F.lit("user name="), t["speaker"])))
        head = F.concat(F.lit(START), head, F.lit("\n"))
        body = F.concat(t["text"], F.lit(END))
        return F.struct(head.alias("head"), body.alias("body"), (t["speaker"] == me).alias("mine"))

    rendered = each.withColumn("messages", F.transform(F.concat("opening", "turns"), lambda t: message(t, F.col("me"))))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "")

    def walk(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["head"])
        end = start + F.char_length(m["body"])
        spans = F.when(m["mine"], F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))
    spans = F.aggregate("messages", empty, walk, lambda acc: acc["spans"])
    return rendered.select(F.col("conv").alias(conv_col), "part", F.col("me").alias("speaker"), text.alias("text"),
                           spans.alias("spans"), F.size("turns").alias("n_turns"))
