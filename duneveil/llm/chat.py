"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the others
as named users, and a loss mask over the assistant's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
END = "<|end|>\n"


def plain(text: Column) -> Column:
    """Text that can't be read as a marker: each <| gets a blank in the middle."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def named(speaker: Column) -> Column:
    """A speaker's name as it stands in a marker: what could end it is written by its code, so that two names never become one."""
    for sign in "%|<>\n":
        speaker = F.replace(speaker, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return speaker


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    narrators: tuple[str, ...] = ("system",), block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """(conversation, perspective, block, start, n_turns, rendered, mask), a row for each participant and block of turns.

    A block is the turns whose numbers agree when divided by block_turns, so that no conversation is gathered
    whole; a conversation's rendering is its blocks in order, null (turns without a number) last.
    A turn is "<|assistant|>", "<|user NAME|>" or "<|system|>", a line feed, its text, "<|end|>" and a line feed.
    mask: start-end of the characters to learn (the assistant's text and end marker, without the line feed),
    counted in the block and joined by commas; empty if there are none; start: the characters of the blocks before, to be added
    for places in the conversation.  Narrators speak but are no perspective.
    A null speaker is named "unknown"; a null text is empty.  Turns with the same number come in the order of
    speaker and text; repeated rows stay.  Long texts stay whole, an empty table gives no row.  A conversation without participants gives no row.  Other columns are
    ignored, whatever their names.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), plain(F.col(text_col)).alias("words"),
    )
    rows = rows.withColumns({"block": F.floor(F.col("turn") / block_turns), "size": F.length("words")})
    spoken = rows.filter(~F.col("speaker").isin(*narrators)) if narrators else rows
    parties = spoken.select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker").isin(*narrators) if narrators else F.lit(False), F.concat(F.lit("<|"), named(F.col("speaker")), F.lit("|>\n")))
    head = head.otherwise(F.concat(F.lit("<|user "), named(F.col("speaker")), F.lit("|>\n")))
    faced = lambda some: some.join(parties, F.col("conv").eqNullSafe(F.col("of"))).drop("of").withColumns({"head": head, "own": own})
    faces = faced(rows.drop("size")).withColumn("piece", F.concat("head", "words", F.lit(END)))
    # where a block starts is found from lengths alone, a row for each block; it comes before the block's turns
    sizes = faced(rows.drop("words")).groupBy("conv", "perspective", "block").agg(F.sum(F.length("head") + F.col("size") + len(END)).alias("size"))
    earlier = Window.partitionBy("conv", "perspective").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "perspective", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("long").alias("start"))
    faces = faces.unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy("conv", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "words")
    end = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    faces = faces.withColumns({"place": F.row_number().over(order), "end": end})
    begin = F.col("end") - F.length("piece") + F.length("head")
    span = F.when(F.col("own"), F.concat(begin.cast("string"), F.lit("-"), (F.col("end") - 1).cast("string")))
    gathered = faces.withColumn("span", span).groupBy("conv", "perspective", "block").agg(
        F.max("start").alias("start"), F.count("piece").alias("n_turns"), F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", "piece", "span")))).alias("all")
    )
    spans = F.filter(F.transform("all", lambda x: x["span"]), lambda x: x.isNotNull())
    return gathered.select(
        F.col("conv").alias(conv_col), "perspective", "block", "start", "n_turns",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("rendered"), F.array_join(spans, ",").alias("mask"),
    )
