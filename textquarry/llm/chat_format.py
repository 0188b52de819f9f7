"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as named users; system turns stay system turns. The mask covers what the assistant of that rendering says,
end marker included. A rendering comes in parts of ``PART_TURNS`` turns, so that no conversation, however long,
must fit in one row; spans count characters within their part. Each later part starts with the system turns that open the
conversation, so that it stands by itself; ``n_turns`` does not count these again.

Turns are ranked without gathering a conversation in one task: rows are range-partitioned in dialogue order, ranked
within their partition, and shifted by the counts of the partitions before.

Defined cases: rows with a null conversation take no part; turns with equal numbers are ordered by speaker, then text,
null turns come last; a null speaker is named ``unknown``; a null or empty text is an empty turn; repeated rows are
turns of their own; a conversation without participants gives no rows; an empty table gives an empty result; further
columns take no part. ``<|`` in texts gets one more bar, so that no text can pose as a marker; white space, angle brackets,
bars and per cent signs in names are percent-encoded, so that no two speakers share a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PART_TURNS = 64
#: Speakers that are no participants, and the parts of a rendered turn.
BYSTANDERS = ("system",)
END = "<|end|>\n"
#: Characters of names that are encoded, the per cent sign first.
ENCODED = "%<>| \t\n\x0b\x0c\r"


def safe_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|", "<||")


def safe_name(name: Column) -> Column:
    """The name with what would end or break a marker percent-encoded."""
    out = F.coalesce(name, F.lit("unknown"))
    for c in ENCODED:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def ranked(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, speaker, text) with ``rank`` from 0 within each conversation."""
    spark = turns.sparkSession
    order = ("turn", "speaker", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_range = turns.repartitionByRange(n, "conv_id", F.col("turn").asc_nulls_last(), "speaker", "text")
    dealt = written(by_range.withColumn("slot", F.spark_partition_id()))
    counts = dealt.groupBy("conv_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("conv_id", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    local = Window.partitionBy("conv_id", "slot").orderBy(F.col("turn").asc_nulls_last(), *order[1:])
    return (
        dealt.withColumn("local", F.row_number().over(local) - 1)
        .join(shifts, ["conv_id", "slot"])
        .withColumn("rank", F.col("local") + F.col("shift"))
        .drop("slot", "local", "shift")
    )


def rotate(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    bystanders: tuple[str, ...] = BYSTANDERS,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """conv_id, perspective, part, n_turns, text, spans: array of (start, stop) that the mask covers."""
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), safe_text(F.col(text_col)).alias("text")
    ).filter("conv_id IS NOT NULL")
    placed = written(ranked(turns).withColumn("part", F.floor(F.col("rank") / part_turns).cast("int")))
    speaks = ~F.col("speaker").isin(*bystanders)
    views = placed.filter(speaks).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # What opens a conversation, at most the system turns of its first part, opens its later parts too.
    first = placed.filter(speaks).groupBy("conv_id").agg(F.min("rank").alias("first"))
    openers = placed.filter(~speaks & (F.col("part") == 0)).join(first, "conv_id").filter("rank < first").drop("first", "part")
    later = placed.filter("part > 0").select("conv_id", "part").distinct()
    again = openers.join(later, "conv_id").select(*placed.columns, F.lit(True).alias("again"))
    seen = placed.withColumn("again", F.lit(False)).unionByName(again).join(views, "conv_id")
    mine = F.col("speaker") == F.col("perspective")
    head = (
        F.when(mine, "<|assistant|>\n")
        .when(speaks, F.concat(F.lit("<|user name="), safe_name(F.col("speaker")), F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|"), safe_name(F.col("speaker")), F.lit("|>\n")))
    )
    said = seen.select("conv_id", "perspective", "part", F.struct("rank", head.alias("head"), F.concat("text", F.lit(END)).alias("body"), mine.alias("mine"), "again").alias("turn"))
    # At most twice part_turns turns in a group.
    parts = said.groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def extend(acc, turn):
        first = acc["at"] + F.char_length(turn["head"])
        last = first + F.char_length(turn["body"])
        span = F.array(F.struct(first.alias("start"), last.alias("stop")))
        return F.struct(last.alias("at"), F.when(turn["mine"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return parts.select(
        "conv_id",
        "perspective",
        "part",
        F.size(F.filter("turns", lambda t: ~t["again"])).alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        F.aggregate("turns", start, extend, lambda acc: acc["spans"]).alias("spans"),
    )
