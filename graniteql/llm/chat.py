"""Multi-party chat formatting by perspective rotation, in DataFrame functions only.

Each dialogue is rendered once for every participant: that speaker is the assistant, everybody else a named
user, system turns stay system turns. The mask holds the spans of the text that the assistant is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import KEY_CHARS, Scratch, number_rows

END = "<|end|>"
NOBODY = "unknown"


def _safe(text: Column) -> Column:
    """Content can't forge a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(role: Column, speaker: Column, system: str) -> Column:
    return (
        F.when(role == system, F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _safe(role), F.lit("|>\n")))
    )


def rotate(spark: SparkSession, turns: DataFrame, system: str = "system", turns_a_part: int | None = 256) -> DataFrame:
    """One row for each conversation, speaker and part: conv_id, part, speaker, text, mask, n_turns, n_own_turns.

    turns: conv_id, turn, role, text. A dialogue of up to ``turns_a_part`` turns is one part, a longer one several, so
    that a conversation of any length is never gathered in one row or task; with None all are whole, for dialogues
    whose length is known to be bounded. Parts in order make up the whole dialogue, and each later part repeats at its
    head the system turns that open the dialogue (those of its first part); other turns before it aren't in it.
    n_turns counts a part's own turns.

    Turns stand in order of turn (nulls last), then role, then text; repeated rows are turns of their own. A null role
    speaks as "unknown", a null text is empty, rows with a null conv_id make one conversation. Conversations of system
    turns alone have no participant and give no row; a participant who is silent in a part has an empty mask there.
    mask: array of (start, end) in code points of ``text``, the speaker's words and end markers. Extra columns are
    ignored; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "chat")
    rows = turns.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit(NOBODY)).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = scratch.write(rows, "turns")
    deal = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc()]
    rows = number_rows(spark, rows, [*deal, F.col("text").asc()], "place", scratch, deal=[*deal, F.substring("text", 1, KEY_CHARS).asc()])
    spans = rows.groupBy("conv_id").agg(F.min("place").alias("begin"), F.min(F.when(F.col("role") != system, F.col("place"))).alias("opened"))
    spans = spans.filter("opened is not null").withColumnRenamed("conv_id", "_conv")
    rows = rows.join(spans, rows["conv_id"].eqNullSafe(spans["_conv"])).drop("_conv")
    part = F.lit(0) if turns_a_part is None else F.floor((F.col("place") - F.col("begin")) / turns_a_part)
    rows = rows.withColumn("part", part.cast("long"))
    told = F.sort_array(F.collect_list(F.struct("place", "role", "text")))
    parts = rows.groupBy("conv_id", "begin", "part").agg(told.alias("turns"))
    opening = rows.filter("place < opened and part = 0").groupBy("begin").agg(told.alias("opening"))
    people = rows.filter(F.col("role") != system).select("begin", F.col("role").alias("speaker")).distinct()
    parts = parts.join(opening, "begin", "left").withColumn("n_turns", F.size("turns").cast("long"))
    again = F.when((F.col("part") > 0) & F.col("opening").isNotNull(), F.concat("opening", "turns")).otherwise(F.col("turns"))
    each = parts.withColumn("turns", again).join(people, "begin").select("conv_id", "part", "turns", "n_turns", "speaker")

    def piece(t: Column) -> Column:
        head, body = _head(t["role"], F.col("speaker"), system), F.concat(_safe(t["text"]), F.lit(END))
        own = (t["role"] == F.col("speaker")) & (t["role"] != system)
        return F.struct(F.concat(head, body, F.lit("\n")).alias("text"), F.length(head).alias("skip"), F.length(body).alias("size"), own.alias("own"))

    each = each.withColumn("pieces", F.transform("turns", piece))
    none = F.expr("struct(cast(0 as int) as at, cast(array() as array<struct<start:int,end:int>>) as spans)")

    def follow(state: Column, p: Column) -> Column:
        low = state["at"] + p["skip"]
        span = F.array(F.struct(low.alias("start"), (low + p["size"]).alias("end")))
        spans = F.when(p["own"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((low + p["size"] + 1).alias("at"), spans.alias("spans"))

    return each.select(
        "conv_id",
        "part",
        "speaker",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
        F.aggregate("pieces", none, follow)["spans"].alias("mask"),
        "n_turns",
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own_turns"),
    )
