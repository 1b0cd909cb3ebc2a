"""Mixing sources to target weights by systematic sampling.

Within a source each document expects the same number of copies. Documents stand in order of size, the expected
copies are summed up along them, one offset is added, and a copy is emitted for each whole number crossed. So a
document gets its expectation rounded down or up, and a source comes within about one document of its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, number_rows, with_ids

_UNIT = 1 << 20


def word_counts(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and ``size``, the number of words (a null text has none)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in K.Text.of(batch.column(len(keys))):
                text.split_words()
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keys))), pa.array(text.n_words.astype(np.int64))], [*keys, "size"])

    schema = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keys)
    return docs.select(*keys, "text").mapInArrow(step, f"{schema}size long")


def water_level(sources: DataFrame, budget: float) -> float:
    """The level v at which min(cap, v * weight) sums to the budget; inf if all caps together are less.

    Each round fixes the sources over their cap; the driver sees two sums a round.
    """
    level, fixed = -1.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        s = sources.agg(F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count(F.when(over, 1)).alias("fixed")).first()
        if not s["weight"]:
            return float("inf")
        if s["fixed"] == fixed:
            return level
        fixed, level = s["fixed"], (budget - (s["cap"] or 0)) / s["weight"]


def mix_sources(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: str = "mix", source: str = "source", id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One row a document: doc_id, rid, source, size, source_size, target, copies, taken.

    Sources by code point (null last) take the weights in turn; they share ``share`` of all words, and none takes
    more than ``most`` times its own (the excess is reshared). Targets and copies depend on the rows and the seed
    only, so reruns agree. A null text is empty, with size 0; it may get copies but takes nothing. Null ids come
    last, rows with equal ids are rows of their own. A source without words has target 0. Empty tables and extra
    columns do no harm.
    """
    scratch = scratch or Scratch(spark, "mixing")
    held = docs.select(F.col(id_col), F.col(source).alias("source"), F.col("text"))
    sizes = scratch.write(word_counts(with_ids(spark, held, id_col, ["text", "source"], scratch), "rid", "doc_id", "source"), "sizes")
    rows = number_rows(spark, sizes, [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("rid").asc()], "place", scratch)
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("begin"))
    ranked = number_rows(spark, totals, [F.col("source").asc_nulls_last()], "rank", scratch)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = scratch.write(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(ranked, share * total)
    raised = F.col("weight") * F.lit(level)
    target = F.when(F.col("cap") < raised, F.col("cap").cast("double")).otherwise(raised)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("long")
    ranked = ranked.withColumn("target", target).withColumn("step", F.floor(rate * _UNIT).cast("long")).withColumn("offset", start)
    ranked = ranked.select(F.col("source").alias("_source"), "source_size", "begin", "target", "step", "offset")
    out = rows.join(ranked, rows["source"].eqNullSafe(ranked["_source"]))
    k = F.col("place") - F.col("begin")
    crossed = lambda k: F.expr(f"shiftright({k}, 20)")
    out = out.withColumn("_low", F.col("offset") + F.col("step") * k).withColumn("_high", F.col("_low") + F.col("step"))
    out = out.withColumn("copies", crossed("_high") - crossed("_low"))
    return out.select("doc_id", "rid", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, source: str = "source", id_col: str = "doc_id", **options: object) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    The cases of ``mix_sources`` hold.
    """
    scratch = Scratch(spark, "mixing")
    others = [c for c in docs.columns if c not in (id_col, source, "text")]
    packed = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("string")
    held = docs.select(F.col(id_col), F.col(source).alias("source"), F.col("text"), packed.alias("others"))
    rows = with_ids(spark, held, id_col, ["text", "source", "others"], scratch)
    copies = mix_sources(spark, rows.drop("doc_id"), source="source", id_col="rid", scratch=scratch, **options)
    copies = scratch.write(copies.filter("copies > 0").select(F.col("doc_id").alias("rid"), F.col("copies").cast("int").alias("copies")), "copies")
    # nearly all documents are taken, so texts move at every size; no broadcast that only small inputs would get
    out = rows.join(copies.hint("merge"), "rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    back = {id_col: F.col("doc_id"), source: F.col("source"), "text": F.col("text")}
    return out.select(*((back[c] if c in back else F.col("others").getField(c)).alias(c) for c in docs.columns))
