"""Host-level quality rules.

Each document is measured and judged by simple rules; failures are counted by host (``source``), the hosts'
failure rates are shrunk with a beta prior fitted to all hosts, and a host whose shrunk rate is too high
loses all its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .scratch import Scratch

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rules:
    """Limits. A host is rejected when its shrunk failure rate is above ``host_rate``."""

    min_words: int = 10
    repeat_window: int = 5
    repeat_percent: int = 20
    host_rate: float = 0.5


def measure(text: K.Text, window: int) -> list[np.ndarray]:
    """The five measures of each text, in the order of MEASURES."""
    text.split_words()
    words = text.n_words
    chars = text.per_text(K._LEAD & ~K._SPACE)
    symbols = text.per_text(K._SYMBOL)

    starts, ends = text.full_lines()
    full = np.searchsorted(text.starts, ends) > np.searchsorted(text.starts, starts)
    starts, ends = starts[full], ends[full]
    owner = np.searchsorted(text.offsets, starts, side="right") - 1
    later = K.again(owner, K.span_hash(text.data, starts, ends))[1]
    dup_lines = np.bincount(owner[later], minlength=text.n)

    value, at = K.windows(text.word_hash(), text.first, window)
    twice = K.again(np.searchsorted(text.first, at, side="right"), value)[0]
    covered = np.concatenate([[0], np.cumsum(K.covered(len(text.starts), at[twice], window))])
    return [words, chars, symbols, dup_lines, covered[text.first[1:]] - covered[text.first[:-1]]]


def measured(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(row, measures...): the whole row as a struct, so that its columns may have any names; needs a column text
    (null: no words). The measures come with ``base_failed`` in a struct of their own."""
    names, place = [x.split()[0] for x in MEASURES.split(", ")], docs.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            for a, b, text in K.Text.of(row.field(place)):
                columns = measure(text, rules.repeat_window)
                failed = (columns[0] < rules.min_words) | (100 * columns[4] > rules.repeat_percent * columns[0])
                found = pa.StructArray.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed)], [*names, "base_failed"])
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), found], ["row", "found"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("found", T._parse_datatype_string(f"{MEASURES}, base_failed boolean"))])
    return rows.mapInArrow(step, schema)


def host_verdicts(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(host, n, failed) -> (host, host_rate, host_kept).

    The prior is Beta(a, b) by the method of moments: the mean of the hosts' rates, and their variance less
    what sampling alone would give. Hosts that don't differ get a strong prior, so all shrink to the mean.
    """
    rate = F.col("failed") / F.col("n")
    m = counts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("inverse")).first()
    mean = m["mean"] or 0.0
    spread = mean * (1 - mean)
    between = max((m["var"] or 0.0) - spread * (m["inverse"] or 0.0), spread * 1e-6)
    strength = spread / between - 1 if between > 0 else 1.0
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return counts.select("host", shrunk.alias("host_rate"), (shrunk <= F.lit(rules.host_rate)).alias("host_kept"))


def _host_counts(rows: DataFrame) -> DataFrame:
    """(host, base_failed) -> (host, n, failed)"""
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))


def judge(spark: SparkSession, docs: DataFrame, host: str = "source", id_col: str = "doc_id", rules: Rules = Rules()) -> DataFrame:
    """One row a document: id, host, the measures, base_failed, host_rate, kept.

    A null text has no words and fails; a null host is a host of its own. Rows are judged singly, so null or
    repeated ids, ties and extra columns change nothing, and an empty table gives an empty one. Long texts are
    measured whole.
    """
    scratch = Scratch(spark, "quality")
    rows = measured(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host}`").alias("host"), F.col("text")), rules)
    rows = scratch.write(rows.select("row.id", "row.host", "found.*"), "measures")
    verdicts = host_verdicts(_host_counts(rows), rules).withColumnRenamed("host", "of")
    out = rows.join(verdicts, rows["host"].eqNullSafe(verdicts["of"]), "left").drop("of")
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host_kept")
    return out.withColumnsRenamed({"id": id_col, "host": host})


def keep_good(spark: SparkSession, docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns.

    Texts are measured twice, once for the hosts' counts and once in passing, which is cheaper than moving
    them to a join by id. The cases of ``judge`` hold.
    """
    scratch = Scratch(spark, "quality")
    light = measured(docs.select(F.col(f"`{host}`").alias("host"), F.col("text")), rules).select("row.host", "found.base_failed")
    verdicts = scratch.write(host_verdicts(scratch.write(_host_counts(light), "counts"), rules), "verdicts")
    rows = measured(docs, rules).filter("not found.base_failed").select("row")
    bad = verdicts.filter(~F.col("host_kept")).select("host")
    kept = rows.join(bad, F.col("row").getField(host).eqNullSafe(bad["host"]), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
