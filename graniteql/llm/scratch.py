"""Tables between the steps of a job, in the folder that driver and executors share.

A written table cuts the lineage: a lost executor costs the rerun of single tasks, and values that depend on
how rows were dealt (partition numbers, offsets) are frozen once written.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs in this one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="graniteql-"))


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; only a leftover remains
        pass


def free(spark: SparkSession) -> None:
    """Spark deletes a finished step's shuffle files once the driver's garbage is collected; asking for that between
    steps keeps those of one step on the disks at a time."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Written tables of one call. ``drop`` frees those no longer read; the rest go when the process ends.

    Texts go to Python in batches; where the session hasn't set their size, 8 MB are the most, as several copies of a
    batch exist at a time and executors may be small.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        if spark.conf.get(_BATCH, None) is None:
            spark.conf.set(_BATCH, str(8 << 20))
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.root)

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of as many rows as the driver holds already, for a broadcast: a row per partition or so."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def number_rows(spark: SparkSession, df: DataFrame, order: list[Column], name: str, scratch: Scratch, first: int = 0, deal: list[Column] | None = None) -> DataFrame:
    """Adds a gapless global row number in the given order: two passes, no single-task window.

    Pass one sorts by range and writes each row with its partition and place there; pass two adds the rows
    of the partitions before. The driver sees one count per partition. Spark samples the keys that rows are dealt by,
    for which it runs ``df`` once more, so that should be a written table; and it sends some to the driver, so where
    ``order`` has long texts, ``deal`` has a beginning of each key instead.
    """
    n = partitions(spark)
    dealt = df.repartitionByRange(n, *(deal or order)).sortWithinPartitions(*order)
    low = (1 << 33) - 1
    dealt = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit(low)))
    dealt = scratch.write(dealt, f"{name}_ranges")
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("_part").count().collect())
    before, rows = first, []
    for part, count in counts:
        rows.append((part, before))
        before += count
    offsets = small(spark, rows, "_part int, _before long")
    return dealt.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_seq")).drop("_part", "_seq", "_before")


SLOT_BITS = 26
KEY_CHARS = 64


def _flagged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with ``_hit``: whether the hash slot of their rid is that of one of the ids. The slots travel as a bitmap
    of 2**26 bits, a table of 2**20 words at most, so its broadcast is bounded whatever the number of ids."""
    slot = F.pmod(F.xxhash64("rid"), F.lit(1 << SLOT_BITS))
    word, bit = F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")
    words = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))
    out = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(words), "_word", "left")
    hit = F.expr("coalesce(shiftright(_mask, _bit) & 1L, 0L) = 1L")
    return out.withColumn("_hit", hit).drop("_word", "_bit", "_mask")


def likely_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose rid is among the ids, and few others, without moving any. A join must follow."""
    return _flagged(rows, ids).filter("_hit").drop("_hit")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose rid isn't in ``gone``. Only those in a slot of ``gone`` are moved and joined; were all slots
    taken, all rows would be, with the same result."""
    flagged = _flagged(rows, gone)
    rest = flagged.filter("_hit").drop("_hit").join(gone, "rid", "left_anti")
    return flagged.filter(~F.col("_hit")).drop("_hit").unionByName(rest)


def with_ids(spark: SparkSession, docs: DataFrame, id_col: str, payload: list[str], scratch: Scratch) -> DataFrame:
    """The id, the payload columns and ``rid``, a unique non-null long in the ids' order (nulls last).

    Where ids are unique and whole already, rid is the id and nothing moves. Else rows are numbered by id, then
    payload; rows that agree in all of these are interchangeable.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), *payload)
    seen = docs.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("gap")).first()
    if (seen["most"] or 0) <= 1 and not seen["gap"]:
        return docs.withColumn("rid", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in payload)]
    deal = order[:1] + [F.substring(c, 1, KEY_CHARS).asc_nulls_first() for c in payload[:1] if docs.schema[c].dataType.typeName() == "string"]
    return number_rows(spark, docs, order, "rid", scratch, deal=deal)

