"""Files that keep arriving, into a table of the store.

The dialect has no streaming operators; this is the store's own loading made continuous. Each micro-batch is one
transaction that also records its number, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import Engine


def ingest(engine: Engine, folder: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends new Parquet files of a folder to the table. once: what is there now, then stop."""
    spark = engine.spark
    columns = engine.session()._tables().table([table])["columns"]
    schema = ", ".join(f"`{c['name']}` {c['type']}" for c in columns)
    marker = f"ingest:{table.lower()}:{checkpoint}"

    def load(batch: DataFrame, number: int) -> None:
        with engine._store().begin() as t:
            # the marker is kept with the table, so that both are committed or neither
            entry = t.tables.table([table])
            seen = entry.setdefault("ingested", {})
            if seen.get(marker, -1) >= number:
                return
            t.tables.insert([table], batch)
            seen[marker] = number

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
