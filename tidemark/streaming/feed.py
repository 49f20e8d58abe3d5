"""Change feeds: the log of a managed table, in batch and as a stream.

A table's version rows are its change feed. In batch the previous image of each version comes from a window over the
log. As a stream the data folder is a file source; rows of transactions that never committed are dropped against the
log, and previous images come from keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.write import changes
from ..sources.store import Database

VIEWS = ("keys_only", "new_image", "old_image", "new_and_old_images")


def feed(db: Database, table: str, view: str = "new_and_old_images", after: int = 0) -> DataFrame:
    """All changes after a transaction, with images as JSON text."""
    keys = db.entry(table).schema.keys
    log = db.versions(table).withColumn("doc", F.to_json("doc"))
    found = changes(log, keys, view).where(F.col("_txn") > after)
    for image in ("new_image", "old_image"):
        if image in found.columns:
            found = found.withColumn(image, F.col(f"{image}.doc"))
    return found


def stream(db: Database, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """Version rows as a streaming DataFrame, documents as JSON text."""
    schema = db.row_type(db.entry(table).schema)
    reader = db.spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(db.files.uri(f"{table}/data")).withColumn("doc", F.to_json("doc"))


def committed(db: Database, batch: DataFrame, table: str) -> DataFrame:
    """The rows of a micro-batch whose transactions are in the log."""
    numbers = sorted({e["txn"] for e in db._log() if table in e["tables"]})
    known = db.spark.createDataFrame([(n,) for n in numbers], "_txn long")
    return batch.join(F.broadcast(known) if len(numbers) <= 100_000 else known, "_txn", "left_semi")


def with_images(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Streaming changes with kind and both images; state holds each key's last document."""
    kinds = [(k, rows.schema[k].dataType) for k in keys]
    out = T.StructType([*[T.StructField(k, t) for k, t in kinds], T.StructField("_txn", T.LongType()), T.StructField("event", T.StringType()), T.StructField("new_image", T.StringType()), T.StructField("old_image", T.StringType())])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        rows_ = pd.concat(list(parts)).sort_values(["_txn", "_seq"])
        found = []
        for txn, op, doc in zip(rows_["_txn"], rows_["_op"], rows_["doc"], strict=True):
            new = doc if op == "put" else None
            if new is not None or old is not None:
                found.append((*key, txn, "REMOVE" if new is None else "INSERT" if old is None else "MODIFY", new, old))
            old = new
        state.update((old,))
        yield pd.DataFrame(found, columns=[f.name for f in out.fields])

    return rows.groupBy(*[F.col(f"`{k}`") for k in keys]).applyInPandasWithState(step, out, T.StructType([T.StructField("doc", T.StringType())]), "append", GroupStateTimeout.NoTimeout)


def follow(db: Database, table: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Starts a query that hands every micro-batch of committed version rows to ``sink(batch, id)``."""
    writer = stream(db, table).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: sink(committed(db, batch, table), i))
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, at: str, size: str = "1 hour", late: str = "10 minutes", *by: str) -> DataFrame:
    """Counts per time window and group of a stream or a table, accepting rows up to ``late`` behind the newest."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.groupBy(F.window(F.col(at), size), *[F.col(f"`{b}`") for b in by]).agg(F.count("*").alias("n"))
