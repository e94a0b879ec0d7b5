"""An extension: landed transactions as a stream, each micro-batch appended by row key, so that a replay adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import VersionedTable, ingest


def refresh(table: VersionedTable, derived: VersionedTable, batch: DataFrame, make: Callable[[DataFrame], DataFrame], key: str = "account") -> None:
    """Bring what is derived from a ledger up to date after a batch: the batch's accounts alone, read and made anew whole.

    So a late statement redoes its own account's chain, gaps and months, and any order
    of batches ends in what all of them at once give. make: from ledger rows to rows with the
    column `key`, account by account.
    """
    touched = batch.select(key).distinct()
    buckets = [r[0] for r in touched.select(table.bucket(touched[key])).distinct().collect()] if table.buckets and table.bucket_by == key else None
    rows = table.read(buckets=buckets)
    named = touched.withColumnRenamed(key, "__touched")
    mine = rows.join(named, rows[key].eqNullSafe(named["__touched"]), "left_semi")
    derived.replace(make(mine), key, gone=touched)


def ingest_stream(rows: DataFrame, table: VersionedTable, order: list[str], checkpoint: str, available_now: bool = True, derived: list[tuple[VersionedTable, Callable[[DataFrame], DataFrame]]] = ()) -> StreamingQuery:
    """Start the stream; a batch that runs again finds its keys in the ledger, and makes the same of its accounts.

    derived: tables kept beside the ledger, each with what makes it of an account's rows (see refresh).
    """

    def add(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            ingest(table, batch, order)
            for out, make in derived:
                refresh(table, out, batch, make)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
