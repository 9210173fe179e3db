"""Incremental index building: new records of a stream are filed as postings, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from twinlake.operators.blocking import PROD, Profile, postings
from twinlake.sources.tables import prepare


def append_postings(records: DataFrame, path: str, checkpoint: str, profile: Profile = PROD) -> StreamingQuery:
    """File a stream of records (id, name, addr, country) under ``path``, a folder a batch.

    A batch that is tried again overwrites its own folder, so each record is filed once; the
    checkpoint remembers which files were read. Stops when all present input is filed.
    """

    def file(batch: DataFrame, number: int) -> None:
        postings(prepare(batch), profile.channels).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(file).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
