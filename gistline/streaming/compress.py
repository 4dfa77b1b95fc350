"""Compression of documents as they arrive. The plan is the batch plan, run on each micro-batch; a batch that is run again
after a failure replaces its own output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.compress import Options, compress_all


def compress_stream(docs: DataFrame, o: Options, out: str, checkpoint: str, query: str | None = None, **trigger) -> StreamingQuery:
    """Writes Parquet folders out/batch=N. docs: a streaming DataFrame (doc_id, text, ...)."""

    def each(batch: DataFrame, n: int) -> None:
        compress_all(batch, o, query).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
