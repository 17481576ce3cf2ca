"""Incremental postings: every micro-batch of new documents adds one sorted file set to the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexigrain.operators.fulltext import postings_of


def index_stream(docs: DataFrame, path: str, checkpoint: str, id_col: str = "id", text_col: str = "title") -> StreamingQuery:
    """Append postings of a stream below ``path``/postings/batch=<n>; a batch that is run again replaces its own files.

    Processes what is there and stops, so it can be scheduled; searches read all batches.
    """

    def add(batch: DataFrame, number: int) -> None:
        postings_of(batch, id_col, text_col).sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
