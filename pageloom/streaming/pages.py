"""A feed of pages: the stages are stateless by page, so each micro-batch is a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_feed(feed: DataFrame, chain: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run the chain over each micro-batch of a streaming feed; results go to Parquet, a folder for each batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        chain(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
