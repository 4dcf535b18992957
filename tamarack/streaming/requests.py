"""The retrieval pipelines over a stream of requests, against a static catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tamarack.plans import pipeline
from tamarack.sources.catalog import Catalog


def answer_stream(requests: DataFrame, catalog: Catalog, path: str, dictionary: DataFrame | None = None, answer: Callable[..., DataFrame] = pipeline.run, **options) -> DataStreamWriter:
    """A writer of what ``answer`` (pipeline.run or run_checked) gives for each micro-batch of requests to the Parquet table path.

    A micro-batch is a table of requests, planned and searched as one. It goes to a partition of its
    own, by its number, which a batch that runs again replaces, so each request is answered once.
    Set the writer's checkpoint and trigger, and start it.
    """

    def write(batch: DataFrame, number: int) -> None:
        answer(batch, catalog, dictionary, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(write)
