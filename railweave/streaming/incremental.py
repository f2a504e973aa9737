"""Batch operators over files that keep arriving.

The library's operators are batch ones.  Those that only look at a row (values packed in a field, names
matched to a list, texts encoded) or whose results add up (histograms per day) can run on new files as
they arrive: each micro-batch passes through the operator and its rows are appended, exactly once, to a
Parquet table, the checkpoint remembering the files already read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append_new_files(spark: SparkSession, source: str, schema: str, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, files_per_batch: int = 1000) -> int:
    """Runs ``operator`` on the Parquet files of ``source`` not read before; returns the micro-batches done.

    A batch is written under its own number, so one that is repeated after a failure replaces itself.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.append(number)

    running = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return len(done)
