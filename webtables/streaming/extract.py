"""Extraction on a stream of captured pages: the batch transforms, unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table_files(folder: str, name: str) -> str:
    """A table as a folder for ``stream_pages``, whether it is one file or a folder of files.

    A stream reads a lone file only by a pattern; this one has one match.
    """
    return f"{folder.rstrip('/')}/{{{name}}}"


def stream_pages(spark: SparkSession, folder: str, schema, file_glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """Captured pages as they land in a folder, or in the folders and files of a pattern; ``file_glob`` is about names of files."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_to_table(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Process what has arrived, add it to the table at ``path``, stop.

    ``checkpoint`` says which pages belong to which batch, the table's own log which files of which batches count.
    The same two paths again go on where the last run ended or was stopped: a batch that was written but not
    ended is found in the log and left out, one whose files are not in the log is written again, and
    files of the stopped attempt are not read. So each page is in the table once.
    """
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_extract(
    spark: SparkSession,
    folder: str,
    schema,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    file_glob: str = "*",
    files_per_batch: int = 1000,
) -> DataFrame:
    """Run the stream over ``folder`` to its end and return the table at ``path``; call it again for what came later."""
    stream = stream_pages(spark, folder, schema, file_glob, files_per_batch)
    run_to_table(stream, transform, path, checkpoint)
    return spark.read.schema(transform(stream).schema).parquet(path)
