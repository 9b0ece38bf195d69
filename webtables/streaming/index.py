"""Keep-first index over a stream of listing pages.

Each micro-batch adds its own de-duplicated rows as a delta of a ``VersionedTable``, under its batch number: a
replayed batch is left out, wherever the first attempt was stopped. A read merges one base with the deltas since by
the keep-first rule, which does not depend on the order of arrival; ``fold`` makes them the new base while readers and
the stream go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.operators.listing import first_of, place_key
from webtables.streaming.extract import stream_pages
from webtables.streaming.versions import Version, VersionedTable

BATCH = "_batch"


class IndexStream:
    """An index at ``path`` over ``stream``; the same paths again go on where the last run ended or was stopped.

    ``to_items``: page rows → ``page, pos, id, url, …``. ``fold_every``: fold after so many deltas.
    """

    def __init__(self, spark: SparkSession, stream: DataFrame, to_items: Callable[[DataFrame], DataFrame], path: str, checkpoint: str | None = None, fold_every: int | None = 16):
        self.spark, self.stream, self.to_items = spark, stream, to_items
        self.checkpoint, self.fold_every = checkpoint or f"{path.rstrip('/')}/checkpoint", fold_every
        self.items = to_items(stream).schema
        self.table_ = VersionedTable(spark, path, T.StructType([*self.items.fields, T.StructField(BATCH, T.LongType())]))

    @classmethod
    def over_pages(cls, spark: SparkSession, folder: str, file_glob: str, to_items, path: str, checkpoint: str | None = None, files_per_batch: int = 1000, **more) -> "IndexStream":
        schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
        return cls(spark, stream_pages(spark, folder, schema, file_glob, files_per_batch), to_items, path, checkpoint, **more)

    def _merge_batch(self, batch: DataFrame, batch_id: int) -> None:
        # One row for each key and place of the batch, so that place and batch name a row of the table.
        keyed = place_key(self.to_items(batch))
        rest = [c for c in keyed.columns if c != "_key"]
        first = keyed.groupBy("_key").agg(F.min_by(F.struct(*rest), F.struct("page", "pos")).alias("_row")).select("_row.*")
        self.table_.append(first.withColumn(BATCH, F.lit(batch_id).cast("long")), batch_id)
        if self.fold_every and len(self.table_.version().deltas) >= self.fold_every:
            self.fold()

    def run(self) -> DataFrame:
        """Take in what has arrived, and return the index as of then."""
        query = (
            self.stream.writeStream.foreachBatch(self._merge_batch)
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.table()

    def _merge(self, rows: DataFrame) -> DataFrame:
        return first_of(place_key(rows), ["_key"], ["page", "pos", BATCH]).drop("_key")

    def table(self, version: Version | None = None) -> DataFrame:
        """The index, as of a version: the newest by default, and it stays that one while others are made."""
        return self._merge(self.table_.read(version)).drop(BATCH)

    def fold(self) -> bool:
        return self.table_.fold(self._merge)
