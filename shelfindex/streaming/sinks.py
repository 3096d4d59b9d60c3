"""Sinks that stay right when a micro-batch is run again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfindex.operators.ordered import latest_by


def run_available(
    stream: DataFrame,
    checkpoint: str,
    per_batch: Callable[[DataFrame, int], None],
    mode: str = "append",
) -> StreamingQuery:
    """Process all that is there in micro-batches, then stop; state lives in `checkpoint`."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(per_batch)
        .start()
    )
    query.awaitTermination()
    return query


class Versions:
    """Rows per key as Parquet, one folder per micro-batch.

    A batch overwrites only its own folder, so running it again changes nothing. Most batches
    write the keys they touched; every `every`-th writes all keys, which bounds how many
    folders a reader merges.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        keys: Sequence[str],
        order: str,
        every: int = 20,
    ):
        self.spark = spark
        self.root = root
        self.schema = schema
        self.keys = list(keys)
        self.order = order
        self.every = every

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/version={batch}")

    def before(self, batch: int) -> DataFrame:
        """The newest row per key among all batches before this one.

        A first batch beside later ones means that a new checkpoint met an old folder; its
        versions would mix with this stream's, so that is refused.
        """
        if batch == 0:
            if self._last() > 0:
                raise ValueError(f"{self.root} holds the versions of another checkpoint")
            return self.spark.createDataFrame([], self.schema)
        first = (batch - 1) // self.every * self.every
        return self._newest(F.col("version").between(first, batch - 1))

    def apply(self, newest: DataFrame, batch: int) -> None:
        """Record the newest row of every key a batch touched."""
        if batch % self.every == 0 and batch > 0:
            newest = latest_by(
                self.before(batch).unionByName(newest), self.keys, self.order, newest.columns
            ).select(*newest.columns)
        self.write(newest, batch)

    def current(self) -> DataFrame:
        """The newest row per key after the last batch written."""
        return self.before(self._last() + 1)

    def _last(self) -> int:
        """The last version written, or -1."""
        try:
            last = self._all().agg(F.max("version")).first()[0]
        except AnalysisException:  # no folder yet
            return -1
        return -1 if last is None else last

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, version int").parquet(self.root)

    def _newest(self, among) -> DataFrame:
        rows = self._all().filter(among).drop("version")
        return latest_by(rows, self.keys, self.order, rows.columns).select(*rows.columns)
