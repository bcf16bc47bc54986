"""Nightly calendar files as a stream, loaded month by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nightledger.operators.incremental import NIGHT, upsert_nights
from nightledger.operators.ranking import first_per_key
from nightledger.operators.refresh import CalendarStore


def read_arrivals(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("arrived", F.col("_metadata.file_modification_time"))


def load_arrivals(
    arrivals: DataFrame, target: str, progress: str, order: str = "arrived"
) -> StreamingQuery:
    """Upsert every batch; a batch that runs twice after a failure gives the same table.

    Within a batch the newest row of a (listing, date) wins.
    """

    def load(batch: DataFrame, _batch_id: int) -> None:
        newest = first_per_key(batch, NIGHT, [F.desc(order)]).drop(order)
        by_month = newest.withColumn("year_month", F.date_format("calendar_date", "yyyy-MM"))
        upsert_nights(batch.sparkSession, target, by_month)

    return (
        arrivals.writeStream.foreachBatch(load)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def deliver_arrivals(
    arrivals: DataFrame, store: CalendarStore, progress: str, order: str = "arrived"
) -> StreamingQuery:
    """Deliver every batch to a store, whose sums follow; a batch that runs twice counts once.

    Batches are known by the name of ``progress`` and their number. Within a batch the newest
    row of a (listing, date) wins.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        newest = first_per_key(batch, NIGHT, [F.desc(order)]).drop(order)
        store.deliver(newest, f"{progress}#{batch_id}")

    return (
        arrivals.writeStream.foreachBatch(load)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
