"""Running contractions: rows that arrive as a stream are added to a stored Gram matrix batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matrix import gram_of_rows


def running_gram(rows: DataFrame, values: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps each batch's share of X^T X under path/batch=N; a batch that is run again replaces its share."""

    def add(batch: DataFrame, number: int) -> None:
        gram_of_rows(batch, values).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_gram(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("i", "j").agg(F.sum("v").alias("v"))
