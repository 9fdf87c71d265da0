"""Responses as a stream: windowed counts with a watermark, and scores kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import scoring

#: Parts of the log by subject.
BUCKETS = 64


def windowed_counts(responses: DataFrame, window: str = "1 day", late: str = "3 days", time: str = "recorded_at") -> DataFrame:
    """Records of each subject in tumbling windows; rows later than the watermark are left out. Works on streams and tables."""
    rows = responses.withWatermark(time, late) if responses.isStreaming else responses
    return rows.groupBy(F.window(time, window).alias("w"), "subject").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "subject", "n")


def rescored(stream: DataFrame, criteria: DataFrame, log_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], method: str = "top_weighted", weights: tuple[float, ...] = (1.0,)) -> StreamingQuery:
    """Append each batch to the log and score again the subjects it names; sink gets their criterion scores.

    Batches are written under their id, so a batch that runs again replaces what it wrote, and in BUCKETS by subject, so that a
    batch reads again only the buckets of its subjects.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("subject"), F.lit(BUCKETS)).cast("int").alias("bucket")
        batch.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch={number}")
        own = spark.read.option("basePath", log_path).parquet(f"{log_path}/batch={number}") if not batch.isEmpty() else None
        if own is None:
            sink(scoring.criterion_scores(scoring.unit_best(scoring.long_records(batch, criteria)), method, weights), number)
            return
        buckets = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most BUCKETS
        log = spark.read.option("basePath", log_path).parquet(f"{log_path}/batch=*").where(F.col("bucket").isin(buckets)).select(*batch.columns)
        touched = own.select("subject").distinct()
        records = scoring.long_records(log.join(touched, "subject", "left_semi"), criteria)
        sink(scoring.criterion_scores(scoring.unit_best(records), method, weights), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
