"""The page log as a stream: an upserted table of latest pages, and progress in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkgauge.sources.store import HISTORY, upsert

LOG = HISTORY + ", at timestamp"


def page_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines that runs append, as a stream."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(path)


def progress_windows(log: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """start, engine, pages, failures, ms: reads in tumbling windows; later than the watermark are dropped by Spark."""
    g = log.withWatermark("at", late).groupBy(F.window("at", window), "engine")
    return g.agg(F.count("*").alias("pages"), F.count_if(~F.col("ok")).alias("failures"), F.avg("ms").alias("ms")).select(F.col("window.start").alias("start"), "engine", "pages", "failures", "ms")


def keep_latest(log: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each (engine, page_id) in Parquet versions ``table``/v<batch>.

    A batch that is run again writes the same version again, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(LOG).parquet(f"{table}/v{number - 1}") if number else spark.createDataFrame([], LOG)
        upsert(old, batch, ["engine", "page_id"], "at").write.mode("overwrite").parquet(f"{table}/v{number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
