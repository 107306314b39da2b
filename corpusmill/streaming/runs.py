"""Run events as a stream of JSON files: one file for each batch that a logger writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import telemetry

EVENTS = "exp string, run_id string, step long, t double, metrics map<string,double>"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def latest_stream(events: DataFrame) -> DataFrame:
    """The current value of each run and metric, as telemetry.run_latest; its state is one row for each of these."""
    return telemetry.run_latest(telemetry.run_series(events))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, through the stream; its latest complete result is kept at path.

    Each micro-batch writes a folder of its own number, so that a repeated one replaces itself.
    """
    spark, schema = stream.sparkSession, stream.schema
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.append(number)

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/batch={max(done)}") if done else spark.createDataFrame([], schema)


def append_events(events: DataFrame, path: str) -> None:
    """Adds a batch as files of its own, which a stream notices; appended lines it wouldn't."""
    events.select("exp", "run_id", "step", "t", F.col("metrics")).write.mode("append").json(path)
