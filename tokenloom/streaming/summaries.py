"""Summaries of token files as they arrive: a file stream whose batches replace the rows of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.operators.metrics import file_metrics
from tokenloom.operators.units import clean
from tokenloom.schema import TOKENS, conform


def token_stream(spark: SparkSession, root: str, files: int = 64) -> DataFrame:
    """New token files under root with dataset and uid from their paths."""
    rows = spark.readStream.schema(TOKENS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(root)
    path = F.col("_metadata.file_path")
    return rows.withColumns({"dataset": F.regexp_extract(path, "([^/]+)/[^/]+$", 1), "uid": F.regexp_extract(path, r"result_([^/]*)\.parquet$", 1)})


def summarise(tokens: DataFrame, out: str, checkpoint: str, thresholds: dict[str, float]) -> StreamingQuery:
    """Write per-file metrics of each batch to out/batch=<id>; a repeated batch overwrites its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        keys = ["dataset", "uid"]
        metrics = file_metrics(clean(conform(batch), keys), keys, thresholds)
        metrics.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return tokens.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each file."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in ("dataset", "uid", "batch")]
    return rows.groupBy("dataset", "uid").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("dataset", "uid", "r.*")


def trigger_rates(events: DataFrame, threshold: float, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tokens and triggers per window of a stream with a time column `ts`; late rows count within the watermark."""
    hot = F.coalesce(F.col("metric_entropy") >= threshold, F.lit(False))
    return events.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("n"), F.count_if(hot).alias("n_triggers"))
