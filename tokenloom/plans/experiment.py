"""Resumable staged work: a status table, gates between stages, condition keys, one distributed job per stage."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

STATUS = "stage string, key string, condition string, status string, detail string"
STAGES = ("transform", "behavior", "measure", "compare", "accuracy")


def condition_key(value) -> str:
    """16 hex digits of the SHA-256 of canonical JSON: the key of a condition's results."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


class Experiment:
    """Stages over keyed work with their status kept in an append-only table at root/status."""

    def __init__(self, spark: SparkSession, root: str, condition):
        self.spark, self.root, self.condition = spark, root.rstrip("/"), condition_key(condition)

    def status(self) -> DataFrame:
        """The latest status of each stage and key."""
        try:
            rows = self.spark.read.schema(STATUS + ", at long").parquet(f"{self.root}/status")
        except AnalysisException:
            return self.spark.createDataFrame([], STATUS)
        latest = rows.groupBy("stage", "key").agg(F.max_by(F.struct("condition", "status", "detail"), "at").alias("s"))
        return latest.select("stage", "key", "s.*")

    def pending(self, stage: str, work: DataFrame, retry_failed: bool = False) -> DataFrame:
        """Work (by key) without a result of this stage under this condition; failed work stays unless retried."""
        done = self.status().where((F.col("stage") == stage) & (F.col("condition") == self.condition))
        if retry_failed:
            done = done.where("status <> 'failed'")
        return work.join(done.select("key"), "key", "left_anti")

    def gated(self, work: DataFrame, after: str, allowed: tuple[str, ...] = ("ok",)) -> DataFrame:
        """Work whose earlier stage ended in an allowed status."""
        good = self.status().where((F.col("stage") == after) & F.col("status").isin(*allowed))
        return work.join(good.select("key"), "key", "left_semi")

    def run(self, stage: str, work: DataFrame, step: Callable[[DataFrame], DataFrame], retry_failed: bool = False) -> DataFrame:
        """Apply step to what is pending and record its rows' status. step gives key, status, detail and results.

        A bad item is a row with status failed; the stage goes on. Results are appended at root/<stage>.
        """
        todo = self.pending(stage, work, retry_failed)
        path = f"{self.root}/{stage}"
        at = (self.spark.sql("select unix_micros(current_timestamp()) t").first()["t"])
        out = step(todo).withColumns({"stage": F.lit(stage), "condition": F.lit(self.condition), "at": F.lit(at)})
        out.write.mode("append").parquet(path)
        new = self.spark.read.parquet(path).where(F.col("at") == at)
        new.select("stage", "key", "condition", "status", F.col("detail").cast("string").alias("detail"), "at").write.mode("append").parquet(f"{self.root}/status")
        return new

    def counts(self, expected: DataFrame) -> DataFrame:
        """(stage, status, n) of expected (stage, key): not_run without a row, stale under another condition."""
        joined = expected.join(self.status(), ["stage", "key"], "left")
        state = F.when(F.col("status").isNull(), "not_run").when(F.col("condition") != self.condition, "stale").otherwise(F.col("status"))
        return joined.groupBy("stage", state.alias("status")).agg(F.count("*").cast("long").alias("n"))
