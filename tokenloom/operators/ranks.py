"""Places, mean ranks and running sums within groups of any size: a distributed sort with offsets.

Rows are written once, dealt to ranges of (keys, order) whose cuts Spark samples; equal rows stay in one range. Counts
and sums by range give what comes before each range, and a window then orders a range alone. So one dataset with all
rows takes as many tasks as its share of the table. Groups that fit a task as they are take a plain window.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

#: Rows of a group that one task sorts at most; beyond it groups are dealt to ranges.
ONE_TASK = 4_000_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of written tables that driver and executors share: spark.checkpoint.dir, or a temporary one for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tokenloom-"))


def written(df: DataFrame) -> DataFrame:
    """df as a table, which cuts its lineage and is computed once, whoever reads it."""
    path = f"{shared_dir(df.sparkSession)}/tokenloom-ranks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def largest(table: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group of a written table."""
    return table.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0


def placed(table: DataFrame, keys: list[str], by: list[str], number: str | None = None, mean: str | None = None, sums: dict[str, str] | None = None, size: int | None = None) -> DataFrame:
    """A written table with, within keys and in the order of `by`: the row's number from 1, its rank with ties at their
    mean, and sums of columns up to and with the row.

    Nulls come first. Rows that are equal in `by` are numbered in any order. size: rows of the largest group, if known.
    """
    sums = sums or {}
    if (largest(table, keys) if size is None else size) <= ONE_TASK:
        return _within(table, keys, by, number, mean, sums)
    ranges = written(table.repartitionByRange(*keys, *by).withColumn("__part", F.spark_partition_id()))
    parts = ranges.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__of_{name}") for name, c in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select(
        *(F.col(k).alias(f"__key_{k}") for k in keys), F.col("__part").alias("__of_part"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        *(F.coalesce(F.sum(f"__of_{name}").over(earlier), F.lit(0)).alias(f"__of_{name}") for name in sums),
    )
    same = F.col("__part") == F.col("__of_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    out = _within(ranges.join(parts, same), [*keys, "__part"], by, number, mean, sums)
    for name in (number, mean):
        if name:
            out = out.withColumn(name, F.col(name) + F.col("__before"))
    kind = {f.name: f.dataType for f in out.schema.fields}
    narrow = lambda name: DecimalType(37, kind[name].scale) if isinstance(kind[name], DecimalType) else kind[name]
    for name in sums:  # decimals of 37 digits: wider ones would lose their last place in the sum
        both = [F.coalesce(c, F.lit(0)).cast(narrow(name)) for c in (name, f"__of_{name}")]
        out = out.withColumn(name, (both[0] + both[1]).cast(kind[name]))
    return out.drop("__part", "__of_part", "__before", *(f"__key_{k}" for k in keys), *(f"__of_{name}" for name in sums))


def _within(df: DataFrame, keys: list[str], by: list[str], number: str | None, mean: str | None, sums: dict[str, str]) -> DataFrame:
    order, tie = Window.partitionBy(*keys).orderBy(*by), Window.partitionBy(*keys, *by)
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    new = {}
    if number:
        new[number] = F.row_number().over(order).cast("long")
    if mean:
        new[mean] = F.rank().over(order) + (F.count("*").over(tie) - 1) / 2
    new |= {name: F.sum(c).over(up_to) for name, c in sums.items()}
    return df.withColumns(new)
