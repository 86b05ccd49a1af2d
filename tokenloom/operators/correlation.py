"""Rank correlations over buckets of sorted rows, swept over bucket sizes in one plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import stats
from tokenloom.operators.bins import average_rank, correlation
from tokenloom.operators.ranks import largest, placed, written

#: Decimals of bucket means before ranking: means that are equal may differ in their last bit.
DECIMALS = 12


def buckets(df: DataFrame, keys: list[str], size, score: str = "score", metric: str = "metric", control: str = "loc", uid: str = "uid", complete: bool = True) -> DataFrame:
    """Rows of each group sorted by (metric, control, uid) and dealt to buckets of `size` (a number or a column).

    mean score, median metric and control, count; complete: without a last bucket that is not full.
    """
    size = F.lit(size) if isinstance(size, int) else size
    table = written(df.withColumn("__size", size).select(*dict.fromkeys([*keys, score, metric, control, uid, "__size"])))
    dealt = placed(table, keys, [metric, control, uid], "__n").withColumn("bucket", F.floor((F.col("__n") - 1) / F.col("__size")))
    out = dealt.groupBy(*keys, "bucket").agg(
        F.round(F.avg(score), DECIMALS).alias("mean_score"), F.round(F.median(metric), DECIMALS).alias("median_metric"),
        F.round(F.median(control), DECIMALS).alias("median_control"), F.count("*").cast("long").alias("n"), F.first("__size").alias("__size"),
    )
    return (out.where(F.col("n") >= F.col("__size")) if complete else out).drop("__size")


def bucket_correlation(b: DataFrame, keys: list[str], partial: bool = False) -> DataFrame:
    """(keys, groups, r) over bucket rows: Spearman, or partial Spearman controlling the third value.

    r is null with fewer than two buckets or a constant side; for the partial one with fewer than four, or where a
    ranked residual has no variation.
    """
    for x, name in (("median_metric", "__x"), ("mean_score", "__y"), ("median_control", "__z")):
        b = average_rank(b, keys, x, name)
    agg = b.groupBy(*keys).agg(
        F.count("*").cast("long").alias("groups"), correlation("__x", "__y").alias("xy"), correlation("__x", "__z").alias("xz"), correlation("__y", "__z").alias("yz")
    )
    if not partial:
        return agg.select(*keys, "groups", F.when(F.col("groups") >= 2, F.col("xy")).alias("r"))
    rest = (1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)
    r = F.when((F.col("groups") >= 4) & (rest > 1e-12), (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(rest))
    return agg.select(*keys, "groups", r.alias("r"))


def sweep(df: DataFrame, keys: list[str], score: str = "score", metric: str = "metric", control: str = "loc", uid: str = "uid", partial: bool = False) -> DataFrame:
    """r for each bucket size from n // 20 to n // 8 that leaves 9 to 11 full buckets: (keys, min_cnt, groups, r).

    The rows are written and ranked once, with running sums of the score. A bucket is its size and number: its mean score is the
    difference of two running sums, its median metric is looked up at its middle ranks. So the rows of the plan are
    those of df and a few for each bucket. For the partial correlation the control has no order to look its median up
    in, and each row is dealt to its bucket of every size.
    """
    table = written(df.select(*dict.fromkeys([*keys, score, metric, control, uid]), F.col(score).cast("decimal(30, 15)").alias("__exact")))
    ranked = placed(table, keys, [metric, control, uid], "__at", sums={"__sum": "__exact"}).select(*keys, score, metric, control, (F.col("__at") - 1).alias("__at"), "__sum")
    sizes = table.groupBy(*keys).agg(F.count("*").alias("__n"))
    low, high = F.greatest(F.lit(1), F.floor(F.col("__n") / 20)), F.greatest(F.lit(1), F.floor(F.col("__n") / 8))
    sizes = sizes.withColumn("min_cnt", F.explode(F.sequence(low.cast("long"), high.cast("long")))).withColumn("__full", F.floor(F.col("__n") / F.col("min_cnt")))
    sizes = sizes.where(F.col("__full").between(9, 11))
    if partial:
        many = ranked.join(sizes, keys).where(F.col("__at") < F.col("__full") * F.col("min_cnt"))
        dealt = many.groupBy(*keys, "min_cnt", F.floor(F.col("__at") / F.col("min_cnt")).alias("bucket")).agg(
            F.round(F.avg(score), DECIMALS).alias("mean_score"), F.round(F.median(metric), DECIMALS).alias("median_metric"), F.round(F.median(control), DECIMALS).alias("median_control")
        )
        return bucket_correlation(dealt, [*keys, "min_cnt"], True)
    size, first = F.col("min_cnt"), F.col("bucket") * F.col("min_cnt")
    marks = sizes.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full") - 1)))
    spot = lambda what, at: F.struct(F.lit(what).alias("what"), at.cast("long").alias("__at"))
    spots = F.array(spot("before", first - 1), spot("last", first + size - 1), spot("middle", first + F.floor((size - 1) / 2)), spot("middle", first + F.floor(size / 2)))
    marks = marks.select(*keys, "min_cnt", "bucket", F.explode(spots).alias("s")).select(*keys, "min_cnt", "bucket", "s.*")
    found = marks.join(ranked.select(*keys, "__at", "__sum", F.col(metric).alias("__m")), [*keys, "__at"])
    at = lambda what, c: F.when(F.col("what") == what, F.col(c))
    total = F.max(at("last", "__sum")) - F.coalesce(F.max(at("before", "__sum")), F.lit(0))
    dealt = found.groupBy(*keys, "min_cnt", "bucket").agg(
        F.round(total.cast("double") / F.first("min_cnt"), DECIMALS).alias("mean_score"), F.round(F.avg(at("middle", "__m")), DECIMALS).alias("median_metric"), F.lit(0.0).alias("median_control")
    )
    return bucket_correlation(dealt, [*keys, "min_cnt"])


def strongest(swept: DataFrame, keys: list[str]) -> DataFrame:
    """The row of greatest |r|, the smallest bucket size among equals."""
    order = Window.partitionBy(*keys).orderBy(F.abs(F.round("r", 10)).desc_nulls_last(), "min_cnt")
    return swept.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def with_p(df: DataFrame, covariates: int = 0, r: str = "r", n: str = "groups") -> DataFrame:
    """Two-sided p of r with n - 2 degrees of freedom, one less for each covariate."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([stats.correlation_p(None if pd.isna(a) else float(a), int(b) - 2 - covariates) for a, b in zip(rs, ns, strict=True)], dtype="float64")

    return df.withColumn("p", p(r, n))


def by_metric(df: DataFrame, keys: list[str], metrics: list[str], least: int = 10, score: str = "score", control: str = "loc", uid: str = "uid") -> DataFrame:
    """Strongest bucket correlation of every group and metric with enough rows, as one job over unpivoted metrics."""
    rows = df.unpivot([*keys, uid, score, control], metrics, "metric_name", "metric").where(F.col("metric").isNotNull() & F.col(score).isNotNull() & F.col(control).isNotNull())
    size = F.count("*").over(Window.partitionBy(*keys, "metric_name"))
    rows = rows.withColumn("__rows", size).where(F.col("__rows") >= least).drop("__rows")
    if control in metrics:
        rows = rows.withColumnRenamed(control, "loc")
    return strongest(sweep(rows, [*keys, "metric_name"], score, "metric", control, uid), [*keys, "metric_name"])


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, r) of average ranks over rows that have both; null for fewer than two rows or a constant side."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    table = written(both.select(*dict.fromkeys([*keys, x, y])))
    size = largest(table, keys)
    ranked = placed(placed(table, keys, [x], mean="__x", size=size), keys, [y], mean="__y", size=size)
    return ranked.groupBy(*keys).agg(F.count("*").cast("long").alias("n"), correlation("__x", "__y").alias("r"))
