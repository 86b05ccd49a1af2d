"""Bins, percentiles and descriptive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.ranks import largest, placed, written


def frequency_table(df: DataFrame, keys: list[str], width: int, x: str = "num_semantic_units", y: str = "pass_at_1", z: str = "lm_cc", least_limit: int = 200) -> DataFrame:
    """Equal-width bins [a, b) from 0 with empty ones kept, so many that they hold the greater of the limit and the
    group's maximum.

    n, mean and sample deviation of y (null for n = 1), mean of z.
    """
    b = F.floor(F.col(x) / width)
    counted = df.where(F.col(x).isNotNull()).groupBy(*keys, b.alias("__b")).agg(
        F.count(y).cast("long").alias("n"), F.avg(y).alias(f"{y}_mean"), F.stddev_samp(y).alias(f"{y}_std"), F.avg(z).alias(f"{z}_mean")
    )
    limit = F.greatest(F.max(F.col(x).cast("double")), F.lit(float(least_limit))) + 1
    ranges = df.groupBy(*keys).agg(F.ceil(limit / width).alias("__n")) if keys else df.agg(F.ceil(limit / width).alias("__n"))
    every = ranges.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__b"))
    joined = every.join(counted, [*keys, "__b"], "left")
    return joined.select(
        *keys, (F.col("__b") * width).cast("long").alias("bin_start"), ((F.col("__b") + 1) * width).cast("long").alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), f"{y}_mean", f"{y}_std", f"{z}_mean",
    )


def with_total(df: DataFrame, by: str, name: str = "all") -> DataFrame:
    """Rows once under their group and once under the name for all: the frame of per-group and pooled tables."""
    return df.withColumn("scope", F.explode(F.array(F.lit(name), F.col(by))))


def bin_trend(df: DataFrame, keys: list[str], width: int, x: str = "num_semantic_units", y: str = "pass_at_1") -> DataFrame:
    """Middle, count and mean of y of each bin that has rows."""
    b = F.floor(F.col(x) / width)
    return df.groupBy(*keys, b.alias("__b")).agg(F.count(y).cast("long").alias("n"), F.avg(y).alias(f"{y}_mean")).where("n > 0").select(
        *keys, ((F.col("__b") + 0.5) * width).cast("double").alias("bin_mid"), "n", f"{y}_mean"
    )


def quantile_bins(df: DataFrame, keys: list[str], x: str, y: str, most: int = 10, rows: int = 5) -> DataFrame:
    """Bins by linear quantiles, (a, b] with the lowest included and equal edges merged: median of x, mean of y, n.

    A group gets the lesser of `most` and a `rows`-th of its rows as bins; groups too small for one have none.
    """
    size = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    q = F.least(F.lit(most), F.floor(F.count("*") / rows).cast("int"))
    # quantiles k/q for each q that can occur, in one aggregation: those of q start at (q - 1) * (q + 2) / 2
    grid = F.percentile(x, [k / n for n in range(1, most + 1) for k in range(n + 1)])
    edges = size.groupBy(*keys).agg(q.alias("q"), grid.alias("grid")).where("q >= 1")
    own = F.slice("grid", ((F.col("q") - 1) * (F.col("q") + 2) / 2 + 1).cast("int"), F.col("q") + 1)
    edges = edges.select(*keys, F.array_sort(F.array_distinct(own)).alias("edges"))
    joined = size.join(F.broadcast(edges), keys) if not keys else size.join(edges, keys)
    at = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(x))), F.lit(1)) - 1
    return joined.groupBy(*keys, at.alias("bin")).agg(F.median(x).alias(f"{x}_median"), F.avg(y).alias(f"{y}_mean"), F.count("*").cast("long").alias("n"))


#: Cells of the histogram by which pooled percentiles are found.
CELLS = 4096


def entropy_percentiles(tokens: DataFrame, x: str = "metric_entropy", extra: tuple[int, ...] = (67,)) -> DataFrame:
    """(percentile, value) of the pooled column at 0, 5, ... 95 and the extra ones, exact with linear interpolation.

    Values are counted and written, and their counts summed in cells of equal width; the cells' running sums tell in which a rank
    lies, and only those cells' values are put in order. One task holds the cells, at most CELLS, or one cell's values.
    """
    points = sorted({*range(0, 100, 5), *extra})
    v = F.col(x).cast("double")
    values = written(tokens.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count("*").alias("c")))
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    share = (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    placed = values.crossJoin(F.broadcast(ends)).withColumn("cell", F.coalesce(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)), F.lit(0)))  # one row
    upto = F.sum("c").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = placed.groupBy("cell", "n").agg(F.sum("c").alias("c")).select("cell", "n", (upto - F.col("c")).alias("before"), upto.alias("upto"))
    place = F.col("p") / 100.0 * (F.col("n") - 1)
    asked = cells.withColumn("p", F.explode(F.lit(points))).withColumn("rank", F.explode(F.array(F.floor(place), F.ceil(place))))
    asked = asked.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto"))).select("cell", "before", "n", "p", "rank").distinct()
    order = Window.partitionBy("cell").orderBy("v")
    within = placed.join(F.broadcast(asked.select("cell").distinct()), "cell").withColumn("last", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))  # two cells a percentile
    hit = within.select("cell", "v", "c", "last").join(F.broadcast(asked), "cell")
    at = F.col("rank") - F.col("before")
    hit = hit.where((F.col("last") - F.col("c") <= at) & (at < F.col("last")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    return hit.groupBy("p", "n").agg(low.alias("low"), high.alias("high")).select(
        F.col("p").cast("int").alias("percentile"), (F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))).alias("value")
    )


def tercile_cuts(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Thirds by linear quantiles that separate something (min <= cut < max), distinct, as the array `cuts`."""
    agg = df.groupBy(*keys).agg(F.percentile(x, [1 / 3, 2 / 3]).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return agg.select(*keys, F.array_distinct(F.filter("q", lambda c: (c >= F.col("lo")) & (c < F.col("hi")))).alias("cuts"))


def assign_intervals(df: DataFrame, cuts: DataFrame, keys: list[str], x: str, name: str = "interval") -> DataFrame:
    """The number of cuts below x: intervals closed on the right."""
    return df.join(cuts, keys).withColumn(name, F.size(F.filter("cuts", lambda c: c < F.col(x)))).drop("cuts")


def describe(df: DataFrame, keys: list[str], columns: list[str], score: str = "score", cluster: str = "cluster_id", pair: tuple[str, str] = ("su", "loc")) -> DataFrame:
    """Counts of rows, clusters and outcomes, rank correlation of a pair, and a summary of each column."""
    table = written(df.select(*dict.fromkeys([*keys, *columns, score, cluster, *pair])))
    size = largest(table, keys)
    ranked = placed(placed(table, keys, [pair[0]], mean="__ra", size=size), keys, [pair[1]], mean="__rb", size=size)
    stats = []
    for c in columns:
        stats += [F.min(c).cast("double").alias(f"{c}_min"), F.percentile(c, 0.25).alias(f"{c}_q25"), F.percentile(c, 0.5).alias(f"{c}_median"), F.percentile(c, 0.75).alias(f"{c}_q75"), F.max(c).cast("double").alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    s = F.col(score)
    return ranked.groupBy(*keys).agg(
        F.count("*").cast("long").alias("n"), F.count_distinct(cluster).cast("long").alias("clusters"), F.count_if(s < 1).cast("long").alias("with_error"),
        F.count_if(s == 1).cast("long").alias("all_correct"), F.count_if(s == 0).cast("long").alias("all_incorrect"), F.count_if((s > 0) & (s < 1)).cast("long").alias("mixed"),
        F.count_distinct(pair[0]).cast("long").alias(f"distinct_{pair[0]}"), F.count_distinct(pair[1]).cast("long").alias(f"distinct_{pair[1]}"), correlation("__ra", "__rb").alias("spearman"), *stats,
    )


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant, which corr() takes for a division by zero."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def average_rank(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """Ranks within keys from 1, ties at their mean, for groups that a task can sort; ranks.placed is for any."""
    order, tie = Window.partitionBy(*keys).orderBy(x), Window.partitionBy(*keys, x)
    return df.withColumn(name, F.rank().over(order) + (F.count("*").over(tie) - 1) / 2)
