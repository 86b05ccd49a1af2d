"""Joins with their checks: scores, ids, audits, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import base_id, first_number


def scored(summary: DataFrame, scores: DataFrame) -> DataFrame:
    """Files with a score, by (dataset, uid)."""
    return summary.join(scores, ["dataset", "uid"])


def scored_legacy(summary: DataFrame, scores: DataFrame, order: str = "ord") -> DataFrame:
    """The older join: ids cut at __ on both sides, the last score of an id stands."""
    last = scores.groupBy("dataset", base_id(F.col("uid")).alias("__id")).agg(F.max_by("score", order).alias("score"))
    return summary.withColumn("__id", base_id(F.col("uid"))).join(last, ["dataset", "__id"]).drop("__id")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, with an error when it is read if a key is null or stands twice."""
    n = F.count("*").over(_window(keys))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    bad = F.when(missing | (n > 1), F.raise_error(F.lit("a key is missing or stands twice"))).otherwise(F.lit(True))
    return df.withColumn("__ok", bad.cast("boolean")).where("__ok").drop("__ok")


def _window(keys: list[str]):
    return Window.partitionBy(*keys)


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return assert_unique(a, keys).join(assert_unique(b, keys), keys)


def compare_frames(calculated: DataFrame, stored: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-9, atol: float = 1e-10) -> DataFrame:
    """Rows that stand on one side, or whose values differ beyond the tolerance; missing equals missing.

    (keys, side, column, calculated, stored) with side both, left_only or right_only.
    """
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    a = calculated.select(*keys, F.struct(*map(value, columns)).alias("a"))
    b = stored.select(*keys, F.struct(*map(value, columns)).alias("b"))
    joined = a.join(b, keys, "full_outer")
    side = F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").otherwise("both")
    each = joined.select(*keys, side.alias("side"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("calculated"), F.col(f"b.{c}").alias("stored")) for c in columns))).alias("v"))
    each = each.select(*keys, "side", "v.*")
    x, y = F.col("calculated"), F.col("stored")
    same = x.eqNullSafe(y) | (F.abs(x - y) <= atol + rtol * F.abs(y))
    return each.where((F.col("side") != "both") | ~F.coalesce(same, F.lit(False)))


def missing_and_extra(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Ids expected and not found (`missing`), found and not expected (`extra`)."""
    a, b = found.select(*keys).distinct(), expected.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("state", F.lit("missing")).unionByName(a.join(b, keys, "left_anti").withColumn("state", F.lit("extra")))


def selected(work: DataFrame, targets: list[str]) -> DataFrame:
    """Rows (uid, variant_id) that targets name, each `uid` or `uid:variant`. An id named alone takes all its variants,
    also where it stands with one too; without targets all rows stay."""
    if not targets:
        return work
    rows = sorted({(uid, variant or "") for uid, _, variant in (t.partition(":") for t in targets)})
    named = work.sparkSession.createDataFrame(rows, "__uid string, __variant string")
    return work.join(named, (F.col("uid").cast("string") == F.col("__uid")) & ((F.col("__variant") == "") | (F.col("variant_id") == F.col("__variant"))), "left_semi")


def first_missing(found: DataFrame, expected: DataFrame, n: int = 20) -> DataFrame:
    return expected.select("uid").distinct().join(found.select("uid"), "uid", "left_anti").orderBy("uid").limit(n)


def outcome_groups(df: DataFrame, metric: str, score: str = "score", share: float = 0.15) -> DataFrame:
    """Groups A (metric at least share of its maximum, score 0), B (at most, 0), C (at most, 1).

    A row at the border with score 0 is in A and in B.
    """
    limit = F.max(metric).over(_window(["dataset"])) * share
    marked = df.withColumn("__limit", limit)
    m, s = F.col(metric), F.col(score)
    groups = F.array(F.when((m >= F.col("__limit")) & (s == 0), "A"), F.when((m <= F.col("__limit")) & (s == 0), "B"), F.when((m <= F.col("__limit")) & (s == 1), "C"))
    return marked.withColumn("grp", F.explode(F.filter(groups, lambda g: g.isNotNull()))).drop("__limit")


def with_enough_rows(df: DataFrame, keys: list[str], least: int, required: list[str]) -> DataFrame:
    """Rows without nulls in the required columns, of groups that have enough of them."""
    return df.dropna(subset=required).withColumn("__n", F.count("*").over(_window(keys))).where(F.col("__n") >= least).drop("__n")


def matching_code(df: DataFrame, audit: DataFrame) -> DataFrame:
    """Files whose measured code is the scored one, as text or as a syntax tree."""
    return df.join(audit.where(F.col("match").isin("exact", "ast_equal")), ["dataset", "uid"], "left_semi")


def in_summary_order(df: DataFrame) -> DataFrame:
    return df.orderBy("dataset", first_number(F.col("uid")).asc_nulls_last(), "uid")
