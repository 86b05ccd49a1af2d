"""Semantic units: lines that hold a token of high entropy begin a new unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import has_newline
from tokenloom.schema import known


def clean(tokens: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """Rows with a surprisal (all of them where the column is absent), with pos counted anew."""
    if "metric_surprisal" in tokens.columns:
        tokens = tokens.where(known(F.col("metric_surprisal").cast("double")).isNotNull())
    return tokens.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def segments(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """seg: tokens holding a newline strictly before this one."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("seg", F.coalesce(F.sum(has_newline(F.col("token_str")).cast("long")).over(before), F.lit(0)).cast("long"))


def trigger(threshold) -> F.Column:
    """Whether a token that isn't its file's first reaches the threshold; a missing entropy does not."""
    return (F.col("pos") > 0) & F.coalesce(known(F.col("metric_entropy")) >= threshold, F.lit(False))


def triggers(tokens: DataFrame, threshold, name: str = "trigger") -> DataFrame:
    return tokens.withColumn(name, trigger(threshold))


def unit_counts(tokens: DataFrame, keys: list[str], thresholds: dict[str, float], loc: bool = False) -> DataFrame:
    """keys and a column num_semantic_units_<label> per threshold: one, and one more for each line with a trigger.

    All thresholds are counted in one pass: partial sums by line, then by file; a line's greatest entropy tells which
    thresholds it reaches. loc: with the greatest line of each file.
    """
    seg = tokens if "seg" in tokens.columns else segments(tokens, keys)
    top = F.max(F.when(F.col("pos") > 0, known(F.col("metric_entropy")))).alias("__top")
    lines = seg.groupBy(*keys, "seg").agg(top, *([F.max("line").alias("loc")] if loc else []))
    counts = [(F.count_if(F.col("__top") >= t) + 1).cast("long").alias(f"num_semantic_units_{k}") for k, t in thresholds.items()]
    return lines.groupBy(*keys).agg(*counts, *([F.max("loc").alias("loc")] if loc else []))


def unit_of_token(tokens: DataFrame, keys: list[str], threshold) -> DataFrame:
    """trigger, boundary (its line has a trigger) and su (boundary lines up to its own) of each token."""
    seg = tokens if "seg" in tokens.columns else segments(tokens, keys)
    marked = triggers(seg, threshold)
    line = Window.partitionBy(*keys, "seg")
    marked = marked.withColumn("boundary", F.max("trigger").over(line))
    first = (F.row_number().over(line.orderBy("pos")) == 1) & F.col("boundary")
    marked = marked.withColumn("__first", first.cast("long"))
    running = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("su", F.sum("__first").over(running).cast("long")).drop("__first")


def boundary_lines(tokens: DataFrame, keys: list[str], by: list[str], thresholds: dict[str, float], aggregates: list[Column]) -> DataFrame:
    """Tokens aggregated by line (segment and the columns `by`), with su_<label>: the unit of the line.

    A line is summed up where its tokens stand; what is dealt by file and numbered are lines.
    """
    seg = tokens if "seg" in tokens.columns else segments(tokens, keys)
    lines = seg.groupBy(*keys, "seg", *by).agg(*aggregates, F.min("pos").alias("first_pos"), *(F.bool_or(trigger(t)).alias(f"hot_{k}") for k, t in thresholds.items()))
    line, file = Window.partitionBy(*keys, "seg"), Window.partitionBy(*keys)
    for k in thresholds:
        first = (F.col("first_pos") == F.min("first_pos").over(line)) & F.max(f"hot_{k}").over(line)
        lines = lines.withColumn(f"su_{k}", F.sum(first.cast("long")).over(file.orderBy("first_pos").rowsBetween(Window.unboundedPreceding, 0)))
    return lines


def unit_rows(tokens: DataFrame, keys: list[str], threshold) -> DataFrame:
    """One row per unit: lines, tokens and the triggers within it. A boundary on the first line leaves unit 0 empty.

    n_triggers is counted beside the list: where the list is not asked for, lines are added up as numbers alone.
    """
    hit = F.when(trigger(threshold), F.struct("pos", "token_str", F.col("metric_entropy").alias("entropy")))
    lines = boundary_lines(tokens, keys, [], {"u": threshold}, [
        F.min("line").alias("low"), F.max("line").alias("high"), F.max("pos").alias("last_pos"), F.count("*").alias("n"), F.count(hit).alias("n_hits"), F.array_sort(F.collect_list(hit)).alias("hits"),
    ])
    # where the first line of a file begins unit 1, an empty row stands for unit 0
    empty = (F.col("su_u") == 1) & (F.col("first_pos") == F.min("first_pos").over(Window.partitionBy(*keys)))
    own = F.struct(F.col("su_u").alias("su"), F.lit(True).alias("full"))
    none = F.struct(F.lit(0).cast("long").alias("su"), F.lit(False).alias("full"))
    lines = lines.withColumn("empty", empty)
    rows = lines.withColumn("of", F.explode(F.when(F.col("empty"), F.array(none, own)).otherwise(F.array(own))))
    full = lambda c: F.when(F.col("of.full"), F.col(c))
    return rows.groupBy(*keys, F.col("of.su").alias("su")).agg(
        F.min(full("low")).alias("start_line"), F.max(full("high")).alias("end_line"), F.min(full("first_pos")).alias("start_token"), F.max(full("last_pos")).alias("end_token"),
        F.coalesce(F.sum(full("n")), F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce(F.sum(full("n_hits")), F.lit(0)).cast("long").alias("n_triggers"), F.array_sort(F.flatten(F.collect_list(full("hits")))).alias("triggers"),
    )
