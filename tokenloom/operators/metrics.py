"""Per-file metrics of token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.units import segments, trigger


def with_gap(tokens: DataFrame) -> DataFrame:
    """surprisal_gap: isolated less full surprisal, null where either is missing."""
    if "metric_isolated_surprisal" not in tokens.columns:
        return tokens.withColumn("surprisal_gap", F.lit(None).cast("double"))
    return tokens.withColumn("surprisal_gap", F.col("metric_isolated_surprisal") - F.col("metric_surprisal"))


def first_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, function_id, first_token_surprisal) of the tokens that start functions."""
    return tokens.where("is_function_start").select(*keys, "function_id", F.col("metric_surprisal").alias("first_token_surprisal"))


def density(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """lm_cc_density: per function name, entropy of statement starts times depth plus one; the mean over names, else 0."""
    starts = tokens.where("is_statement_start and function_id is not null")
    weight = (1 + F.coalesce("nesting_depth", F.lit(0))) * F.col("metric_entropy")
    per = starts.groupBy(*keys, "function_id").agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("total"))
    mean = per.groupBy(*keys).agg(F.avg("total").alias("lm_cc_density"))
    return tokens.select(*keys).distinct().join(mean, keys, "left").withColumn("lm_cc_density", F.coalesce("lm_cc_density", F.lit(0.0)))


def file_metrics(tokens: DataFrame, keys: list[str], thresholds: dict[str, float]) -> DataFrame:
    """All per-file metrics and the unit count of each threshold, from cleaned tokens.

    One chain of aggregations, by line and function, by line and by file, over one pass of the tokens. The density, a mean over functions
    of sums, is the sum over all of them by their number; a line tells the functions whose statements start in it.
    Columns: ppl, loc, total_tokens, num_functions, avg_first_token_surprisal, avg_context_surprisal_gap,
    lm_cc_density, num_semantic_units_<label>.
    """
    t = with_gap(tokens if "seg" in tokens.columns else segments(tokens, keys))
    inside = F.col("is_statement_start") & F.col("function_id").isNotNull()
    weight = F.when(inside, (1 + F.coalesce("nesting_depth", F.lit(0))) * F.col("metric_entropy"))
    first = F.when(F.col("is_function_start"), F.col("metric_surprisal"))
    parts = t.groupBy(*keys, "seg", "function_id").agg(
        F.sum("metric_surprisal").alias("s"), F.count("metric_surprisal").alias("ns"), F.count("*").alias("n"), F.max("line").alias("line"),
        F.count_if("is_function_start").alias("nf"), F.sum(first).alias("sf"), F.count(first).alias("nsf"), F.sum("surprisal_gap").alias("g"), F.count("surprisal_gap").alias("ng"),
        F.bool_or(inside).alias("has"), F.sum(weight).alias("w"), *(F.bool_or(trigger(x)).alias(f"b_{k}") for k, x in thresholds.items()),
    )
    lines = parts.groupBy(*keys, "seg").agg(
        *(F.sum(c).alias(c) for c in ("s", "ns", "n", "nf", "sf", "nsf", "g", "ng", "w")), F.max("line").alias("line"),
        F.collect_list(F.when(F.col("has"), F.col("function_id"))).alias("names"), *(F.bool_or(f"b_{k}").alias(f"b_{k}") for k in thresholds),
    )
    functions = F.size(F.array_distinct(F.flatten(F.collect_list("names"))))
    return lines.groupBy(*keys).agg(
        F.exp(F.sum("s") / F.nullif(F.sum("ns"), F.lit(0))).alias("ppl"), F.coalesce(F.max("line"), F.lit(0)).cast("long").alias("loc"), F.sum("n").alias("total_tokens"), F.sum("nf").alias("num_functions"),
        (F.sum("sf") / F.nullif(F.sum("nsf"), F.lit(0))).alias("avg_first_token_surprisal"), (F.sum("g") / F.nullif(F.sum("ng"), F.lit(0))).alias("avg_context_surprisal_gap"),
        F.coalesce(F.sum("w") / F.nullif(functions, F.lit(0)), F.lit(0.0)).alias("lm_cc_density"),
        *((F.count_if(f"b_{k}") + 1).cast("long").alias(f"num_semantic_units_{k}") for k in thresholds),
    )


def check_metrics(tokens: DataFrame, keys: list[str], allow_leading: bool = False, order: str = "pos") -> DataFrame:
    """One row per file and metric: n, missing, not_finite, and the problem, null where there is none.

    Entropy may not be missing at all; of surprisal the first token's may be, if allow_leading. problem: all missing,
    missing, or not finite, the first that holds; a metric that is missing everywhere is always one.
    """
    first = F.col(order) == F.min(order).over(Window.partitionBy(*keys)) if allow_leading else F.lit(False)
    parts = []
    for metric, excused in (("metric_entropy", F.lit(False)), ("metric_surprisal", F.col("__first"))):
        v = F.col(metric).cast("double")
        gone, wild = v.isNull() | F.isnan(v), F.coalesce(F.abs(v) == float("inf"), F.lit(False))
        parts.append(F.struct(F.lit(metric).alias("metric"), gone.alias("gone"), (gone & ~excused).alias("bad"), wild.alias("wild")))
    each = tokens.withColumn("__first", first).select(*keys, F.explode(F.array(*parts)).alias("m")).select(*keys, "m.*")
    agg = each.groupBy(*keys, "metric").agg(F.count("*").cast("long").alias("n"), F.count_if("gone").cast("long").alias("missing"), F.count_if("wild").cast("long").alias("not_finite"), F.count_if("bad").alias("bad"))
    problem = F.when(F.col("missing") == F.col("n"), "all missing").when(F.col("bad") > 0, "missing").when(F.col("not_finite") > 0, "not finite")
    return agg.withColumn("problem", problem).drop("bad")


def tree_metrics(nodes: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """lm_cc and the shape of block trees given as node rows (node_id, parent_id, depth from 1).

    weight: a column of nodes' weights, which the width of a level sums; a node without one, and every node by default, counts 1.

    lm_cc = (1 - 0.8) * sum of depths + 0.8 * (nodes - 1).
    """
    alpha = 0.8
    width = nodes.groupBy(*keys, "depth").agg((F.count("*") if weight is None else F.sum(F.coalesce(weight, F.lit(1)))).alias("at_depth"))
    width = width.groupBy(*keys).agg(F.max("at_depth").alias("max_width"))
    per = nodes.groupBy(*keys).agg(
        F.count("*").cast("long").alias("nodes"), F.sum("depth").cast("long").alias("depth_sum"), (F.sum("depth") * (1 - alpha) + (F.count("*") - 1) * alpha).alias("lm_cc"),
        F.max("depth").cast("long").alias("max_depth"), F.avg("depth").alias("avg_depth"),
        F.coalesce(F.count("parent_id") / F.nullif(F.count_distinct("parent_id"), F.lit(0)), F.lit(0.0)).alias("avg_children"),
    )
    return per.join(width, keys)
