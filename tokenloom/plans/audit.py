"""Frozen inputs of an analysis, re-verification of stored tables, and the audit of saved joins and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tokenloom.functions.text import recovered_count
from tokenloom.operators import bins, code, joins
from tokenloom.plans.experiment import condition_key

#: Whether a measured and a scored code may stand for each other.
SAME_CODE = ("exact", "ast_equal")


def frames_report(calculated: DataFrame, stored: DataFrame, keys: list[str], rtol: float = 1e-9, atol: float = 1e-10) -> DataFrame:
    """One row per number column that both tables have: rows of each, keys that stand on one side alone, rows of both
    that differ beyond the tolerance, and the greatest difference. Missing equals missing. Keys must be unique."""
    numbers = lambda df: {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keys}
    columns = sorted(numbers(calculated) & numbers(stored))
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    a, b = (joins.assert_unique(df.select(*keys, F.struct(*map(value, columns)).alias(name)), keys) for df, name in ((calculated, "a"), (stored, "b")))
    each = a.join(b, keys, "full_outer").select("a", "b", F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("x"), F.col(f"b.{c}").alias("y")) for c in columns
    ))).alias("v")).select("a", "b", "v.*")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    gap = F.abs(F.col("x") - F.col("y"))
    same = F.coalesce(F.col("x").eqNullSafe(F.col("y")) | (gap <= atol + rtol * F.abs("y")), F.lit(False))
    return each.groupBy("column").agg(
        F.count("a").cast("long").alias("calculated_rows"), F.count("b").cast("long").alias("stored_rows"), F.count_if(~both).cast("long").alias("unmatched_keys"),
        F.count_if(both & ~same).cast("long").alias("different_rows"), F.max(gap).alias("max_difference"),
    )


def verify(tables: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """frames_report of each (recalculated, stored, keys) by name, and whether all of it agrees."""
    out = None
    for name, (calculated, stored, keys) in tables.items():
        r = frames_report(calculated, stored, keys).withColumn("table", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out.withColumn("agrees", (F.col("unmatched_keys") == 0) & (F.col("different_rows") == 0))


def trial_counts(trials: DataFrame) -> DataFrame:
    """(dataset, uid, k, n) of saved verdicts (dataset, uid, trial, correct); a trial that stands twice is an error."""
    once = joins.assert_unique(trials, ["dataset", "uid", "trial"])
    return once.groupBy("dataset", "uid").agg(F.count_if("correct").cast("long").alias("k"), F.count("*").cast("long").alias("n"))


def prepare(metrics: DataFrame, scores: DataFrame, counts: DataFrame, codes: DataFrame, clusters: DataFrame, thresholds: dict[str, float]) -> dict:
    """The frozen input of a regression and what was left out of it.

    metrics: dataset, uid, loc and num_semantic_units_<label>; scores: dataset, uid, score; counts: dataset, uid, n and,
    where verdicts were saved, k (else it is recovered from the score, an error where that is no k/n); codes: dataset,
    uid, measured_code, scored_code; clusters: dataset, uid, cluster_id.

    input: a row per threshold and file with k, n, y, su, logloc, cluster_id and interval (thirds of su within dataset
    and threshold, ties never split). excluded: dataset, uid and the first reason against each file or score. cuts: the
    thirds. describe and outcomes: tables by threshold and dataset. config: settings with the key of all of them.
    """
    keys = ["dataset", "uid"]
    identity = code.code_audit(codes.select(*keys, "measured_code"), codes.select(*keys, "scored_code"))
    every = joins.assert_unique(metrics, keys).join(joins.assert_unique(scores, keys), keys, "full_outer")
    every = every.join(identity, keys, "left").join(counts, keys, "left").join(clusters, keys, "left")
    units = [f"num_semantic_units_{label}" for label in thresholds]
    gone = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    nothing = F.lit(False)
    for c in ("loc", *units):
        nothing = nothing | gone(c) | (F.col(c) <= 0)
    reason = (
        F.when(gone("loc"), "no metric row").when(gone("score"), "no score").when(~F.coalesce(F.col("match").isin(*SAME_CODE), F.lit(False)), "code differs")
        .when(F.col("n").isNull() | (F.col("n") <= 0), "no trials").when(nothing, "missing or empty metric")
    )
    every = every.withColumn("reason", reason)
    kept = every.where("reason is null")
    k = F.coalesce(F.col("k"), recovered_count(F.col("score"), F.col("n")))
    agrees = F.abs(k / F.col("n") - F.col("score")) <= 1e-10
    k = F.when(agrees, k).otherwise(F.raise_error(F.concat(F.lit("verdicts and score differ: "), F.col("uid").cast("string"))))
    rows = kept.withColumn("k", k).unpivot([*keys, "loc", "k", "n", "cluster_id"], units, "label", "su")
    rows = rows.withColumn("threshold_label", F.substring_index("label", "_", -1)).drop("label")
    rows = rows.withColumns({"y": F.col("k") / F.col("n"), "logloc": F.log1p("loc"), "cluster_id": F.coalesce(F.col("cluster_id").cast("string"), F.col("uid").cast("string"))})
    by = ["threshold_label", "dataset"]
    cuts = bins.tercile_cuts(rows, by, "su")
    rows = bins.assign_intervals(rows, cuts, by, "su")
    config = {"thresholds": thresholds, "intervals": "thirds by linear quantiles, closed on the right", "response": "k/n, one row per code", "loc": "log1p"}
    return {
        "input": rows, "excluded": every.where("reason is not null").select(*keys, "reason"), "identity": identity, "cuts": cuts,
        "describe": bins.describe(rows, by, ["su", "loc", "k", "n", "y"], "y", "cluster_id", ("su", "loc")),
        "outcomes": rows.groupBy(*by, "k", "n").agg(F.count("*").cast("long").alias("codes")),
        "config": config | {"key": condition_key(config)},
    }


def audit(summary: DataFrame, scores: DataFrame, stored: DataFrame | None = None, width: int = 5) -> dict[str, DataFrame]:
    """What joining scores by cut ids changes against joining them by whole ids.

    summary: dataset, uid and metrics; scores: dataset, uid, ord, score. joined: files with the score of the whole id;
    changed: files whose score by the cut id is another, or that only the cut id finds; unused: scores without a file;
    bins: frequency tables of num_semantic_units, pooled and by dataset, where summary has them; report: against stored,
    where given.
    """
    keys = ["dataset", "uid"]
    exact = joins.assert_unique(summary, keys).join(joins.assert_unique(scores.select(*keys, "score"), keys), keys)
    legacy = joins.scored_legacy(summary, scores).select(*keys, F.col("score").alias("legacy_score"))
    both = legacy.join(exact.select(*keys, "score"), keys, "left")
    out = {
        "joined": exact, "changed": both.where(~F.coalesce(F.abs(F.col("score") - F.col("legacy_score")) <= 1e-10, F.lit(False))),
        "unused": scores.select(*keys, "score").join(summary.select(*keys), keys, "left_anti"),
    }
    if "num_semantic_units" in summary.columns:
        z = "lm_cc" if "lm_cc" in summary.columns else "num_semantic_units"
        out["bins"] = bins.frequency_table(bins.with_total(exact, "dataset"), ["scope"], width, "num_semantic_units", "score", z)
        if stored is not None:
            out["report"] = frames_report(out["bins"], stored, ["scope", "bin_start"])
    return out


def source_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, sha256) of the files that an audit has read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"))
