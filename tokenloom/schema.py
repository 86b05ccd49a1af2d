"""Declared schemas, the missing-value rule and session settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, LongType, StringType, StructField, StructType

_KINDS = {"long": LongType(), "string": StringType(), "double": DoubleType(), "boolean": BooleanType()}


def declared(fields: str) -> StructType:
    """A schema from `name kind, ...`; unlike DDL it needs no running session."""
    return StructType([StructField(n, _KINDS[k]) for n, k in (f.split() for f in fields.split(","))])


#: One row per token. Columns that a file lacks are read as null.
TOKENS = declared(
    "idx long, token_id long, token_str string, line long, column long, ast_type string, nesting_depth long, function_id string, "
    "is_statement_start boolean, is_function_start boolean, metric_surprisal double, metric_entropy double, metric_isolated_surprisal double, "
    "meta_project string, meta_file string, meta_language string, meta_model_name string, meta_model_revision string, meta_tokenizer_name string, "
    "meta_context_strategy string, meta_total_tokens long, meta_created_at string, meta_collector_version string"
)
#: One row per file.
SUMMARY = declared(
    "avg_context_surprisal_gap double, avg_first_token_surprisal double, cognitive_complexity double, cyclomatic_complexity double, dataset string, "
    "lm_cc double, lm_cc_density double, loc long, num_functions long, num_semantic_units long, ppl double, total_tokens long, uid string"
)
#: Entropy thresholds in nats by percentile label. p80 is the value that reproduces saved data; an older label says 1.2515.
P67, P80, P80_OLDER = 0.6813, 1.3238, 1.2515


def session(name: str = "tokenloom", **settings: str) -> SparkSession:
    """A session with UTC and ANSI semantics stated."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def known(c: Column) -> Column:
    """NaN as null: one missing value instead of two."""
    return F.when(~F.isnan(c), c)


def canonical(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)]
    return df.withColumns({c: known(F.col(f"`{c}`")) for c in floats}) if floats else df


def conform(df: DataFrame, schema: StructType = TOKENS) -> DataFrame:
    """The columns of schema in order, null where df has none; further columns follow."""
    have = set(df.columns)
    first = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return canonical(df.select(*first, *[F.col(f"`{c}`") for c in df.columns if c not in schema.names]))
