"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, personal data, packing, in this order.

Each stage reads what its predecessor kept, written as Parquet and reread. All but the last return the columns of
documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import linechunks, packing, pii, simhash, toxicity
from tokenloom.llm._common import Scratch, numbered, place_of


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the classifier learns from the labels of the ones that aren't held out.

    Null and empty texts score by the classifier's bias alone. Null ids and repeated rows are judged by their texts; an
    empty table stays empty; all columns pass through, whatever their names.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks go. A document that had text and has no word left repeats others wholly, and goes too.

    Null and empty texts stay. Rows that repeat id and text fare alike; unlike texts under one id are documents of
    their own; null ids come first in order; an empty table stays empty; other columns pass through.
    """
    rows, names = numbered(docs)
    text, size = place_of(names, "text"), place_of(names, "n_chars")
    found = linechunks.dedup_lines(rows, text, place_of(names, "doc_id"))
    left = found.where((F.col("n_removed") == 0) | F.col(text).rlike(r"\S"))
    changed = F.when(F.col("n_removed") > 0, F.length(text).cast(rows.schema[size].dataType)).otherwise(F.col(size))
    return left.withColumn(size, changed).select(*rows.columns).toDF(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Texts without words are like no other and stay. Unlike texts under one id are judged apart, of rows that repeat id
    and text one stays, null ids come after all others; an empty table stays empty; other columns pass through.
    """
    return simhash.one_of_each(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars follows where that changes a text.

    Null and empty texts, null ids and repeated rows pass through; an empty table stays empty; other columns stay.
    """
    rows, names = numbered(docs)
    text, size = place_of(names, "text"), place_of(names, "n_chars")
    found = pii.mask_table(rows.withColumn("was", F.xxhash64(text)), text)
    length = F.length(text).cast(rows.schema[size].dataType)
    return found.withColumn(size, F.when(F.xxhash64(text) == F.col("was"), F.col(size)).otherwise(length)).drop("was").toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in sequences.

    A null or empty text is the end id alone; null ids are kept, repeated rows are packed as often as they stand; an
    empty table has no pieces; other columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean),
    ("line_dedup", lines),
    ("simhash_dedup", near_copies),
    ("pii", masked),
    ("best_fit_packing", packed),
]

#: The stages can't be expressed in SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and reread as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
