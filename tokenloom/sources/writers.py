"""Sinks: token tables, documents, summaries, block trees, logs, reports, receipts."""

from __future__ import annotations

import csv
import html
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import first_number
from tokenloom.schema import SUMMARY, conform


def write_tokens(tokens: DataFrame, meta: DataFrame, path: str, buckets: int | None = None) -> None:
    """Flat token rows with their file's metadata (columns meta_*) on every row; both have dataset and uid.

    A folder for each file, as far as a store bears it; with buckets, one for each hash of the file, its rows sorted by file.
    """
    rows = tokens.join(meta, ["dataset", "uid"], "left")
    if buckets:
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("dataset", "uid"), F.lit(buckets)).cast("int"))
        dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "dataset", "uid", *(c for c in ("pos",) if c in rows.columns)).write.mode("errorifexists").partitionBy("bucket").parquet(path)
        return
    rows.write.mode("errorifexists").partitionBy("dataset", "uid").parquet(path)


def documents(tokens: DataFrame, meta: DataFrame) -> DataFrame:
    """(dataset, uid, json): one nested document {metadata, tokens} per file, tokens in order."""
    fields = [c for c in tokens.columns if c not in ("dataset", "uid")]
    nested = tokens.groupBy("dataset", "uid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tokens"))
    about = F.struct(*[F.col(c) for c in meta.columns if c not in ("dataset", "uid")])
    return nested.join(meta.select("dataset", "uid", about.alias("metadata")), ["dataset", "uid"]).select("dataset", "uid", F.to_json(F.struct("metadata", "tokens"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(tokens: DataFrame, meta: DataFrame, path: str) -> None:
    documents(tokens, meta).write.mode("errorifexists").partitionBy("dataset", "uid").text(path)


def write_enriched(tokens: DataFrame, path: str) -> None:
    """Token rows with surprisal_gap, in folders like the input's."""
    tokens.write.mode("errorifexists").partitionBy("dataset", "uid").parquet(path)


def summary_order(summary: DataFrame) -> DataFrame:
    """By dataset, the first number in the id (ids without one last), and id."""
    return summary.orderBy("dataset", first_number(F.col("uid")).asc_nulls_last(), "uid")


def write_summary(summary: DataFrame, path: str) -> None:
    """One CSV of a row per file, in fixed row and column order."""
    ordered = summary_order(conform(summary, SUMMARY).select(*SUMMARY.names))
    ordered.coalesce(1).write.mode("errorifexists").csv(path, header=True)


def write_block_trees(trees: DataFrame, path: str) -> None:
    """JSON lines of {task_id, tokens, entropies, code, block_tree}; an existing path is an error."""
    trees.select("dataset", F.to_json(F.struct("task_id", "tokens", "entropies", "code", "block_tree")).alias("value")).write.mode("errorifexists").partitionBy("dataset").text(path)


def append_log(spark: SparkSession, record: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def atomic_json(path: str, value) -> None:
    """A small JSON file of the driver, whole or not at all."""
    target = Path(path)
    part = target.with_name(target.name + ".part")
    part.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    os.replace(part, target)


def atomic_csv(path: str, rows: list[dict], fields: list[str]) -> None:
    """A small CSV file of the driver with a header, whole or not at all; a row with other fields is an error."""
    target = Path(path)
    part = target.with_name(target.name + ".part")
    with part.open("w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fields, lineterminator="\n")
        out.writeheader()
        out.writerows(rows)
    os.replace(part, target)


def write_reports(reports: DataFrame, path: str) -> None:
    """Documents of markup.reports(), each in a folder of its pair."""
    reports.write.mode("errorifexists").partitionBy(*(c for c in reports.columns if c != "report")).text(path)


def new_folder(parent: str, name: str) -> str:
    """A fresh output folder; an existing one is an error."""
    target = Path(parent) / name
    target.mkdir(parents=True, exist_ok=False)
    return str(target)


def receipt(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, sha256, size) of all files under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", f"{root.rstrip('/')}/(.*)$", 1)
    return files.select(name.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verify_receipt(now: DataFrame, saved: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a saved receipt."""
    b = saved.select("path", F.col("sha256").alias("saved"))
    joined = now.select("path", "sha256").join(b, "path", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("saved")))
    return joined.select("path", F.when(F.col("saved").isNull(), "new").when(F.col("sha256").isNull(), "missing").otherwise("changed").alias("state"))


def html_report(title: str, lines: list[dict]) -> str:
    """Side-by-side lines of a comparison as HTML; rows of a line table, which is small, collected by the caller."""
    body = []
    for r in lines:
        kind = html.escape(str(r.get("status", "")))
        cells = [r.get("orig_line"), r.get("text_before"), r.get("new_line"), r.get("text_after")]
        body.append(f'<tr class="{kind}">' + "".join(f"<td><pre>{html.escape('' if c is None else str(c))}</pre></td>" for c in cells) + "</tr>")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{''.join(body)}</table>\n"


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return ""
    names = list(rows[0])
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows]) + "\n"
