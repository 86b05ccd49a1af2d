"""Readers: source files, token tables, summaries, scores, records, case packages and settings."""

from __future__ import annotations

import hashlib
import json
import tomllib
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenloom.functions.text import base_id, normalize_newlines
from tokenloom.schema import TOKENS, conform

#: Extensions of the supported languages.
LANGUAGES = {".py": "python", ".c": "c", ".h": "c", ".java": "java"}


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of whole UTF-8 files with newlines made one; a missing path is an error."""
    found = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), normalize_newlines(F.col("value")).alias("text"))
    return found


def source_tree(spark: SparkSession, root: str, done: DataFrame | None = None) -> DataFrame:
    """(path, language, size) of supported sources under root, without those whose path is in done."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    suffix = F.concat(F.lit("."), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)))
    languages = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    files = files.withColumn("language", F.try_element_at(languages, suffix)).where("language is not null")
    return files.join(done.select("path"), "path", "left_anti") if done is not None else files


def token_tree(spark: SparkSession, root: str, pattern: str = "result_*.parquet") -> DataFrame:
    """Token tables under root with dataset (parent folder) and uid (file name without result_ and ending)."""
    found = spark.read.schema(TOKENS).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(root)
    path = F.col("_metadata.file_path")
    named = found.withColumns({"dataset": F.regexp_extract(path, "([^/]+)/[^/]+$", 1), "uid": F.regexp_extract(path, r"result_([^/]*)\.parquet$", 1)})
    return conform(named)


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """One token table. A path that is missing, and a file that is no Parquet file by its name, is an error at once."""
    if not path.endswith(".parquet"):
        raise ValueError(f"not a Parquet file: {path}")
    return conform(spark.read.schema(TOKENS).option("recursiveFileLookup", "true").parquet(path))


def entropy_only(spark: SparkSession, root: str) -> DataFrame:
    """The one column that pooled percentiles need."""
    return token_tree(spark, root).select("metric_entropy").where("metric_entropy is not null")


def csv_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return conform(spark.read.csv(path, header=True, schema=schema, enforceSchema=False), schema)


def _place_in_files() -> Column:
    """Where a row stands: its file, the block of the file, and its turn in the block. How blocks are dealt to tasks does not change the order."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def group_csvs(spark: SparkSession, glob: str, schema: StructType) -> DataFrame:
    """CSV files as one table, the first row of each (uid, dataset) by file and place."""
    rows = spark.read.csv(glob, header=True, schema=schema, enforceSchema=False).withColumn("__at", _place_in_files())
    first = Window.partitionBy("uid", "dataset").orderBy("__at")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__at")


def _no_duplicates(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError(f"duplicate keys: {sorted({k for k, _ in pairs if sum(q == k for q, _ in pairs) > 1})}")
    return out


def parse_scores(text: str, form: str) -> dict[str, float]:
    """Scores by id from a JSON text, `simple` (id to number) or `nested` (id to a record with pass@1).

    Duplicate keys, values that are no number in [0, 1], and records whose task_id differs from their key are errors;
    ids without a score are left out.
    """
    if form not in ("simple", "nested"):
        raise ValueError(f"unknown form {form}")
    out = {}
    for uid, value in json.loads(text, object_pairs_hook=_no_duplicates).items():
        if form == "nested":
            if "task_id" in value and value["task_id"] is not None and str(value["task_id"]) != uid:
                raise ValueError(f"{uid} has the record of {value['task_id']}")
            value = value.get("pass@1")
        if value is None:
            continue
        if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1:
            raise ValueError(f"{uid}: {value!r} is no score")
        out[uid] = float(value)
    return out


def scores(spark: SparkSession, path: str, form: str, dataset: str, legacy: bool = False) -> DataFrame:
    """(dataset, uid, score) from a score file, parsed where it is read.

    legacy: only ids without a suffix, a missing nested score is 0.0, and nothing is checked.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                if legacy:
                    found = {k: v if form == "simple" else v.get("pass@1") or 0.0 for k, v in json.loads(text).items() if "__" not in k}
                else:
                    found = parse_scores(text, form)
                yield pd.DataFrame({"dataset": dataset, "uid": list(found), "score": [float(x) for x in found.values()]})

    return spark.read.text(path, wholetext=True).mapInPandas(read, "dataset string, uid string, score double")


def expected_ids(ids: DataFrame, legacy: bool = False) -> DataFrame:
    """Ids that a dataset must have; legacy: without suffixes."""
    return (ids.select(base_id(F.col("uid")).alias("uid")) if legacy else ids.select("uid")).distinct()


def jsonl_last(spark: SparkSession, path: str, key: str, schema: StructType | None = None) -> DataFrame:
    """JSON lines by key; of repeated keys the last line stands."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.json(path).withColumn("__at", _place_in_files())
    last = Window.partitionBy(key).orderBy(F.desc("__at"))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__at")


def entropy_json(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, pos, token, entropy) from lists of {task_id, tokens, entropies}; NaN as null."""
    rows = spark.read.schema("task_id string, tokens array<string>, entropies array<double>").option("allowNonNumericNumbers", "true").json(path, multiLine=True)
    each = rows.select("task_id", F.posexplode(F.arrays_zip("tokens", "entropies")).alias("pos", "t"))
    return each.select("task_id", "pos", F.col("t.tokens").alias("token"), F.when(~F.isnan("t.entropies"), F.col("t.entropies")).alias("entropy"))


def relative_data_path(path):
    """What follows the last data/ of a foreign path; a path without one stays as it is."""
    return F.when(path.rlike("/data/"), F.regexp_extract(path, "(?s).*/data/(.*)$", 1)).otherwise(path)


def safe_member(name: str) -> str:
    """A package member's name; one that leaves the package is an error."""
    p = PurePosixPath(name)
    if p.is_absolute() or ".." in p.parts or not p.parts or "\\" in name:
        raise ValueError(f"unsafe name in package: {name}")
    return str(p)


def load_package(path: str) -> dict[str, bytes]:
    """Members of a case package, a zip file or a folder; it is small and read by the driver."""
    root = Path(path)
    if root.is_dir():
        return {safe_member(str(f.relative_to(root).as_posix())): f.read_bytes() for f in sorted(root.rglob("*")) if f.is_file()}
    with zipfile.ZipFile(root) as z:
        return {safe_member(i.filename): z.read(i) for i in z.infolist() if not i.is_dir()}


def package_cases(spark: SparkSession, path: str, manifest: str = "manifest.json") -> DataFrame:
    """Cases of a package in manifest order, with their files' hashes and test counts verified."""
    files = load_package(path)
    rows = []
    for order, case in enumerate(json.loads(files[manifest])):
        for side in ("original", "transformed"):
            name = safe_member(case[side])
            digest = hashlib.sha256(files[name]).hexdigest()
            if case.get(f"{side}_sha256", digest) != digest:
                raise ValueError(f"{name} isn't what the manifest says")
            case[f"{side}_sha256"], case[f"{side}_code"] = digest, files[name].decode()
        tests = json.loads(files[safe_member(case["tests"])]) if case.get("tests") else []
        if case.get("test_count", len(tests)) != len(tests):
            raise ValueError(f"{case['case_id']} has {len(tests)} tests")
        rows.append((order, case["case_id"], case.get("category"), case.get("title"), case["original_code"], case["transformed_code"], case["original_sha256"], case["transformed_sha256"], len(tests), json.dumps(tests), case.get("entry")))
    return spark.createDataFrame(rows, "ord int, case_id string, category string, title string, original string, transformed string, original_sha256 string, transformed_sha256 string, test_count int, tests string, entry string")


def settings(path: str, defaults: dict | None = None, overrides: dict | None = None) -> dict:
    """A TOML file over defaults, and overrides over both, merged at every level."""
    return merged(merged(defaults or {}, tomllib.loads(Path(path).read_text())), overrides or {})


def merged(base: dict, over: dict) -> dict:
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def task_dirs(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Files <id>/main.py and <id>__*/main.py joined with their tasks on the id without suffix."""
    named = files.withColumn("case_id", F.regexp_extract("path", "([^/]+)/main\\.py$", 1)).where("case_id <> ''")
    return named.withColumn("uid", base_id(F.col("case_id"))).join(tasks, "uid")


def same_code(cases: DataFrame, tasks: DataFrame) -> DataFrame:
    """Cases whose trimmed code is their task's."""
    # line breaks around a code do not count, spaces do
    bare = lambda c: F.regexp_replace(c, "^\n+|\n+$", "")
    return cases.join(tasks.select("uid", bare("code").alias("__code")), "uid").where(bare("text") == F.col("__code")).drop("__code")
