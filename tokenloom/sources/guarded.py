"""Token files read one by one, so that a damaged file is a row and not the end of the job, in batch and as a stream.

Spark lists the files and reads their bytes, from any store it knows, several files a task; a task parses each by itself.
What can't be read gives one row with the reason; the rows of all other files are as token_tree gives them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tokenloom.operators.metrics import file_metrics
from tokenloom.operators.units import clean
from tokenloom.schema import TOKENS, canonical, declared

#: Bytes of a file that a task reads whole; tables beyond it are no single token files.
MOST_BYTES = 512 << 20
#: Rows of one batch, and columns without which a table holds no tokens.
ROWS, NEEDED = 10_000, ("token_str", "metric_entropy", "metric_surprisal")

_FILE = declared("path string, dataset string, uid string, error string")
GUARDED = StructType([*_FILE.fields, *TOKENS.fields])


def _listed(reader, root: str, pattern: str) -> DataFrame:
    files = reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", "content")


def empty_files(spark: SparkSession, root: str, pattern: str = "result_*.parquet") -> DataFrame:
    """Files of no bytes as error rows. Spark's scans pass them over, so they are what is listed and not scanned.

    The driver holds the list of paths, as it does for any scan of these files.
    """
    files = _listed(spark.read, root, pattern)
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(path)),) for path in files.inputFiles()], "path string")
    return _named(_errors(listed.join(files.select("path"), "path", "left_anti"), "empty file"))


def _errors(files: DataFrame, reason: str) -> DataFrame:
    null = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    return files.select("path", null(_FILE["dataset"]), null(_FILE["uid"]), F.lit(reason).alias("error"), *map(null, TOKENS.fields))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"dataset": F.regexp_extract("path", "([^/]+)/[^/]+$", 1), "uid": F.regexp_extract("path", r"result_([^/]*)\.parquet$", 1)})


def _parsed(files: DataFrame, most_bytes: int) -> DataFrame:
    """(path, dataset, uid, error, token columns): the tokens of each readable file, one row for each other file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(GUARDED)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from tokens(schema, path, content.as_buffer())

    def tokens(schema: pa.Schema, path: str, content: pa.Buffer) -> Iterator[pa.RecordBatch]:
        """A file that breaks off after its first rows gives none of them: all are made before one is handed on."""
        try:
            table = pq.ParquetFile(pa.BufferReader(content))
            have = set(table.schema_arrow.names)
            lacking = [c for c in NEEDED if c not in have]
            if lacking:
                raise ValueError(f"no column {', '.join(lacking)}")
            if not table.metadata.num_rows:
                raise ValueError("no tokens")
            found = [made(schema, path, rows) for rows in table.iter_batches(ROWS, columns=[c for c in TOKENS.names if c in have])]
        except (pa.ArrowException, ValueError, OSError, EOFError) as error:
            reason = f"{type(error).__name__}: {error}".splitlines()[0][:500]
            found = [pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([path, None, None, reason] + [None] * len(TOKENS), schema, strict=True)], schema=schema)]
        yield from found

    def made(schema: pa.Schema, path: str, rows: pa.RecordBatch) -> pa.RecordBatch:
        n, have = rows.num_rows, set(rows.schema.names)
        columns = [pa.array([path] * n, pa.string()), *(pa.nulls(n, pa.string()) for _ in range(3))]
        columns += [rows.column(f.name).cast(f.type) if f.name in have else pa.nulls(n, f.type) for f in list(schema)[4:]]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    # content is not read where the condition on length fails: the scan takes it
    small = files.where(F.col("length") <= most_bytes).select("path", "content").mapInArrow(run, GUARDED)
    large = _errors(files.where(F.col("length") > most_bytes), f"larger than {most_bytes} bytes")
    return canonical(_named(small.unionByName(large)))


def guarded_tree(spark: SparkSession, root: str, pattern: str = "result_*.parquet", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Tokens of all files under root, and one row with `error` for each file that can't be read.

    Errors: damaged, cut off or empty files, tables without the columns of tokens, with other types, or without a row,
    and files beyond most_bytes (token_tree reads those). A root that is missing is an error of the job.
    """
    return _parsed(_listed(spark.read, root, pattern), most_bytes).unionByName(empty_files(spark, root, pattern))


def guarded_stream(spark: SparkSession, root: str, files: int = 64, pattern: str = "result_*.parquet", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The same for files as they arrive, but for empty ones, which summarise() adds."""
    return _parsed(_listed(spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files), root, pattern), most_bytes)


def summaries(rows: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row per file: dataset, uid, path, status (ok or error), error, and the metrics of file_metrics (null in errors).

    A file whose tokens leave nothing to measure has an error too.
    """
    keys = ["dataset", "uid", "path"]
    tokens = rows.where("error is null").drop("error")
    metrics = file_metrics(clean(tokens, keys), keys, thresholds)
    lines = rows.where("error is not null").select(*keys, "error")
    lost = rows.where("error is null").select(*keys).distinct().join(metrics.select(*keys), keys, "left_anti").withColumn("error", F.lit("nothing to measure"))
    good = metrics.withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
    bad = lines.unionByName(lost).withColumn("status", F.lit("error"))
    names = [c for c in metrics.columns if c not in keys]
    return good.unionByName(bad, allowMissingColumns=True).select(*keys, "status", "error", *names)


def summarise(rows: DataFrame, root: str, out: str, checkpoint: str, thresholds: dict[str, float]) -> StreamingQuery:
    """Write the summaries of each batch of files to out/batch=<id>; a repeated batch overwrites its own folder only.

    Each batch adds the empty files under root that no earlier batch has told of.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = empty_files(spark, root)
        if number:
            told = spark.read.parquet(*(f"{out}/batch={k}" for k in range(number)))
            empty = empty.join(told.select("path"), "path", "left_anti").select(*batch.columns)
        summaries(batch.unionByName(empty), thresholds).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tally(found: DataFrame) -> DataFrame:
    """(dataset, status, n): how a run over many files went."""
    return found.groupBy("dataset", "status").agg(F.count("*").cast("long").alias("n"))
