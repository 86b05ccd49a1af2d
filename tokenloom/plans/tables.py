"""The driver's tables in the roles of the engine's data: documents as files, languages as datasets, labels as scores."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import tokens as tok

KEYS = ["dataset", "uid"]
THRESHOLDS = {"p67": 2.01, "p80": 2.4}
#: Python sources out of documents: words in a statement, statements in a function, and functions in a source.
WORDS, STATEMENTS, FUNCTIONS = 8, 10, 5
_BRACES = (("int f", "(int n) {\n"), "{w} = {s};", "if ({w} > n) {\n        n = {s};\n    } else {\n        {w} = n;\n    }", "{w}({s}, n);", "while (n < {w}) {\n        n += 1;\n    }", "}\n")
TEMPLATES = {
    "python": (("def f", "(n):\n"), "{w} = {s}", "if {w} > n:\n        n = {s}\n    else:\n        {w} = n", "{w}({s}, n)", "for {w} in {s}:\n        n += 1", ""),
    "c": _BRACES, "java": _BRACES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, uid, text) of documents."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("uid"), "text")


def tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Token rows of documents with metrics by md5 and text attributes in place of syntax; the columns that are asked for, or all."""
    return tok.measure(files(spark, sf_dir), KEYS, form="md5", columns=columns)


def token_files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Those columns of tokens() as arrays, a row for each file, dealt out by file once: what is made of it and joined by file goes no further.

    Strings are dealt out as one text for each file, parted by tabs, which no token holds.
    """
    t = tok.by_file(files(spark, sf_dir), KEYS, form="md5", columns=columns)
    texts = [c for c in columns if t.schema[c].dataType.simpleString() == "array<string>"]
    return t.withColumns({c: F.array_join(c, "\t") for c in texts}).repartition(*KEYS).withColumns({c: F.split(c, "\t") for c in texts})


def cheap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, uid, cluster, su, loc, words, score): file-level numbers straight from documents, for statistics.

    su and loc are counts of sentence ends and lines, score the label of quality; files without one have none.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset"), F.col("doc_id").alias("uid"), F.col("source").alias("cluster"),
        (F.regexp_count("text", F.lit("[.]")) + 1).cast("long").alias("su"), (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("loc"), F.regexp_count("text", F.lit(" ")).cast("long").alias("words"),
    )
    scores = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("uid")).agg(F.max("quality").cast("double").alias("score"))
    return docs.join(scores, "uid", "left").select("dataset", "uid", "cluster", "su", "loc", "words", "score")


def sources(spark: SparkSession, sf_dir: str, language: str = "python") -> DataFrame:
    """(dataset, uid, text): Python, C or Java sources made of the words of documents, every word of every text.

    A text's words (runs of A-Z and a-z) make statements of eight, functions of ten statements and sources of five
    functions, so that a long text gives many sources; uid is the document's id and the source's number. A statement's
    length, modulo 4, tells its kind: an assignment, an if with else, a call, or a loop. A text without words is one
    empty source. Texts are dealt out by id first, as sources are parsed where they are made.
    """
    size, word, braced = WORDS * STATEMENTS * FUNCTIONS, re.compile("[A-Za-z]+"), language == "java"
    # function head, assignment, if with else, call, loop, end of a function: {w} is the name, {s} the words in quotes
    head, given, branch, call, loop, end = TEMPLATES[language]
    bodies = (call, loop, given, branch)  # by the length of the quoted words, two quotes more than the words

    def source(words: list[str]) -> str:
        made, last = [], -(-len(words) // WORDS) - 1
        for k in range(last + 1):
            said = " ".join(words[k * WORDS : (k + 1) * WORDS])
            body = bodies[(len(said) + 2) % 4].replace("{w}", "w" + words[k * WORDS]).replace("{s}", f'"{said}"')
            begins = f"{head[0]}{k}{head[1]}" if k % STATEMENTS == 0 else ""
            made.append(f"{begins}    {body}\n{end if k % STATEMENTS == STATEMENTS - 1 or k == last else ''}")
        return f"class A {{\n{''.join(made)}}}\n" if braced and made else "".join(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):  # few texts at once: one may give many sources
                part = batch.slice(low, 64)
                at, uids, texts = [], [], []
                for k, (doc, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    words = word.findall(text or "")
                    for n, first in enumerate(range(0, max(len(words), 1), size)):
                        at.append(k)
                        uids.append(str(n) if doc is None else f"{doc}_{n}")
                        texts.append(source(words[first : first + size]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), pa.array(uids, pa.string()), pa.array(texts, pa.string())], names=["dataset", "uid", "text"])

    # a shuffle's number of tasks, however few row groups hold the texts, and not fewer where they are small: parsing takes far longer than dealing out
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text").repartition(n, "doc_id")
    return docs.select(F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(run, "dataset string, uid string, text string")
