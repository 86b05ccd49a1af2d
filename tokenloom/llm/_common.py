"""What the operators of this subpackage share: scratch tables, Arrow streams of groups, small hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; texts can be long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one for a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="tokenloom-")
    return _own_dir[app]


class Scratch:
    """Tables written once and reread, which cuts lineage: a lost executor costs a reread, not a recomputation.

    A result that reads them lazily needs them until it is written itself; they lie in folders named tokenloom-* and
    can go once no job runs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tokenloom-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, tag: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_batches(spark: SparkSession) -> None:
    """Short Arrow batches for operators that read whole texts: the one session setting of this subpackage.

    Plans are lazy and read it when they run, so it is left in force; all operators ask for the same, and a session
    that has smaller batches keeps them.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not re.fullmatch(r"\d+b?", now) or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


_caches: list[tuple[str, Callable[[], None]]] = []


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Say how a worker forgets what an operator remembers in its module."""
    _caches.append((operator, forget))


def only_remember(operator: str) -> None:
    """In a worker that goes on from one operator's tasks to another's: forget what the others remember, and give the
    memory back to the system."""
    for other, forget in _caches:
        if other != operator:
            forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def column(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns named by number, and their names: nothing that an operator adds can clash with them."""
    return df.toDF(*(f"_{k}" for k in range(len(df.columns)))), df.columns


def place_of(names: list[str], name: str) -> str:
    """The number-name of a column; names that differ only in case are told apart by their spelling."""
    return f"_{names.index(name)}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_text(
    df: DataFrame, text: str, keep: list[str], schema: str, make: Callable[[], Callable[[list[str]], list[list]]]
) -> DataFrame:
    """Map rows by their texts. make() runs once per task and gives a function from texts (null: empty) to output columns.

    keep: columns passed through unchanged; schema: of the added columns.
    """
    source = df.select(*map(column, keep), column(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work, names = make(), None
        for batch in batches:
            if names is None:
                names = to_arrow_schema(added)
            columns = work([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            new = [pa.array(c, type=f.type) for c, f in zip(columns, names, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *names.names]
            )

    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    return source.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by keys; at least `rows` rows each, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(group_starts(table, keys)[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        n -= cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on range(n)."""
    parent = list(range(n))
    out = []
    for edge in zip(a.tolist(), b.tolist(), strict=True):
        x, y = edge
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(edge)
    return out


class Merger:
    """Spanning forest of a group, fed one row of its link matrix at a time."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def add(self, row: int, linked: np.ndarray) -> None:
        """linked: indices of the rows that `row` links with."""
        if not len(linked):
            return
        labels, first = np.unique(self.label[linked], return_index=True)
        mine = self.label[row]
        for label, k in zip(labels.tolist(), first.tolist(), strict=True):
            if label != mine:
                self.edges.append((row, int(linked[k])))
                self.label[self.label == label] = mine


def spread_join(rows: DataFrame, known: DataFrame, on: list[str], count: str, kind: str = "inner") -> DataFrame:
    """rows joined with known, a written table with one row per key and, in `count`, how many of rows have the key.

    Keys of more than a quarter of a task's even share of rows are broadcast: by their counts they are at most four
    times the shuffle partitions, whatever the input. The rows of all other keys meet by a shuffle, in which no key
    makes a task large. kind: inner or left.
    """
    spark = rows.sparkSession
    total = known.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    most = max(64, total // (4 * shuffle_partitions(spark)))
    hot, cold = (known.where(which).drop(count) for which in (F.col(count) > most, F.col(count) <= most))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, kind))


def tiled(df: DataFrame, scratch: Scratch, bucket: list[str], member: str, tile: int) -> DataFrame:
    """Split large buckets into cells that compare at most two tiles, so that no bucket meets in one task.

    A bucket of n rows gets ceil(n / tile) tiles by the member's hash. Each pair of tiles is a cell, `cell` its
    number; a row goes to every cell of its tile. Pairs of one tile belong to the cell of that tile with itself.
    Adds columns `cell` long and `own_tile` int.
    """
    hot = scratch.save(
        df.groupBy(*bucket).count().where(F.col("count") > tile).withColumn("tiles", F.ceil(F.col("count") / tile).cast("int")).drop("count"),
        "hot",
    )
    found = hot.count()
    if not found:
        return df.withColumn("cell", F.lit(0).cast("long")).withColumn("own_tile", F.lit(0))
    if found <= 10_000:  # at most so many narrow rows: a checked bound
        hot = F.broadcast(hot)
    own = F.pmod(F.xxhash64(F.lit(17), F.col(member)), F.coalesce("tiles", F.lit(1))).cast("int")
    wide = df.join(hot, bucket, "left").withColumn("own_tile", own)
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    low, high = F.least("own_tile", "other").cast("long"), F.greatest("own_tile", "other").cast("long")
    return wide.withColumn("cell", F.shiftleft(low, 31) + high).drop("tiles", "other")
