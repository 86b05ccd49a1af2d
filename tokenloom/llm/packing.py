"""Best-fit decreasing packing of token sequences, exact over the whole corpus by its histogram of lengths."""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import Scratch, arrow_batches, column, only_remember
from tokenloom.llm.vocab import encoder, public_file

CAPACITY, END_ID = 1024, 2
#: Pieces of one length are numbered in groups of about so many.
GROUP = 4096


class CapacityTree:
    """Segment tree over remaining capacities: which of them have an open bin, and the least that holds a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, open_: bool) -> None:
        k = capacity + self.size
        self.any[k] = open_
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity >= length with an open bin, in logarithmic time."""
        k = length + self.size
        if self.any[k]:
            return length
        while k > 1:
            if not k & 1 and self.any[k + 1]:
                k += 1
                break
            k >>= 1
        else:
            return None
        while k < self.size:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where the pieces go: rows (length, first rank, first bin, pieces a bin, offset) and the number of bins.

    counts: number of pieces by length. The result is that of best-fit decreasing piece by piece: a piece goes to the
    tightest open bin that holds it. Bins of equal remaining capacity are interchangeable and kept as ranges of
    numbers: a range takes pieces until its bins are full for this length, and is split where the pieces end. Piece
    r (from the row's first rank up) goes to bin first bin + r // pieces a bin. The work follows the number of
    lengths and ranges, not of documents.
    """
    tree, open_ = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    rows, bins = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            open_[left].append((first, n))
            if len(open_[left]) == 1:
                tree.set(left, True)

    for length in sorted((k for k in counts if counts[k]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        rest, rank = counts[length], 0
        while rest:
            left = tree.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                n = -(-rest // each)
                first, bins = bins, bins + n
            else:
                each = left // length
                first, n = open_[left].popleft()
                if not open_[left]:
                    tree.set(left, False)
            full, more = divmod(min(rest, n * each), each)
            rows.append((length, rank, first, each, capacity - left))
            put(left - each * length, first, full)
            if more:
                put(left - more * length, first + full, 1)
            used = full + bool(more)
            if n > used:
                open_[left].appendleft((first + used, n - used))
                tree.set(left, True)
            rank += full * each + more
            rest -= full * each + more
    return np.array(rows, np.int64).reshape(-1, 5), bins


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens: whole ones, after a shorter first one where n needs it."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and a hash by which pieces are dealt to groups.

    The hash also hangs on the place that the row has while it is written, so that repeated rows are dealt apart; what
    was written stands.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_remember("vocab")
        encode, end = encoder(path, True), struct.pack("<I", end_id)
        for batch in batches:
            row, at, start, length, crc = [], [], [], [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                ids = encode(t or "") + end
                done = 0
                for p, n in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(k)
                    at.append(p)
                    start.append(done)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * done : 4 * (done + n)]))
                    done += n
            new = [pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            id_ = batch.column("id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([id_, *new], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(column(key).alias("id"), column(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return found.withColumn("deal", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; one longer than the capacity is cut into whole pieces, after a shorter
    first one. Pieces are packed by best-fit decreasing over the whole table. A null or empty text is the end id
    alone; a null key is kept; repeated rows are packed as often as they stand; an empty table gives no rows; other
    columns are not read. Pieces of one length are numbered in groups whose number follows that of all pieces. The driver gets one count per length, `capacity` at most.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    path = path or public_file("byte_bpe_50k.json")
    scratch = Scratch(spark, "packing")
    table = scratch.save(pieces(docs, path, capacity, end_id, text, key), "pieces")
    groups = 1 + table.count() // GROUP
    table = table.withColumn("part", F.pmod("deal", F.lit(groups))).drop("deal")
    counts = scratch.save(table.groupBy("length", "part").count(), "counts")
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    plan, _ = best_fit_decreasing(by_length, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = table.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = plan[:, 0] * (1 << 45) + plan[:, 1]
        order = np.argsort(code)
        code, rows = code[order], plan[order]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = rows[np.searchsorted(code, length * (1 << 45) + rank, "right") - 1]
            k = rank - row[:, 1]
            sequence, offset = row[:, 2] + k // row[:, 3], row[:, 4] + k % row[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    kind = table.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
