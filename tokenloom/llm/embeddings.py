"""Near-duplicate vectors by iterative quantisation: learned binary codes, multi-index tables, exact rerank.

A rotation learned on a bounded sample makes the signs of a vector's coordinates a balanced binary code. The code is
cut into substrings, one table each: vectors that agree in a substring meet in a bucket. At cosine c a bit differs
with probability acos(c) / pi. The length of a substring follows the number of rows, so that buckets stay small, and
the number of tables follows that length, so that a pair at the threshold itself is found with a given probability
and one beyond it more surely. Pairs of a bucket are compared by their original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import Merger, Scratch, arrow_batches, column, forest, group_starts, shuffle_partitions, spread_join, tiled, whole_groups
from tokenloom.llm.components import component_roots

COSINE = 0.93
#: Probability that a pair at the threshold is found, rows of one label that a bucket is meant for, bits of a substring at most.
FOUND, BUCKET, MOST_BITS = 0.995, 32, 30
#: Rows that the rotation is learned on at most, and rounds of learning.
SAMPLE, ROUNDS = 10_000, 30
#: Rows of a tile of a large bucket; buckets up to SMALL are compared by shifts over many at once.
TILE, SMALL = 1024, 24


def learn(x: np.ndarray, bits: int, seed: int = 11) -> np.ndarray:
    """Projection (dimensions, bits) by iterative quantisation; blocks of it, each a rotation of the leading directions."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    if len(x):
        _, axes = np.linalg.eigh(x.T @ x)
    else:
        axes = np.eye(d)
    blocks = []
    while sum(b.shape[1] for b in blocks) < bits:
        c = min(d, bits - sum(b.shape[1] for b in blocks))
        top = axes[:, ::-1][:, :c]
        v = x @ top
        r = np.linalg.qr(rng.standard_normal((c, c)))[0]
        for _ in range(ROUNDS if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        blocks.append(top @ r)
    return np.concatenate(blocks, axis=1)


def shape_of(rows: int, cosine: float) -> tuple[int, int]:
    """(tables, bits of a substring) for so many rows of the largest label."""
    bits = min(MOST_BITS, max(8, math.ceil(math.log2(max(1, rows) / BUCKET))))
    agree = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - FOUND) / math.log1p(-min(agree, 0.999)))), bits


def codes(x: np.ndarray, projection: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Substrings (rows, tables) of the binary codes; bits of all blocks are dealt to the tables in turn."""
    signs = (x @ projection >= 0)[:, : tables * bits].reshape(len(x), bits, tables)
    return (signs * (1 << np.arange(bits))[None, :, None]).sum(axis=1).astype(np.int32)


class _Projections(dict):
    """A projection for each dimension: learned where the sample has vectors of it, else a fixed random one."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, d: int) -> np.ndarray:
        self[d] = learn(np.zeros((0, d)), self.size)
        return self[d]


def _bucket_links(x: np.ndarray, code: np.ndarray, copies: np.ndarray, tile: np.ndarray, table: int, split: bool, cosine: float):
    """Links of one bucket, each counted in the first table where its rows agree: counts per row and edges."""
    n = len(x)
    count, merger = np.zeros(n, np.int64), Merger(n)
    for k in range(0, n, 256):
        i, j = np.nonzero(x[k : k + 256] @ x.T >= cosine)
        i += k
        keep = i > j
        if split:  # a cell of two tiles has the pairs between them; each tile's own pairs are in its own cell
            keep &= tile[i] != tile[j]
        i, j = i[keep], j[keep]
        first = (code[i] == code[j]).argmax(axis=1) == table
        i, j = i[first], j[first]
        count += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
        if len(i):
            rows, begin = np.unique(i, return_index=True)
            for row, part in zip(rows.tolist(), np.split(j, begin[1:]), strict=True):
                merger.add(row, part)
    return count, merger.edges


def bucket_table(table: pa.Table, cosine: float) -> pa.RecordBatch:
    """Rows (kind, a, b): kind 0, representative a has b links here; kind 1, an edge from a to b."""
    keys = ["label", "dim", "number", "slot", "cell"]
    starts = group_starts(table, keys)
    n = table.num_rows
    sizes = np.diff(np.append(starts, n))
    rep, copies, dim = (table.column(c).to_numpy() for c in ("rep", "copies", "dim"))
    number, cell, tile = (table.column(c).to_numpy() for c in ("number", "cell", "own_tile"))
    flat = table.column("code").combine_chunks()
    code = np.frombuffer(b"".join(flat.to_pylist()), np.int32).reshape(n, -1)
    vectors = table.column("vector").combine_chunks().to_pylist()
    count, edges = np.zeros(n, np.int64), []
    kept = np.flatnonzero((sizes > SMALL))
    for g in kept.tolist():
        s, e = int(starts[g]), int(starts[g] + sizes[g])
        x = np.frombuffer(b"".join(vectors[s:e]), np.float64).reshape(e - s, int(dim[s]))
        split = (int(cell[s]) >> 31) != (int(cell[s]) & ((1 << 31) - 1))
        got, found = _bucket_links(x, code[s:e], copies[s:e], tile[s:e], int(number[s]), split, cosine)
        count[s:e] += got
        edges += [(s + a, s + b) for a, b in found]
    small = (sizes > 1) & (sizes <= SMALL)
    rows = np.repeat(small, sizes)
    for d in np.unique(dim[rows]).tolist():
        at = np.flatnonzero(rows & (dim == d))
        x = np.frombuffer(b"".join(vectors[k] for k in at.tolist()), np.float64).reshape(len(at), d)
        group = np.repeat(np.arange(len(starts)), sizes)[at]
        pairs = []
        for s in range(1, SMALL):
            i = np.flatnonzero(group[:-s] == group[s:]) if len(group) > s else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[np.einsum("ij,ij->i", x[i], x[i + s]) >= cosine]
            a, b = at[i], at[i + s]
            good = (code[a] == code[b]).argmax(axis=1) == number[a]
            # a cell of two tiles has only the pairs between them
            good &= ((cell[a] >> 31) == (cell[a] & ((1 << 31) - 1))) | (tile[a] != tile[b])
            a, b = a[good], b[good]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            pairs.append((a, b))
        if pairs:
            a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
            if len(a):
                used, both = np.unique(np.concatenate([a, b]), return_inverse=True)
                edges += [(int(used[p]), int(used[q])) for p, q in forest(len(used), both[: len(a)], both[len(a) :])]
    some = np.flatnonzero(count)
    a, b = (np.array(edges, np.int64).reshape(-1, 2)).T
    kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(a), np.int32)])
    return pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(np.concatenate([rep[some], rep[a]])), pa.array(np.concatenate([count[some], rep[b]]))], names=["kind", "a", "b"]
    )


def near_vectors(
    table: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per row: key, n_links, component_id, kept. Rows link when labels are equal and the cosine is enough.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null label, link with
    nothing. Equal vectors of a label are compared once and count as often as they stand; vectors of different lengths
    never link. component_id is the least key reachable by links, itself included; kept is key = component_id. A null
    key can't name a component: such a row takes part in links and gets the least key of its component. Repeated rows
    count as rows of their own. An empty table gives no rows; other columns are not read. Labels must be integers.
    """
    spark = table.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "embeddings")
    v = F.col("v")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    rows = table.select(column(key).cast("long").alias("id"), column(label).cast("long").alias("label"), column(vector).cast("array<double>").alias("v"))
    sound = v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    good = rows.where("sound").select("*", *(F.xxhash64(F.lit(s), "label", "v").alias(f"h{s}") for s in (1, 2)))
    ids = scratch.save(good.select("id", "h1", "h2"), "ids")
    distinct = good.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    distinct = scratch.save(distinct.withColumn("rep", F.xxhash64("h1", "h2")), "distinct")
    most = distinct.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    tables, bits = shape_of(most, cosine)
    sample = distinct.orderBy("rep").limit(SAMPLE).select("v").toPandas()["v"].tolist()
    projections = _Projections(tables * bits)
    for d in sorted({len(x) for x in sample}):
        x = np.array([s for s in sample if len(s) == d], np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        projections[d] = learn(x / np.linalg.norm(x, axis=1, keepdims=True), tables * bits)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.values.to_numpy()[lists.offsets[0].as_py() :]
            begin = np.cumsum(lengths) - lengths
            raw, code, dim = [b""] * len(lengths), [b""] * len(lengths), lengths.astype(np.int32)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = values[begin[at][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay finite
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                for k, c, u in zip(at.tolist(), codes(x, projections[d], tables, bits), x, strict=True):
                    code[k], raw[k] = c.tobytes(), u.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), batch.column("label"), pa.array(dim), pa.array(code, pa.binary()), pa.array(raw, pa.binary())],
                names=["rep", "copies", "label", "dim", "code", "vector"],
            )

    coded = scratch.save(distinct.select("rep", "copies", "label", "v").mapInArrow(encode, "rep long, copies long, label long, dim int, code binary, vector binary"), "coded")
    # the substring of table t is the t-th little-endian integer of the code
    octet = lambda t, k: F.conv(F.hex(F.substring("code", 4 * t + k + 1, 1)), 16, 10).cast("int")
    slots = [F.struct(F.lit(t).alias("number"), (octet(t, 3) * (1 << 24) + octet(t, 2) * (1 << 16) + octet(t, 1) * 256 + octet(t, 0)).alias("slot")) for t in range(tables)]
    spread = coded.select("*", F.explode(F.array(*slots)).alias("s")).select("*", "s.*").drop("s")
    keys = ["label", "dim", "number", "slot", "cell"]
    cells = tiled(spread, scratch, ["label", "dim", "number", "slot"], "rep", TILE)
    cells = cells.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, keys, 1 << 13):
            yield bucket_table(part, cosine)

    found = scratch.save(cells.select(*keys, "own_tile", "rep", "copies", "code", "vector").mapInArrow(run, "kind int, a long, b long"), "found")
    count = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = component_roots(found.where("kind = 1").select("a", "b"), scratch)
    narrow = distinct.select("rep", "h1", "h2", "copies", "least").join(count, "rep", "left").withColumn("key", F.xxhash64("rep"))
    narrow = scratch.save(narrow.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "narrow")
    least = scratch.save(narrow.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "least")
    known = spread_join(narrow.drop("least"), least, ["root"], "members")
    known = scratch.save(known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"), "known")
    out = spread_join(ids, known, ["h1", "h2"], "copies").select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    out = out.unionByName(alone).select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(column(key) == F.col("component_id"), F.lit(False)))


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
