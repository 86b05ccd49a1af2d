"""SimHash near-duplicates: fingerprints of three-word shingles, bit-sliced comparison, components of links."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import (
    Merger, Scratch, arrow_batches, column, forest, group_starts, numbered, only_remember, per_text, place_of, shuffle_partitions, spread_join, tiled, whole_groups,
)
from tokenloom.llm.components import component_roots
from tokenloom.llm.sketches import shingle_hashes

SHINGLE, SEED, RADIUS = 3, 42, 3
#: The 64 bits fall into these blocks; two fingerprints at distance 3 or less agree on two of the five at least.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of one tile of a large bucket; a cell compares two tiles at most.
TILE = 4096
#: Buckets over this size are compared as a matrix, others by shifts over many buckets at once.
SMALL = 48

_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    n = len(hashes)
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 255):  # sums of 255 bits fit a byte
        ones += np.add.reduce(np.unpackbits(octets[k : k + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and `fp` long (the fingerprint's bits, signed) for every row; a null text counts as empty."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return per_text(docs, text, list(keep), "fp long", make)


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes (bits, words) of fingerprints (rows, 64-bit words): bit i of plane b is bit b of row i; a spare word ends each."""
    n, w = fp.shape
    out = np.zeros((64 * w, (n + 63) // 64 + 1), np.uint64)
    for k in range(w):
        bits = np.unpackbits(np.ascontiguousarray(fp[:, k]).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        out[64 * k : 64 * k + 64].view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def _save_carry(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the carry of three bits in every lane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


class _Counter:
    """Bit-sliced counters of differing bits, one lane per pair, fed eight planes at a time by carry-save adders."""

    def __init__(self, shape: tuple[int, ...], bits: int):
        self.digits = [np.zeros(shape, np.uint64) for _ in range(bits.bit_length())]

    def add(self, d: list[np.ndarray]) -> None:
        c = self.digits
        one, a = _save_carry(c[0], d[0], d[1])
        one, b = _save_carry(one, d[2], d[3])
        two, e = _save_carry(c[1], a, b)
        one, a = _save_carry(one, d[4], d[5])
        c[0], b = _save_carry(one, d[6], d[7])
        c[1], f = _save_carry(two, a, b)
        c[2], carry = _save_carry(c[2], e, f)
        for k in range(3, len(c)):
            c[k], carry = c[k] ^ carry, c[k] & carry

    def within(self, radius: int) -> np.ndarray:
        """Lanes whose count so far is at most radius."""
        less, equal = np.zeros_like(self.digits[0]), ~np.zeros_like(self.digits[0])
        for k in range(len(self.digits) - 1, -1, -1):
            if radius >> k & 1:
                less |= equal & ~self.digits[k]
                equal &= self.digits[k]
            else:
                equal &= ~self.digits[k]
        return less | equal

    def take(self, keep: np.ndarray) -> None:
        self.digits = [d[keep] for d in self.digits]


def _lanes(words: np.ndarray) -> np.ndarray:
    """Bits of words as booleans along the last axis."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little").view(bool)


def _by_shift(fp: np.ndarray, left: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, i + s) of one bucket within radius; left[i]: rows of i's bucket after i."""
    planes, n = _planes(fp), len(fp)
    bits, words = len(planes), planes.shape[1] - 1
    for s in range(1, int(left.max(initial=0)) + 1):
        mask = np.zeros(words * 64, bool)
        mask[:n] = left >= s
        mask = np.packbits(mask, bitorder="little").view(np.uint64)
        at = np.flatnonzero(mask)
        live, q, r = mask[at], s >> 6, np.uint64(s & 63)
        count = _Counter(at.shape, bits)
        for b in range(0, bits, 8):
            own, low = planes[b : b + 8, at], planes[b : b + 8, at + q] >> r
            if r:
                low |= planes[b : b + 8, np.minimum(at + q + 1, words)] << (np.uint64(64) - r)
            count.add(list(own ^ low))
            if b % (bits // 4) == bits // 4 - 8:  # abandon the words in which all lanes exceed the radius
                keep = (live & count.within(radius)) != 0
                if not keep.all():
                    at, live = at[keep], live[keep]
                    count.take(keep)
                    if not len(at):
                        break
        if len(at):
            hit = count.within(radius) & live
            k, lane = np.nonzero(_lanes(hit).reshape(len(at), 64))
            i = at[k] * 64 + lane
            yield i, i + s


def _by_matrix(fp: np.ndarray, radius: int, rows: int = 128) -> list[tuple[int, int]]:
    """Spanning forest of one large bucket: each block of rows against all rows at once."""
    planes, n = _planes(fp)[:, :-1], len(fp)
    bits, merger = len(planes), Merger(n)
    own = np.uint64(0) - np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(np.uint64)
    for k in range(0, n, rows):
        at = np.arange(k, min(n, k + rows))
        count = _Counter((len(at), planes.shape[1]), bits)
        for b in range(0, bits, 8):
            count.add([planes[b + j][None, :] ^ own[at, b + j][:, None] for j in range(8)])
            if b % (bits // 4) == bits // 4 - 8:
                keep = count.within(radius).any(axis=1)
                if not keep.all():
                    at = at[keep]
                    count.take(keep)
                    if not len(at):
                        break
        if len(at):
            for row, lanes in zip(at.tolist(), _lanes(count.within(radius)), strict=True):
                linked = np.flatnonzero(lanes[:n])
                merger.add(row, linked[linked < row])
    return merger.edges


def bucket_links(fp: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (positions in fp) that connect what is linked within each bucket; buckets begin at starts."""
    if fp.ndim == 1:
        fp = fp.view(np.uint64)[:, None]
    n = len(fp)
    sizes = np.diff(np.append(starts, n))
    out: list[tuple[int, int]] = []
    for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        out += [(s + a, s + b) for a, b in _by_matrix(fp[s : s + size], radius)]
    small = (sizes > 1) & (sizes <= SMALL)
    if small.any():
        at = np.repeat(small, sizes).nonzero()[0]
        kept = sizes[small]
        ends = np.repeat(np.cumsum(kept), kept)
        pairs = list(_by_shift(fp[at], ends - 1 - np.arange(len(at)), radius))
        if pairs:
            edges = forest(len(at), *(np.concatenate(x) for x in zip(*pairs, strict=True)))
            out += [(int(at[a]), int(at[b])) for a, b in edges]
    return out


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b long): edges among distinct fingerprints (column fp) which connect all that differ in radius bits or fewer.

    Each fingerprint goes to ten buckets, one for each two of the five blocks; a bucket's rows agree on two blocks.
    Large buckets are dealt out in cells of two tiles. A task gives a spanning forest of each cell, not its pairs.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the blocks find distances of 3 or less")
    spark = distinct.sparkSession

    def block(k: int):
        low, width = BLOCKS[k]
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    keys = [
        F.lit(t << 40).cast("long") + F.shiftleft(block(i), 20) + block(j)
        for t, (i, j) in enumerate(combinations(range(5), 2))
    ]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    rows = tiled(rows, scratch, ["bucket"], "fp", TILE).select("bucket", "cell", "fp")
    n = shuffle_partitions(spark)
    rows = rows.repartition(n, "bucket", "cell").sortWithinPartitions("bucket", "cell")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "cell"]):
            fp = table.column("fp").to_numpy()
            edges = bucket_links(fp, group_starts(table, ["bucket", "cell"]), radius)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: key, fp long, component_id (the least key reachable by links, itself included).

    Fingerprints link at `radius` differing bits or fewer; equal ones always. Rows are compared as distinct
    fingerprints with their least key, so a group of copies costs one row. A null key takes part and gets the least
    key of its component (null if there is none); repeated rows give repeated rows; an empty table gives no rows;
    columns other than text and key are not read. Texts without words share the fingerprint zero and link.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "simhash")
    fps = scratch.save(fingerprints(docs.select(column(key).alias("__key"), column(text).alias("__t")), "__t", ("__key",)), "fps")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("__key").alias("least"), F.count("*").alias("n")), "distinct")
    edges = scratch.save(links(distinct, scratch, radius), "links")
    known = scratch.save(_components(distinct, "fp", edges, scratch), "known")
    return spread_join(fps, known, ["fp"], "n").select(F.col("__key").alias(key), "fp", F.col("least").alias("component_id"))


# -- longer fingerprints for a similarity -----------------------------------------------------------------------------

#: Words of a shingle, bits, and the likeness (Jaccard, of shingles) at which documents count as near-duplicates.
WIDE_SHINGLE, WIDE_BITS, SIMILARITY = 5, 256, 0.8


def wide_radius(similarity: float) -> int:
    """Differing bits up to which documents are compared: those expected at a similarity, and 2.25 standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(WIDE_BITS * p + 2.25 * math.sqrt(WIDE_BITS * p * (1 - p)))


def wide_fingerprint(text: str) -> bytes:
    """A 256-bit SimHash of five-word shingles, ASCII letters lower-cased; zeros for a text without words."""
    return _wide(shingle_hashes(text, WIDE_SHINGLE))


def _wide(h: np.ndarray) -> bytes:
    """The fingerprint of shingle hashes, repeats included."""
    if not len(h):
        return bytes(WIDE_BITS // 8)
    ones = np.zeros(WIDE_BITS, np.int64)
    for k in range(0, len(h), 255):
        part = h[k : k + 255, None] * _SPREAD
        part ^= part >> np.uint64(31)
        part *= _SPREAD[::-1]
        part ^= part >> np.uint64(29)
        octets = part.view(np.uint8).reshape(len(part), WIDE_BITS // 8)
        ones += np.add.reduce(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def wide_buckets(fp: np.ndarray) -> np.ndarray:
    """64 keys of each fingerprint (rows, 4 words): its sixteen 16-bit words, and those made of one bit of each, by three slopes."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little").reshape(len(fp), 16, 16)
    word, place = np.arange(16), np.arange(16)[:, None]
    both = np.concatenate([bits, *(bits[:, word, (place + slope * word) % 16] for slope in (0, 1, 3))], axis=1)
    return np.packbits(both, axis=2, bitorder="little").view(np.uint16)[:, :, 0].astype(np.int32) + (np.arange(64, dtype=np.int32) << 16)


def _set(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, WIDE_SHINGLE))


def _node(shingles: np.ndarray) -> int:
    """The number that stands for a set of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes())


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard likeness of two sorted sets is at least similarity, exactly; two empty sets are alike."""
    least = Fraction(str(similarity))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= (len(a) + len(b) - both) * least.numerator


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE_BITS // 64)


def _dealt(rows: DataFrame, member: str, scratch: Scratch) -> DataFrame:
    """rows, each in the cells of its 64 buckets, sorted by them."""
    columns = rows.columns

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = wide_buckets(_matrix(batch.column("fp")))
            row = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(batch.column(c).take(row) for c in columns)], names=["bucket", *columns])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = tiled(rows.mapInArrow(deal, f"bucket int, {kinds}"), scratch, ["bucket"], member, TILE).select("bucket", "cell", *columns)
    return found.repartition(shuffle_partitions(rows.sparkSession), "bucket", "cell").sortWithinPartitions("bucket", "cell")


def _close_pairs(fp: np.ndarray, label: np.ndarray, radius: int, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a bucket within radius whose labels differ."""
    for k in range(0, len(fp), rows):
        i, j = np.nonzero(label[k : k + rows, None] != label[None, :])
        i += k
        i, j = i[i < j], j[i < j]
        near = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= radius
        yield i[near], j[near]


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are alike."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = [alike(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), similarity) for s, t in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: A text without words: it has no shingle and is like no other.
_WORD = "[^ \\t-\\r]"


def _similar(source: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, th, text), all with words: rows (key, th, node), and (node, least, n) for each node of the graph.

    least: the least (whether the key is null, key, th) of all that links reach; n: rows of the node.
    """
    spark = source.sparkSession
    scratch = Scratch(spark, "similar")
    radius = wide_radius(similarity)

    def prints(texts: list[str]) -> list[list]:
        found, nodes = [], []
        for t in texts:
            h = shingle_hashes(t, WIDE_SHINGLE)
            found.append(_wide(h))
            nodes.append(_node(np.unique(h)))
        return [found, np.array(nodes, np.uint64).view(np.int64)]

    def fresh():
        only_remember("sketches")
        return prints

    fps = scratch.save(per_text(source, "text", ["key", "th"], "fp binary, node long", fresh), "fps")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "th")
    distinct = scratch.save(fps.groupBy("node").agg(F.min(order).alias("least"), F.min("fp").alias("fp"), F.count("*").alias("n")), "distinct")

    def forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "cell"], 1 << 15):
            column = table.column("fp").combine_chunks()
            edges = bucket_links(_matrix(column), group_starts(table, ["bucket", "cell"]), radius)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([column.take(pa.array(a)), column.take(pa.array(b))], names=["a", "b"])

    prints_alone = distinct.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n"))
    loose = _dealt(prints_alone.select("fp"), "fp", scratch).mapInArrow(forests, "a binary, b binary")
    loose = scratch.save(loose.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "loose")
    close = loose.select(F.explode(F.array("a", "b")).alias("fp")).union(prints_alone.where("n > 1").select("fp")).distinct()
    near = scratch.save(distinct.join(close, "fp"), "near")

    def shingles(texts: list[str]) -> list[list]:
        found = [_set(t) for t in texts]
        return [np.array([_node(s) for s in found], np.uint64).view(np.int64), [s.tobytes() for s in found]]

    asked = near.select(F.col("least.key").alias("k"), F.col("least.th").alias("h"))
    texts = source.join(asked, F.col("key").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h")), "left_semi")
    sets = scratch.save(per_text(texts, "text", [], "node long, shingles binary", lambda: shingles).dropDuplicates(["node"]), "sets")

    one = near.groupBy("fp").agg(F.min("node").alias("node"))
    first = loose.join(one.select(F.col("fp").alias("a"), F.col("node").alias("u")), "a").join(one.select(F.col("fp").alias("b"), F.col("node").alias("v")), "b")
    first = scratch.save(_verified(first.select(F.col("u").alias("a"), F.col("v").alias("b")), sets, similarity), "first")
    roots = component_roots(first, Scratch(spark, "similar-first"))
    label = near.withColumn("hash", F.xxhash64("node")).join(roots.withColumnRenamed("key", "hash"), "hash", "left").select("node", "fp", F.coalesce("root", "hash").alias("label"))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "cell"], 1 << 15):
            fp, node, label = _matrix(table.column("fp")), table.column("node").to_numpy(), table.column("label").to_numpy()
            at = np.append(group_starts(table, ["bucket", "cell"]), len(fp))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                for i, j in _close_pairs(fp[s:e], label[s:e], radius):
                    a, b = node[s + i], node[s + j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    rest = scratch.save(_dealt(scratch.save(label, "labels"), "node", scratch).mapInArrow(pairs, "a long, b long").distinct(), "rest")
    second = scratch.save(_verified(rest, sets, similarity), "second")
    known = _components(distinct.drop("fp"), "node", first.union(second), scratch)
    return fps.select("key", "th", "node"), scratch.save(known, "known")


def _source(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, th, text) with words, and those without."""
    rows = docs.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("th"), "text")
    worded = F.col("text").rlike(_WORD)
    return rows.where(worded), rows.where(~worded)


def similar_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: key and component_id, the least key reachable by links of near-duplicates.

    Documents link when the Jaccard likeness of their sets of five-word shingles is at least similarity, computed from
    the whole sets. Pairs to compute it for are those whose 256-bit fingerprints differ in wide_radius(similarity)
    bits or fewer and agree in one of 64 tables of 16 bits: at a likeness of 0.8 two documents do with probability
    0.98, above it more surely. First a forest of such pairs is verified; then all the others between the components so found, so that a
    group of copies costs a forest a bucket; pairs in the radius but below the likeness are all compared. Nodes of the
    graph are 64-bit hashes of sets; equal sets are one node. A text without words (null, empty, white space) links
    with nothing and names its own component; other nulls, repeated rows and empty tables are treated as in
    near_duplicates.
    """
    arrow_batches(docs.sparkSession)
    worded, bare = _source(docs, text, key)
    rows, known = _similar(worded, similarity)
    found = spread_join(rows, known, ["node"], "n").select("key", F.col("least.key").alias("component_id"))
    return found.unionByName(bare.select("key", F.col("key").alias("component_id"))).toDF(key, "component_id")


def _components(distinct: DataFrame, node: str, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, least, n) with the least `least` of all nodes that edges reach, for nodes with their own and their n rows."""
    roots = component_roots(edges, scratch)
    linked = distinct.withColumn("key", F.xxhash64(node)).join(roots, "key").select(node, "root", "least")
    linked = scratch.save(linked, "linked")
    least = scratch.save(linked.groupBy("root").agg(F.min("least").alias("moved"), F.count("*").alias("members")), "least")
    moved = spread_join(linked.select(node, "root"), least, ["root"], "members").select(node, "moved")
    return distinct.join(moved, node, "left").select(node, F.coalesce("moved", "least").alias("least"), "n")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their group of near-duplicates: the one with the least key, and of several texts
    under one key the one with the least hash.

    A document is a key and a text: unlike texts under one key are judged apart, and rows that repeat both are one
    document, of which one row stays. A null key comes after all others. Texts without words are like no other: all
    their rows stay. All columns pass through, whatever their names; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    rows, names = numbered(docs)
    k, t = place_of(names, key), place_of(names, text)
    worded, _ = _source(rows, t, k)
    _, known = _similar(worded, similarity)
    kept = known.select(F.col("least.key").alias("kept"), F.col("least.th").alias("kept_th")).distinct()
    rows = rows.withColumn("th", F.xxhash64(F.coalesce(F.col(t).cast("string"), F.lit(""))))
    has_word = F.coalesce(F.col(t).cast("string").rlike(_WORD), F.lit(False))
    found = rows.where(has_word).join(kept, F.col(k).eqNullSafe(F.col("kept")) & (F.col("th") == F.col("kept_th")), "left_semi")
    return found.dropDuplicates([k, "th"]).unionByName(rows.where(~has_word)).drop("th").toDF(*names)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
