"""Line dedup by chunks of lines chosen by their words: repeated chunks go, but for their first occurrence.

Logical lines end at a newline or at a full stop, exclamation or question mark before a space, since passages are
also pasted into running lines. At every line begins the shortest chunk that counts, and at every line ends one; a
chunk depends on the lines within it alone. So each line of a repeated run of lines lies in a chunk of that run, from
the run's first line to its last, wherever the run stands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tokenloom.llm._common import Scratch, arrow_batches, numbered, only_remember, place_of, remembers, shuffle_partitions

#: The least chunk, in lines and words; a single line of LONG_WORDS words is one too.
LEAST_LINES, LEAST_WORDS, LONG_WORDS = 2, 10, 20
#: Bits of the filter that tells which chunks may be repeated: sixteen for each, within these bounds. It is sent to all
#: tasks; past the upper bound more chunks pass in vain, which costs time and no result.
FILTER_BITS = (1 << 20, 1 << 26)
#: Bytes of chunks that go into one Arrow batch.
BATCH_BYTES = 4 << 20

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def lines_of(text: str) -> list[str]:
    """Logical lines with what ends them; joined they are the text."""
    mark = next(c for c in map(chr, range(0x110000)) if c not in text)
    for end in ("\n", ". ", "! ", "? "):
        if end in text:
            text = text.replace(end, end + mark)
    lines = text.split(mark)
    return lines if lines[-1] else lines[:-1]


_known: dict[int, np.ndarray] = {}
remembers("linechunks", _known.clear)


def _powers(x: np.uint64, n: int) -> np.ndarray:
    """x to the powers 0 to n at least, modulo 2^64; up to a power of two, those of texts under 65,536 lines are remembered."""
    out = _known.get(int(x))
    if out is None or len(out) <= n:
        out = np.full((1 << max(10, n.bit_length())) + 1, x, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n < 1 << 16:
            _known[int(x)] = out
    return out


class Chunks:
    """The chunks of a text, or of several, none over two: chunk k is lines[low[k]:high[k]]; they overlap.

    Lines and chunks of several texts are numbered on: those of text t are begins[t]:begins[t + 1] and
    first[t]:first[t + 1]. Piece k is lines[starts[k]:ends[k]], one line.
    """

    def __init__(self, *texts: str):
        parts = [*map(lines_of, texts)]
        sizes = np.array([*map(len, parts)], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.lines = [s for p in parts for s in p]
        self.bare = [s.strip() for s in self.lines]
        n = len(self.lines)
        self.starts, self.ends = np.arange(n), np.arange(1, n + 1)
        origin, stop = np.repeat(self.begins[:-1], sizes), np.repeat(self.begins[1:], sizes)
        count = np.array([t.count(" ") + 1 if t else 0 for t in self.bare], np.int64)
        words = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        long = count >= LONG_WORDS
        end = np.maximum(np.searchsorted(words, words[:-1] + LEAST_WORDS), self.starts + LEAST_LINES)
        end = np.where(long, self.ends, end)
        begin = np.minimum(np.searchsorted(words, words[1:] - LEAST_WORDS, "right") - 1, self.ends - LEAST_LINES)
        begin = np.where(long, self.starts, begin)
        pairs = np.concatenate([(self.starts * (n + 1) + end)[end <= stop], (begin * (n + 1) + self.ends)[begin >= origin]])
        self.low, self.high = np.divmod(np.unique(pairs), n + 1)
        self.first = np.searchsorted(self.low, self.begins)

    def counted(self) -> list[int]:
        """Numbers of the chunks, in the order of their places."""
        return list(range(len(self.low)))

    def keys(self) -> np.ndarray:
        """64 bits of each chunk, as signed longs."""
        digest, n = xxhash.xxh64_intdigest, len(self.bare)
        h = np.array([digest(s.encode("utf-8", "surrogatepass")) for s in self.bare], np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_STEP, n)[:n], dtype=np.uint64)])
        out = (sums[self.high] - sums[self.low]) * _powers(_BACK, n)[self.low]
        out = (out ^ (out >> np.uint64(29))) * _MIX
        return (out ^ (out >> np.uint64(32))).view(np.int64)

    def bytes(self, k: int) -> str:
        return "\n".join(self.bare[self.low[k] : self.high[k]])

    def kept(self, gone: Iterable[int]) -> np.ndarray:
        """Whether each line stays when chunks go; of a chunk that overlaps its own first place, what is beyond that."""
        gone = np.unique(np.array(list(gone), np.int64))
        low = self.low[gone]
        if len(set(self.bare)) < len(self.bare):  # else no chunk stands twice in the text
            _, first, which = np.unique(self.keys(), return_index=True, return_inverse=True)
            first = first[which][gone]
            for k in np.flatnonzero((self.high[first] > low) & ~np.isin(first, gone)).tolist():
                if self.bytes(first[k]) == self.bytes(gone[k]):
                    low[k] = self.high[first[k]]
        cover = np.zeros(len(self.lines) + 1, np.int64)
        np.add.at(cover, low, 1)
        np.add.at(cover, self.high[gone], -1)
        return np.cumsum(cover)[:-1] == 0

    def without(self, gone: Iterable[int]) -> str:
        return "".join(s for s, kept in zip(self.lines, self.kept(gone).tolist(), strict=True) if kept)


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Four bits of the filter for each key."""
    a = h.view(np.uint64)
    b = (a * _STEP) | np.uint64(1)
    return (np.stack([(a + np.uint64(k) * b) >> np.uint64(36) for k in range(4)]) % np.uint64(bits)).astype(np.int64)


def _passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all bits of each key are set."""
    at = _places(h, 64 * len(words))
    return ((words[at >> 6] >> (at & 63)) & 1).all(axis=0)


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of h, as 64-bit words; the driver gets a bounded number of them at most."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * keys.count()).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.int64)
        for batch in batches:
            at = _places(batch.column("h").to_numpy(), bits).ravel()
            np.bitwise_or.at(words, at >> 6, np.int64(1) << (at & 63))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    found = keys.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return words


def _some(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a column, in lists of about BATCH_BYTES characters: arrays of many short texts cost as little as of one."""
    held, size = [], 0
    for t in column:
        held.append(t.as_py())
        size += len(held[-1])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _chunk_keys(source: DataFrame) -> DataFrame:
    """(h) of all chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_remember("linechunks")
        for batch in batches:
            for texts in _some(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(Chunks(*texts).keys())], names=["h"])

    return source.select("text").mapInArrow(run, "h long")


def _chunk_rows(source: DataFrame, kind: str, only: np.ndarray) -> DataFrame:
    """(h, key, th, pos, bytes) of the chunks that pass the filter."""
    words = source.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _some(batch.column("text")):
                chunks = Chunks(*texts)
                keys = chunks.keys()
                passed = np.flatnonzero(_passes(words.value, keys))
                row = np.searchsorted(chunks.first, passed, "right") - 1
                pos = passed - chunks.first[row]
                size = np.cumsum([0, *(len(s) + 1 for s in chunks.bare)])
                size = np.cumsum(size[chunks.high[passed]] - size[chunks.low[passed]])
                cuts = np.unique(np.searchsorted(size, np.arange(0, int(size[-1]) if len(size) else 0, BATCH_BYTES), "right")).tolist()
                for a, b in zip([0, *cuts], [*cuts, len(passed)], strict=True):
                    if a < b:
                        at = pa.array(done + row[a:b])
                        text = pa.array([*map(chunks.bytes, passed[a:b].tolist())], pa.string())
                        columns = [pa.array(keys[passed[a:b]]), batch.column("key").take(at), batch.column("th").take(at), pa.array(pos[a:b].astype(np.int32)), text]
                        yield pa.RecordBatch.from_arrays(columns, names=["h", "key", "th", "pos", "bytes"])
                done += len(texts)

    return source.mapInArrow(run, f"h long, key {kind}, th long, pos int, bytes string")


def _hot(keys: DataFrame, most: int) -> dict[int, int]:
    """The keys of more than `most` rows, with their counts. The caller's bound is a share of all rows, so they are few."""
    return {r["h"]: r["count"] for r in keys.where(F.col("count") > most).collect()}


def _deal(rows: DataFrame, hot: dict[int, int], most: int) -> DataFrame:
    """rows with a column `salt`: rows of a hot key are dealt to ceil(count / most) salts by a hash of their place, others have none."""
    if not hot:
        return rows.withColumn("salt", F.lit(0))
    salts = rows.sparkSession.createDataFrame([(h, 1 + n // most) for h, n in hot.items()], "h long, salts int")
    dealt = rows.join(F.broadcast(salts), "h", "left")  # as few rows as hot keys
    return dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key", "th", "pos"), F.col("salts")) + 1, F.lit(0)).cast("int")).drop("salts")


def _firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, th, pos, h, bytes) out of rows sorted by h, salt, key, th, pos: chunks that stand earlier with the same bytes,
    their h and bytes null; and of salted rows the first of each bytes, which have still to meet those of other salts."""
    for batch in _later(batches, ["h", "salt"]):
        first = batch.column("first")
        keep = pc.or_(pc.invert(first), pc.greater(batch.column("salt"), 0))
        batch = batch.filter(keep)
        first = batch.column("first")
        h, text = (pc.if_else(first, batch.column(c), pa.scalar(None, batch.schema.field(c).type)) for c in ("h", "bytes"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "th", "pos")), h, text], names=["key", "th", "pos", "h", "bytes"])


def _later(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with a column `first`: whether no row of the same group and bytes stands earlier. Rows are sorted by the
    group's columns, key, th, pos; one that repeats a place is none of its own and goes.

    Of the rows so far, only the first of the last group is held, and those of its key that have other bytes.
    """
    held, others = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        groups = [table.column(c).to_numpy() for c in by]
        place = [table.column("key").combine_chunks().dictionary_encode("encode").indices.to_numpy(), table.column("th").to_numpy(), table.column("pos").to_numpy()]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([g[1:] != g[:-1] for g in groups])
        again = ~new
        again[1:] &= np.logical_and.reduce([p[1:] == p[:-1] for p in place])  # rows that repeat key and text
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        same = pc.equal(table.column("bytes"), table.column("bytes").take(pa.array(start))).to_numpy(zero_copy_only=False)
        first = new & (np.arange(len(new)) >= (held is not None))
        group_of = lambda k: tuple(int(g[k]) for g in groups)  # noqa: E731, B023
        others = {k: v for k, v in others.items() if k[0] == group_of(0)}
        for k in np.flatnonzero(~same & ~again).tolist():  # keys that agree by chance
            r = (group_of(k), table.column("bytes")[k].as_py())
            at = tuple(table.column(c)[k].as_py() for c in ("key", "th", "pos"))
            first[k] = others.setdefault(r, at) == at
        others = {k: v for k, v in others.items() if k[0] == group_of(-1)}
        keep = ~again
        keep[: int(held is not None)] = False
        held = table.slice(int(start[-1]), 1).to_batches()[0]
        out = table.append_column("first", pa.array(first)).filter(pa.array(keep)).combine_chunks().to_batches()
        yield from out


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with repeated chunks removed from text, plus long columns n_lines, n_removed and cut_from.

    A chunk is two logical lines or more with ten words or more, or one line with twenty. One that stands elsewhere,
    in this document or another, stays where it comes first by (key, hash of text, place) and goes everywhere else,
    once its bytes (white space at the ends of lines apart) equal those of the first. So any run of whole lines that
    is a chunk goes wholly where it stands again, and every line that goes stands earlier in the same chunk. n_lines
    counts logical lines, n_removed those that went, cut_from the least chunks that went, which overlap. A null text
    stays null and counts no lines; null keys come first; rows that repeat key and text are one document and fare
    alike; a document none of whose lines stays has an empty text; an empty table gives no rows; other columns pass
    through, but for ones of those three names, which are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_removed", "cut_from")
    arrow_batches(spark)
    scratch = Scratch(spark, "linechunks")
    rows, names = numbered(docs)
    k, t = place_of(names, key), place_of(names, text)
    kind = rows.schema[k].dataType.simpleString()
    source = rows.select(F.col(k).alias("key"), F.col(t).cast("string").alias("text")).where("text is not null")
    source = source.withColumn("th", F.xxhash64("text"))
    repeated = scratch.save(_chunk_keys(source).groupBy("h").count().where("count > 1"), "repeated")
    n = shuffle_partitions(spark)
    total = repeated.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    most = max(1000, total // (4 * n))
    order = ["h", "salt", "key", "th", "pos"]
    found = _deal(_chunk_rows(source, kind, _filter(repeated.select("h"))), _hot(repeated, most), most)
    found = found.repartition(n, "h", "salt").sortWithinPartitions(*order).select(*order, "bytes")
    first = scratch.save(found.mapInArrow(_firsts, f"key {kind}, th long, pos int, h long, bytes string"), "first")
    # of the salts' firsts all go but the first of each bytes; a place has one chunk, and there are as many as hot keys
    place = ["key", "th", "pos"]
    others = first.where("h is not null")
    stays = others.groupBy("h", "bytes").agg(F.min(F.struct(*place)).alias("p")).select(*(F.col(f"p.{c}").alias(f"first_{c}") for c in place))
    same = F.lit(True)
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    others = others.select(*place).join(F.broadcast(stays), same, "left_anti")
    gone = first.where("h is null").select(*place).unionByName(others)
    gone = gone.groupBy("key", "th").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("key").alias("gone_key"), F.col("th").alias("gone_th"), "gone").hint("merge")  # one plan at every size; what is gone grows with the corpus
    marked = rows.withColumn("th", F.xxhash64(F.col(t).cast("string")))
    marked = marked.join(gone, F.col(k).eqNullSafe(F.col("gone_key")) & (F.col("th") == F.col("gone_th")), "left")
    at = names.index(text)
    marked = marked.select(*(F.col(c).cast("string") if c == t else F.col(c) for c in rows.columns), "gone")
    out = StructType([*marked.drop("gone").schema.fields, *(StructField(c, LongType()) for c in ("n_lines", "n_removed", "cut_from"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_remember("linechunks")
        for batch in batches:
            texts, n_lines, n_removed, cut = [], [], [], []
            for t, g in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if not t or not g:
                    texts.append(t)
                    n_lines.append(len(lines_of(t)) if t else 0)
                    n_removed.append(0)
                    cut.append(0)
                    continue
                chunks = Chunks(t)
                kept = chunks.kept(g)
                texts.append("".join(s for s, stays in zip(chunks.lines, kept.tolist(), strict=True) if stays))
                n_lines.append(len(chunks.lines))
                n_removed.append(int((~kept).sum()))
                cut.append(len(g))
            arrays = [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in (n_lines, n_removed, cut))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_lines", "n_removed", "cut_from"])

    return marked.mapInArrow(run, out).toDF(*names, "n_lines", "n_removed", "cut_from")


def op9_line_chunks(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "cut_from", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
