"""Document fingerprints: every shingle hash below a fixed fraction is kept (a threshold-scaled sketch).

Sketches of any two texts are cut at the same threshold, so they can be merged by union, and the containment of a
short text in a long one is estimated as well as that of equals. A text of few shingles can have none below the
threshold; so beside its sketch a fingerprint holds a hash of the text's whole sequence of words, by which equal texts
are alike whatever their sketches hold.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import arrow_batches, column, only_remember, remembers, shuffle_partitions

#: Words of a shingle, and one in so many hashes is kept: at 60 words a likeness is off by 0.08 (root mean square).
SHINGLE, SCALE = 5, 2
#: Words whose hashes a worker remembers.
REMEMBERED = 250_000
#: Bytes of fingerprints that go into one Arrow batch.
BATCH_BYTES = 8 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_words = _WordHashes()
remembers("sketches", _words.clear)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles of whole words, ASCII letters lower-cased; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(h))):
        out = out * _STEP + h[k : k + n]
    out ^= out >> np.uint64(30)
    out *= _MIX_A
    out ^= out >> np.uint64(27)
    out *= _MIX_B
    return out ^ (out >> np.uint64(31))


def sketch(text: str, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes below 2^64 / scale."""
    h = shingle_hashes(text)
    return np.unique(h[h < np.uint64(2**64 // scale)])


def whole(text: str) -> int:
    """A hash of all words in order, ASCII letters lower-cased; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return xxhash.xxh64_intdigest(b" ".join(words)) if words else 0


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles."""
    return np.union1d(a, b)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; of an empty sketch nothing is known to be."""
    return _shared(a, b) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two sketches; 0 for two empty ones, of which nothing is known."""
    same = _shared(a, b)
    union = len(a) + len(b) - same
    return same / union if union else 0.0


class Fingerprint:
    """A text's sketch and the hash of all its words."""

    def __init__(self, text: str, scale: int = SCALE):
        self.whole, self.sketch = whole(text), sketch(text, scale)

    def likeness(self, other: Fingerprint) -> float:
        """1 for texts of the same words, else what the sketches tell."""
        return 1.0 if self.whole == other.whole else likeness(self.sketch, other.sketch)

    def containment(self, other: Fingerprint) -> float:
        return 1.0 if self.whole == other.whole else containment(self.sketch, other.sketch)

    def __str__(self) -> str:
        return to_string(np.concatenate([np.array([self.whole], np.uint64), self.sketch]))


def to_string(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    """The numbers of a string: of a fingerprint the hash of all words, then the sketch."""
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first characters of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(rows: DataFrame, n: int) -> Column:
    """A column that gives each row's range by (key, h) among n of about equal numbers of rows.

    Cuts come from distinct (key, h) that a hash chooses, some twenty for each range: so many the driver gets.
    """
    place = F.struct(F.col("key"), F.col("h"))
    total = rows.count()
    every = max(1, total // (20 * n))
    found = rows.where(F.pmod(F.xxhash64("key", "h"), F.lit(every)) == 0).select("key", "h").distinct()
    found = found.orderBy(F.col("key").asc_nulls_first(), "h").collect()
    cuts = [found[k * len(found) // n] for k in range(1, n)] if found else []
    cuts = list(dict.fromkeys((c["key"], c["h"]) for c in cuts))
    if not cuts:
        return F.lit(0)
    kind = rows.schema["key"].dataType
    cut = lambda c: F.struct(F.lit(c[0]).cast(kind).alias("key"), F.lit(c[1]).cast("long").alias("h"))
    blocks = [cuts[k : k + 64] for k in range(0, len(cuts), 64)]
    reached = lambda which: F.size(F.filter(which, lambda x: x <= place))
    block = reached(F.array(*(cut(b[0]) for b in blocks)))
    within = reached(F.element_at(F.array(*(F.array(*map(cut, b)) for b in blocks)), F.greatest(block, F.lit(1))))
    return F.when(block == 0, 0).otherwise((block - 1) * 64 + within)


def with_following(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's key and text, dealt to ranges of (key, hash of text) and sorted; the first row after each range comes with it.

    Columns target int (the range), after boolean, key, text. Within a target, each row is followed by the next in
    order of (key, hash of text), nulls first; rows with `after` only follow. The last row of all is followed by the
    first. Keys of any type that has an order will do. The driver gets one row per range.
    """
    spark = docs.sparkSession
    source = docs.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("h", F.xxhash64("text"))
    n = 4 * shuffle_partitions(spark)
    source = source.withColumn("range", _ranges(source.select("key", "h"), n))
    lead = source.groupBy("range").agg(F.min(F.struct("key", "h")).alias("first")).orderBy("range").collect()
    kind = source.schema["key"].dataType.simpleString()
    firsts = [(r["range"], r["first"]["key"], r["first"]["h"], lead[k - 1]["range"]) for k, r in enumerate(lead)]
    first = spark.createDataFrame(firsts, f"range int, first_key {kind}, first_h long, before int")
    rows = source.join(F.broadcast(first), "range")  # one row per range
    leads = F.col("key").eqNullSafe(F.col("first_key")) & (F.col("h") == F.col("first_h"))
    own = F.struct(F.col("range").alias("target"), F.lit(False).alias("after"))
    ahead = F.struct(F.col("before").alias("target"), F.lit(True).alias("after"))
    rows = rows.withColumn("to", F.explode(F.when(leads, F.array(own, ahead)).otherwise(F.array(own))))
    rows = rows.select("to.target", "to.after", "key", "h", "text").repartition(shuffle_partitions(spark), "target")
    return rows.sortWithinPartitions("target", "after", F.col("key").asc_nulls_first(), "h", "text").drop("h")


def fingerprint_table(docs: DataFrame, text: str = "text", key: str = "doc_id", scale: int = SCALE) -> DataFrame:
    """One row per row of docs: its fingerprint, that of its edited text, and how alike they are.

    A document's next is the one with the next greater key, after the last the first; a lone document follows itself.
    Repeated keys stand in order of their texts' hashes, null keys before all others. A null text counts as empty:
    texts without words are alike to each other only. An empty table gives no rows; other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    rows = with_following(docs, text, key)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_remember("sketches")
        held = None  # (target, key, text, fingerprint) of the row that waits for the next
        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
        out: list[tuple] = []

        def batch_of(key_type) -> pa.RecordBatch:
            first, *rest = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(first, key_type), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names=names)

        for batch in batches:
            key_type, size = batch.schema.field("key").type, 0
            for target, after, k, t in zip(*(batch.column(c).to_pylist() for c in ("target", "after", "key", "text")), strict=True):
                mine = Fingerprint(t, scale)
                if held and held[0] == target:
                    _, k0, t0, own = held
                    e = edited(t0, t)
                    new = Fingerprint(e, scale)
                    digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((k0, len(t0), digest, str(own), str(new), own.likeness(new), own.likeness(mine), own.containment(new), own.containment(mine)))
                    size += len(out[-1][3]) + len(out[-1][4])
                    if size >= BATCH_BYTES:
                        yield batch_of(key_type)
                        size = 0
                held = None if after else (target, k, t, mine)
            if out:
                yield batch_of(key_type)

    return rows.mapInArrow(
        run,
        f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, contained_edited double, contained_next double",
    )


def op8_sketch(spark, sf_dir: str) -> DataFrame:
    return fingerprint_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
