"""Token ids in a grammar-compressed file format: Re-Pair per shard, with random access to each document.

A shard is a byte string, all numbers little-endian:

    magic   b"TLRP1"
    u32 x 5 documents, terminals (ids below it are tokens), rules, symbols, tokens
    then four blocks, each u32 raw length, u32 packed length, Zstandard bytes:
      rules    (left, right) u32 pairs; rule k makes the nonterminal terminals + k
      lengths  u32 tokens that each rule expands to
      ends     u32 symbols of each document and all before it
      symbols  u32 each

A pair never spans two documents, so that the symbols of a document expand to its ids and no others. Document d is
symbols ends[d-1]:ends[d]; with the expansion lengths token i of it is found without expanding what lies before.
Shards are held as binary values of a table: any store that Spark reads and writes keeps them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import Scratch, arrow_batches, column, only_remember, shuffle_partitions
from tokenloom.llm.vocab import encoder, public_file

MAGIC, END_ID = b"TLRP1", 1
#: A shard closes once it has so many tokens.
SHARD_TOKENS = 1 << 19
#: A pair is replaced from so many places on, and so many pairs at most in a round: beyond that a packed shard grows
#: again. Scans over all places; after each come rounds beside the newest nonterminals, until one takes less than one
#: symbol in SMALL.
LEAST, PAIRS, SCANS, SMALL = 8, 4096, 1, 1000
_LEFT, _RIGHT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def compress(seq: np.ndarray, terminals: int, ends_document: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, rules). Each round replaces the most frequent pairs by new nonterminals.

    Pairs are counted by a hash, another one each round; of the pairs that share a slot one is replaced. After a round
    over all places come rounds over those beside the newest nonterminals. Where chosen pairs overlap, those at even
    places of the run are taken, from the left. A pair whose left symbol ends with the id `ends_document` is never
    taken. What is left unreplaced costs size only: the symbols expand to the same ids.
    """
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = terminals
    closes = np.zeros(terminals, bool)
    if ends_document is not None:
        closes[ends_document] = True
    scans, turn, newest = 0, 0, None
    while len(seq) >= 2 * LEAST:
        if newest is None:
            if scans == SCANS:
                break
            scans += 1
            where = np.arange(len(seq) - 1)
        else:
            beside = np.zeros(len(seq) + 1, bool)
            at = np.flatnonzero(seq >= newest)
            beside[at] = beside[at + 1] = True  # place k + 1 for the pair that begins at k
            where = np.flatnonzero(beside[1:-1])
        left, right = seq[where], seq[where + 1]
        turn += 1
        bits = min(18, max(10, len(where).bit_length() + 2))
        at = ((left * _LEFT + right * (_RIGHT + np.uint32(2 * turn))) >> np.uint32(32 - bits)).astype(np.intp)
        count = np.bincount(at, minlength=1 << bits)
        top = np.flatnonzero(count >= LEAST)
        if len(top) > PAIRS:
            top = top[np.argpartition(count[top], -PAIRS)[-PAIRS:]]
        number = np.full(1 << bits, -1, np.int32)
        number[top] = np.arange(len(top))
        slot = number[at]
        kept = np.flatnonzero((slot >= 0) & ~closes[left])
        where, slot, left, right = where[kept], slot[kept], left[kept], right[kept]
        first = np.zeros(len(top), np.int64)
        first[slot[::-1]] = np.arange(len(slot))[::-1]  # the first place of each slot gives its pair
        pair = first[slot]
        kept = np.flatnonzero((left == left[pair]) & (right == right[pair]))
        where, slot = where[kept], slot[kept]
        start = np.ones(len(where), bool)
        start[1:] = where[1:] != where[:-1] + 1
        place = np.arange(len(where), dtype=np.int32)
        even = (place - np.maximum.accumulate(np.where(start, place, 0))) & 1 == 0
        where, slot = where[even], slot[even]
        often = np.bincount(slot, minlength=len(top))
        good = often >= LEAST
        if not good.any():
            newest = None
            continue
        kept = good[slot]
        where, slot = where[kept], slot[kept]
        symbol = (np.cumsum(good) - 1).astype(np.uint32)
        chosen = first[np.flatnonzero(good)]
        new = np.stack([left[chosen], right[chosen]], axis=1)
        rules.append(new)
        closes = np.concatenate([closes, closes[new[:, 1]]])
        seq[where] = symbol[slot] + np.uint32(made)
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        newest = made if len(where) >= len(seq) // SMALL else None
        seq, made = seq[keep], made + len(new)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def sizes(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Tokens that each symbol expands to."""
    out = np.ones(terminals + len(rules), np.int64)
    k = 0
    while k < len(rules):  # as far as rules use known symbols; those of one round use symbols of earlier rounds
        known = (rules[k:] < terminals + k).all(axis=1)
        n = len(known) if known.all() else int(np.argmin(known))
        out[terminals + k : terminals + k + n] = out[rules[k : k + n]].sum(axis=1)
        k += n
    return out


class Grammar:
    """Rules with their expansions: `size` and the place in `flat` of what each symbol stands for."""

    def __init__(self, rules: np.ndarray, terminals: int):
        self.size, self.at, self.flat = np.ones(terminals, np.int64), np.arange(terminals), np.arange(terminals, dtype="<u4")
        k = 0
        while k < len(rules):  # as far as rules use known symbols; those of one round use symbols of earlier rounds
            known = (rules[k:] < terminals + k).all(axis=1)
            n = len(known) if known.all() else int(np.argmin(known))
            block = rules[k : k + n]
            size = self.size[block[:, 0]] + self.size[block[:, 1]]
            text = self.expand(block.ravel())
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, text])
            k += n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        past = np.cumsum(size)
        return self.flat[np.repeat(self.at[symbols] - past + size, size) + np.arange(past[-1] if len(past) else 0)]


def write_shard(documents: list[bytes], terminals: int, end_id: int = END_ID) -> bytes:
    """A shard of documents given as little-endian 32-bit ids, each with the end id last and nowhere else."""
    seq = np.frombuffer(b"".join(documents), "<u4")
    symbols, rules = compress(seq, terminals, end_id)
    size = sizes(rules, terminals)
    tokens = np.cumsum([len(d) // 4 for d in documents])
    ends = np.searchsorted(np.cumsum(size[symbols]), tokens) + 1
    head = MAGIC + struct.pack("<5I", len(documents), terminals, len(rules), len(symbols), len(seq))
    packer = zstandard.ZstdCompressor(level=1)
    for block in (rules, size[terminals:], ends, symbols):
        raw = np.ascontiguousarray(block).astype("<u4").tobytes()
        packed = packer.compress(raw)
        head += struct.pack("<2I", len(raw), len(packed)) + packed
    return head


class Shard:
    """A shard read back; documents and ranges of tokens are decoded one by one or all together."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard")
        at = len(MAGIC) + 20
        self.documents, self.terminals, n_rules, n_symbols, self.tokens = struct.unpack_from("<5I", data, len(MAGIC))
        blocks, unpacker = [], zstandard.ZstdDecompressor()
        for _ in range(4):
            raw, packed = struct.unpack_from("<2I", data, at)
            block = unpacker.decompress(data[at + 8 : at + 8 + packed], max_output_size=max(1, raw))
            if len(block) != raw:
                raise ValueError("a block of the shard is damaged")
            blocks.append(np.frombuffer(block, "<u4"))
            at += 8 + packed
        self.rules = blocks[0].reshape(n_rules, 2)
        self.ends, self.symbols = blocks[2].astype(np.int64), blocks[3]
        self.grammar = Grammar(self.rules, self.terminals)
        if len(self.symbols) != n_symbols or (self.grammar.size[self.terminals :] != blocks[1]).any():
            raise ValueError("a block of the shard is damaged")

    def document(self, d: int) -> np.ndarray:
        return self.grammar.expand(self.symbols[self.ends[d - 1] if d else 0 : self.ends[d]])

    def range(self, d: int, start: int, stop: int) -> np.ndarray:
        """Tokens start:stop of document d; only the symbols that they lie in are expanded."""
        part = self.symbols[self.ends[d - 1] if d else 0 : self.ends[d]]
        past = np.cumsum(self.grammar.size[part])
        stop = min(stop, int(past[-1]) if len(past) else 0)
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = int(np.searchsorted(past, start, "right")), int(np.searchsorted(past, stop, "left")) + 1
        base = int(past[a - 1]) if a else 0
        return self.grammar.expand(part[a:b])[start - base : stop - base]

    def all(self) -> list[np.ndarray]:
        flat = self.grammar.expand(self.symbols)
        past = np.cumsum(self.grammar.size[self.symbols])[self.ends - 1]
        return np.split(flat, past[:-1])


def write_table(
    docs: DataFrame, path: str, tokenizer: str | None = None, spaced: bool = False, end_id: int = END_ID, terminals: int = 1 << 16,
    text: str = "text", key: str = "doc_id",
) -> None:
    """Encode whole texts and write them as shards under path, in ascending order of key.

    Columns: part int and shard int (their order is the documents' order), first long (tokens of the part before this
    shard), tokens long, keys array, data binary (the shard). Texts are dealt by ranges of the key and their hash, and
    sorted; nulls come first, repeated keys stand together, and an empty table gives no shards. A part is one range of the sort.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    tokenizer = tokenizer or public_file("word_bpe_49k.json")
    n = shuffle_partitions(spark)
    source = docs.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    source = source.withColumn("h", F.xxhash64("text"))  # a key of many texts, or none, is dealt out by them
    source = source.repartitionByRange(n, F.col("key").asc_nulls_first(), "h").sortWithinPartitions(F.col("key").asc_nulls_first(), "h", "text").drop("h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only_remember("vocab")
        encode, end, part = encoder(tokenizer, spaced), struct.pack("<I", end_id), TaskContext.get().partitionId()
        keys, held, n_held, shard, first = [], [], 0, 0, 0

        def close():
            data = write_shard(held, terminals, end_id)
            columns = [[part], [shard], [first], [n_held], [keys], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(key_type), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["part", "shard", "first", "tokens", "keys", "data"],
            )

        for batch in batches:
            key_type = batch.schema.field("key").type
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(t) + end
                keys.append(k)
                held.append(ids)
                n_held += len(ids) // 4
                if n_held >= SHARD_TOKENS:
                    yield close()
                    shard, first = shard + 1, first + n_held
                    keys, held, n_held = [], [], 0
        if held:
            yield close()

    found = source.mapInArrow(run, f"part int, shard int, first long, tokens long, keys array<{kind}>, data binary")
    found.write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_table(spark, path: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids binary of every document in the shards under path, decoded from them.

    The driver gets the number of tokens of each part, one row per range of the sort.
    """
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    base, total = {}, 0
    for p in parts:
        base[p["part"]] = total
        total += p["n"]
    kind = shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for row in batch.to_pylist():
                documents = Shard(row["data"]).all()
                size = np.array([len(d) for d in documents], np.int64)
                start = base[row["part"]] + row["first"] + np.cumsum(size) - size
                for k in range(0, len(size), 512):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["keys"][k : k + 512], key_type), pa.array(start[k : k + 512]), pa.array(size[k : k + 512]), pa.array([d.tobytes() for d in documents[k : k + 512]], pa.binary())],
                        names=[key, "start", "n_tokens", "ids"],
                    )

    arrow_batches(spark)  # shards of some megabytes: a batch is bounded by its bytes
    return shards.select("part", "first", "keys", "data").mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids binary")


def op7_repair(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "repair")
    write_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch.root}/shards")
    found = read_table(spark, f"{scratch.root}/shards")
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
