"""The prefix trie of conversations, its subtree totals by leaf-peeling message passing.

A node is a distinct sequence of first turns. Its key is the exclusive or of hashes of (depth, turn) along it, 128 bits,
so that keys of all prefixes are running aggregates of narrow rows; texts are never shuffled.

Nodes on one path with the same members are one chain, told by smallest member and number of members alone. A chain
holds a counter of children that have not reported; chains without any send their totals to their parents, which
count down, round by round, until only the root's is left. There are as many rounds as branchings on a path.
What only one conversation reaches is a path to its end and needs no messages but its first.

Long conversations, long chains, large families and nodes with many ends are dealt out: turns are numbered by slices of
a range partition, running sums go by blocks of depths, children of large parents meet them by broadcast, and ids of
ends are joined by blocks of ids before one task hashes them in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import Scratch, column, spread_join

#: Turns that a conversation takes from its base are fewer than this; every BASE-th id is a base.
HEAD, BASE = 9, 5
#: Depths of a conversation or chain that meet in one window, and ids (two to the power) of ends that are joined in one group.
BLOCK, IDS = 4096, 10
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(df: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns with their places from 1, and conversations with their turns.

    (conv, part, pos, t1, t2, bytes) by slice, and (conv, part, before): how many turns stand in earlier slices. Null
    turns come first; turns with one number stand in the order of their hashes; null roles and texts are empty. Rows
    without a conversation belong to none.
    """
    r, t = (F.coalesce(column(name).cast("string"), F.lit("")) for name in (role, text))
    rows = df.where(column(conv).isNotNull()).select(
        column(conv).cast("long").alias("conv"), column(turn).alias("turn"), F.xxhash64(F.lit(1), r, t).alias("t1"), F.xxhash64(F.lit(2), r, t).alias("t2"),
        F.octet_length(t).cast("long").alias("bytes"),
    )
    order = ["conv", "turn", "t1", "t2"]
    rows = scratch.save(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    slices = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    slices = slices.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n"))
    return rows, slices


def _placed(rows: DataFrame) -> Column:
    return F.col("before") + F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "t1", "t2"))


def rebuilt(rows: DataFrame, slices: DataFrame, scratch: Scratch) -> DataFrame:
    """Rebuilt conversations: (conv, len, depth, t1, t2, bytes), and one row of depth 0 for each.

    Conversation c has the first h turns of conversation c - c % 5, then its own after its first h; h is crc32 of its
    decimal id, modulo 9. A turn knows its copies: at most nine conversations share a base.
    """
    conv = slices.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("base", F.col("conv") - F.col("conv") % BASE)
    conv = conv.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD)
    bases = conv.where(F.col("conv") == F.col("base")).select("base", F.least("n", F.lit(HEAD)).alias("nb"))
    conv = conv.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("nb", F.lit(0))))
    conv = scratch.save(conv.withColumn("len", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).select("conv", "base", "h", "taken", "len"), "convs")
    copies = conv.groupBy(F.col("base").alias("conv")).agg(F.collect_list(F.struct(F.col("conv").alias("c"), "h", "len")).alias("copies"))
    places = slices.join(conv.drop("base"), "conv").join(copies, "conv", "left").drop("n")
    turns = rows.join(places, ["conv", "part"]).withColumn("pos", _placed(rows))
    own = F.array(F.struct(F.col("conv").alias("conv"), F.col("len").alias("len"), (F.col("taken") + F.col("pos") - F.col("h")).alias("depth")))
    given = F.transform(
        F.filter(F.col("copies"), lambda x: F.col("pos") <= x["h"]), lambda x: F.struct(x["c"].alias("conv"), x["len"].alias("len"), F.col("pos").alias("depth"))
    )
    none = F.array().cast("array<struct<conv:bigint,len:bigint,depth:bigint>>")
    to = F.explode(F.concat(F.when(F.col("pos") > F.col("h"), own).otherwise(none), F.coalesce(given, none)))
    out = turns.select(to.alias("to"), "t1", "t2", "bytes").select("to.*", "t1", "t2", "bytes")
    zero = F.lit(0).cast("long")
    return out.unionByName(conv.select("conv", "len", zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("bytes")))


def _before(rows: DataFrame, keys: list[str], sums: dict[str, tuple[str, str]], long: bool) -> DataFrame:
    """rows with running aggregates by depth, the row's own left out: {name: (function, column)}, null at the first.

    long: whether a group goes beyond one block of depths; then earlier blocks are added.
    """
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "bit_xor": lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))}
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    inside = Window.partitionBy(*keys, "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({name: getattr(F, f)(c).over(inside) for name, (f, c) in sums.items()})
    if long:
        earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy(*keys, "block").agg(*(getattr(F, f)(c).alias(f"b_{name}") for name, (f, c) in sums.items()))
        blocks = blocks.withColumns({f"b_{name}": getattr(F, f)(f"b_{name}").over(earlier) for name, (f, _) in sums.items()})
        out = out.join(blocks, [*keys, "block"])
        out = out.withColumns({name: join[f](F.col(name), F.col(f"b_{name}")) for name, (f, _) in sums.items()}).drop(*(f"b_{name}" for name in sums))
    return out.drop("block")


def _longest(df: DataFrame, length: Column) -> bool:
    return (df.agg(F.max(length).alias("n")).first()["n"] or 0) >= BLOCK


def nodes_of(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes (k1, k2, p1, p2, depth, conv_id, n_convs, bytes, n_children, parent_conv_id, parent_n) and the ids of ends by
    blocks, (k1, k2, block, ids), from rows of conversations with their row of depth 0."""
    keyed = turns.withColumns({f"x{k}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "t1", "t2")).otherwise(0) for k in (1, 2)})
    keyed = _before(keyed, ["conv"], {"p1": ("bit_xor", "x1"), "p2": ("bit_xor", "x2")}, _longest(turns, F.col("depth")))
    keyed = keyed.withColumns({f"k{k}": F.coalesce(f"p{k}", F.lit(0)).bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)})
    ends = F.collect_list(F.when(F.col("depth") == F.col("len"), F.col("conv")))
    pieces = keyed.groupBy("k1", "k2", F.shiftright("conv", IDS).alias("block")).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.array_join(F.transform(F.array_sort(ends), lambda c: c.cast("string")), ",").alias("ids"),
    )
    pieces = scratch.save(pieces, "pieces")
    nodes = scratch.save(
        pieces.groupBy("k1", "k2").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
        ),
        "nodes",
    )
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = scratch.save(nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    parents = nodes.where("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"), F.col("n_children").alias("n")
    )
    none = F.lit(None).cast("long")
    full = spread_join(nodes.where("depth > 0"), parents, ["p1", "p2"], "n").unionByName(
        nodes.where("depth = 0").withColumns({"parent_conv_id": none, "parent_n": none})
    )
    return scratch.save(full, "full"), pieces.where("ids <> ''").select("k1", "k2", "block", "ids")


def _hashed(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): blocks of a node follow each other in one stream, of which nothing is kept but the hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _batch(done)
        if now:
            yield _batch([(*now, digest.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["k1", "k2", "ends_sha256"])

    return ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def peeled(full: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, n_convs, span, leaves, total) of every chain with two members or more: its nodes, the childless nodes
    below it or itself, and the sum of weights of its nodes and all below them."""
    weight = (F.col("n_convs") - 1) * F.col("bytes")
    chains = full.where("n_convs > 1").groupBy("conv_id", "n_convs").agg(
        F.count("*").alias("span"), F.sum(weight).alias("total"), F.max_by("n_children", "depth").alias("left"),
        F.min_by(F.struct("parent_conv_id", "parent_n"), "depth").alias("up"),
    )
    chains = chains.select("conv_id", "n_convs", "span", "total", "left", F.when(F.col("left") == 0, 1).otherwise(0).cast("long").alias("leaves"), "up.*")
    to = [F.col("parent_conv_id").alias("conv_id"), F.col("parent_n").alias("n_convs")]
    # the tops of paths that one conversation alone goes
    sent = full.where("n_convs = 1 and parent_n > 1").groupBy(*to).agg(F.count("*").alias("n"), F.count("*").alias("m_leaves"), F.lit(0).cast("long").alias("m_total"))
    waiting, done, k = chains, [], 0
    while True:
        state = waiting.join(sent, ["conv_id", "n_convs"], "left").select(
            "conv_id", "n_convs", "span", (F.col("total") + F.coalesce("m_total", F.lit(0))).alias("total"), (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"),
            (F.col("leaves") + F.coalesce("m_leaves", F.lit(0))).alias("leaves"), "parent_conv_id", "parent_n",
        )
        state = scratch.save(state, f"peel-{k}")
        complete, waiting, k = state.where("left = 0"), state.where("left > 0"), k + 1
        done.append(complete.select("conv_id", "n_convs", "span", "leaves", "total"))
        if waiting.isEmpty():
            break
        sent = complete.where("parent_n is not null").groupBy(*to).agg(F.count("*").alias("n"), F.sum("leaves").alias("m_leaves"), F.sum("total").alias("m_total"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def trie(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node of the trie of conversations, from rows (conv, len, depth, t1, t2, bytes)."""
    full, ends = nodes_of(turns, scratch)
    totals = scratch.save(peeled(full, scratch), "totals")
    shared = full.where("n_convs > 1").withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes"))
    shared = _before(shared, ["conv_id", "n_convs"], {"above": ("sum", "weight")}, _longest(totals, F.col("span")))
    shared = spread_join(shared, totals, ["conv_id", "n_convs"], "span")
    columns = ["k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    one = full.where("n_convs = 1").select(*columns, F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    all_nodes = shared.select(*columns, F.col("leaves").alias("n_leaves"), (F.col("total") - F.coalesce("above", F.lit(0))).alias("saved_tokens")).unionByName(one)
    out = all_nodes.join(_hashed(ends), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return out.drop("k1", "k2")


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations rebuilt on their bases: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Ids are integers. Null turns come first, null roles and texts are empty, rows without an id belong to no
    conversation, turns with one number stand in the order of their hashes, repeated rows are turns like others; an
    empty table has no node; other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "trie")
    rows, slices = numbered_turns(df, scratch, conv, turn, role, text)
    return trie(rebuilt(rows, slices, scratch), scratch)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def oracle() -> str:
    """DuckDB SQL for op12_trie: crc32 by bits, prefixes as lists, subtrees by joins of prefixes."""
    return """with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select c, c - c % 5 as base, xor(4294967295, list_reduce(list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint),
  lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x // 2, (x % 2) * 3988292384), xor(crc, byte)), 4294967295::bigint)) % 9 as h from (select distinct c from t)),
parts as (select ids.c, 0 as own, pos, role, text from ids join t on t.c = ids.base where pos <= h union all select ids.c, 1, pos, role, text from ids join t on t.c = ids.c where pos > h),
r as (select c, row_number() over (partition by c order by own, pos) as d, role, text from parts),
p as (select c, d, text, list([role, text]) over (partition by c order by d) as path from r union all select c, 0, '', [] from ids),
len as (select c, max(d) as n from p group by c),
node as (select path, p.d as depth, min(c) as conv_id, count(*) as n_convs, max(strlen(text)) as bytes, coalesce(string_agg(c::varchar, ',' order by c) filter (where p.d = len.n), '') as ends
  from p join len using (c) group by path, p.d),
k as (select a.path, count(*) as n from node a join node b on b.depth = a.depth + 1 and b.path[1:a.depth] = a.path group by a.path),
sub as (select a.path, count(*) filter (where k.n is null) as leaves, sum((b.n_convs - 1) * b.bytes) as saved
  from (select distinct a.path, b.path as below from p a join p b on a.c = b.c and a.d <= b.d) x join node a on a.path = x.path join node b on b.path = x.below left join k on k.path = b.path group by a.path)
select node.conv_id, node.depth::bigint as depth, up.conv_id as parent_conv_id, node.n_convs, coalesce(k.n, 0) as n_children, sub.leaves as n_leaves, sub.saved::bigint as saved_tokens, sha256(node.ends) as ends_sha256
from node join sub using (path) left join k using (path) left join node up on up.depth = node.depth - 1 and up.path = node.path[1:node.depth - 1]"""
