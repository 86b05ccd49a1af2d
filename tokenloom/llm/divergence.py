"""Source divergence audit: how the sources of each language differ in the terms they use, exactly.

Terms are counted where texts lie and summed by Spark. A source's share of a term is a whole number p, scaled and
smoothed; the divergence of two shares is floor((p - q)^2 / (p + q)).

Pairs of sources: most terms stand in few sources, so a sum over all terms is the number of terms times the divergence of
two absent terms, the baseline, corrected by the terms that stand in either source. Sources are dealt to blocks of a
bounded size; a task meets two blocks and a share of the terms, as a stream, and keeps sums alone.

Ranks: radix selection. Histograms over the bits of the values, highest first, find the digit in which each group's
k-th value lies; what is above is taken, what is below goes, and the next digit decides the rest. Values that tie go on
over the UTF-8 bytes of their terms. Once few rows of any group are left they are sorted. So a pass counts with partial
sums, and no group is sorted as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import Scratch, arrow_batches, column, group_starts, spread_join, whole_groups

LEAST_DOCS, SCALE, RANKS = 10, 1_000_000_000, 10
#: Distinct (lang, source, term) a task holds before it hands its sums on; sources of a block; rows of terms met at once.
HELD, BLOCK, MET = 200_000, 64, 1 << 14
#: Rows of a language's terms that are summed together, so that sums handed on stay few beside the rows.
BUCKET = 1 << 17
#: Bits of a digit, and rows of a group that are sorted rather than counted once more.
DIGIT, SORTED = 10, 100

#: All bytes of terms, A-Z in lower case; every other byte is a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by source, from rows (lang, source, text) without nulls."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            lang, source, text = batch.columns
            for key, data in zip(zip(lang.to_pylist(), source.to_pylist(), strict=True), text.cast(pa.binary()), strict=True):
                found = Counter(data.as_py().translate(_BYTES).split())
                n, d = held.setdefault(key, (Counter(), Counter()))
                size -= len(n)
                n.update(found)
                d.update(found.keys())
                size += len(n)
                if size > HELD:
                    yield from flushed(held)
                    held, size = {}, 0
        yield from flushed(held)

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    parts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals: counts times SCALE can go beyond 64 bits."""
    whole = (F.lit(SCALE).cast("decimal(11,0)") * (count + 2).cast("decimal(20,0)")).cast("decimal(36,0)")
    return F.call_function("div", whole, (total + 2 * terms).cast("decimal(20,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, source, term, p, q) where they stand, q their language's share, and all groups
    (lang, source, terms, p0), p0 the share of a term that the source has not; 0 where no term is kept."""
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({
        "lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "nth": F.row_number().over(of_term.orderBy("source")),
    })
    kept = scratch.save(counts.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "nth"), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.count_if(F.col("nth") == 1).alias("firsts"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["total", "rows", "firsts"])
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"))
    groups = scratch.save(groups.drop("firsts").join(langs, "lang"), "groups")
    found = spread_join(kept, groups.where("rows > 0"), ["lang", "source"], "rows").select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")
    )
    absent = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0)
    return scratch.save(found, "shares"), scratch.save(groups.select("lang", "source", "terms", absent.alias("p0")), "absent")


def _corrections(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms of divergence less baseline, by pair of sources, from rows (lang, lo, hi, bucket, term, source,
    block, p) sorted by the first five; rows without a term come first and name the sources of a cell with their p0."""
    keys = ["lang", "lo", "hi", "bucket"]
    cell, names, p0, block, sums = None, {}, None, None, None
    for table in whole_groups(batches, [*keys, "term"], MET):
        starts = group_starts(table, keys)
        for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
            part = table.slice(a, b - a)
            key = tuple(part.column(k)[0].as_py() for k in keys)
            if key != cell:
                if cell:
                    yield _sums(cell, names, block, sums)
                first = part.filter(part.column("term").is_null())
                cell, names = key, {s: k for k, s in enumerate(first.column("source").to_pylist())}
                p0, block = first.column("p").to_numpy(), first.column("block").to_numpy()
                sums = np.zeros((len(names), len(names)), np.int64)
            part = part.filter(part.column("term").is_valid())
            if part.num_rows:
                _add(part, names, p0, block, cell, sums)
    if cell:
        yield _sums(cell, names, block, sums)


def _add(part: pa.Table, names: dict[str, int], p0: np.ndarray, block: np.ndarray, cell: tuple, sums: np.ndarray) -> None:
    at = np.array([names[s] for s in part.column("source").to_pylist()])
    term = np.zeros(part.num_rows, np.int64)
    term[group_starts(part, ["term"])[1:]] = 1
    term = np.cumsum(term)
    p = np.tile(p0, (term[-1] + 1, 1))
    p[term, at] = part.column("p").to_numpy()
    has = np.zeros(p.shape, bool)
    has[term, at] = True
    for k in range(len(p0)):  # a term in k: against every other source; a term in both is met once
        rows = np.flatnonzero(has[:, k])
        if not len(rows):
            continue
        mine, theirs = p[rows, k][:, None], p[rows]
        more = (mine - theirs) ** 2 // (mine + theirs) - (p0[k] - p0) ** 2 // (p0[k] + p0)
        more[:, :k][has[rows, :k]] = 0
        sums[k] += more.sum(0)


def _sums(cell: tuple, names: dict[str, int], block: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    lang, lo, hi, _ = cell
    both = sums + sums.T
    a, b = np.nonzero(both)
    use = (a != b) & (np.minimum(block[a], block[b]) == lo) & (np.maximum(block[a], block[b]) == hi)
    a, b = a[use], b[use]
    name = np.array(list(names), object)
    columns = [pa.array([lang] * len(a), pa.string()), pa.array(name[a], pa.string()), pa.array(name[b], pa.string()), pa.array(both[a, b], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def pair_divergences(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each two sources of a language, both ways, summed over all its terms."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = found.groupBy("lang").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("buckets"))
    blocks = blocks.join(rows, "lang", "left").na.fill(1, ["buckets"])
    groups = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = groups.select("lang", "source", "terms", "p0", "block", "buckets", other)
    right = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("block").alias("other"))
    value = F.when(F.col("terms") > 0, F.col("terms") * _apart(F.col("p0"), F.col("q0"))).otherwise(0)
    base = left.join(right, ["lang", "other"]).where(F.col("source") != F.col("item")).select("lang", "source", "item", value.alias("value"))
    cells = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    named = left.where("terms > 0").select("lang", *cells, F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("string").alias("term"), "source", "block", F.col("p0").alias("p"))
    placed = found.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    placed = placed.select("lang", "source", "term", "p", "block", "buckets", other).select(
        "lang", *cells, F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "term", "source", "block", "p"
    )
    keys = ["lang", "lo", "hi", "bucket"]
    met = named.unionByName(placed).repartition(*keys).sortWithinPartitions(*keys, "term")
    more = met.mapInArrow(_corrections, "lang string, source string, item string, value long")
    return base.unionByName(more).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def first_ranks(rows: DataFrame, keys: list[str], k: int, scratch: Scratch, value: str = "value", item: str = "item") -> DataFrame:
    """The rows of each group with its k greatest values, ties by the UTF-8 bytes of their items, and their rank from 1.

    rows: a written table, values from 0, items unlike within a group. Taken rows of a group are fewer than k, and those
    still open when it is sorted are SORTED at most, unless no digit is left.
    """
    most = rows.agg(F.max(value).alias("v"), F.max(F.octet_length(item)).alias("b")).first()
    live, taken, need = rows.withColumn("__need", F.lit(k)), [], 0
    bits = -(-max(1, (most["v"] or 0).bit_length()) // DIGIT)
    low = F.lit((1 << DIGIT) - 1)
    digits = [low - F.shiftright(F.col(value), DIGIT * j).bitwiseAND(low) for j in reversed(range(bits))]
    for at, digit in enumerate(chain(digits, (_byte(F.col(item), j) for j in range(most["b"] or 0)))):
        live = live.withColumn("__d", digit.cast("int"))
        up_to = F.sum("n").over(Window.partitionBy(*keys).orderBy("__d"))
        bins = live.groupBy(*keys, "__d").agg(F.count("*").alias("n"), F.max("__need").alias("need")).withColumn("to", up_to)
        cut = bins.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.min(F.when(F.col("to") >= F.col("need"), F.struct("__d", F.col("n").alias("open"), (F.col("need") - F.col("to") + F.col("n")).alias("rest")))).alias("cut")
        )
        cut = scratch.save(cut.select(*keys, "n", F.col("cut.__d").alias("at"), F.col("cut.rest").alias("rest"), F.col("cut.open").alias("open")), f"cut-{at}")
        state = spread_join(live.drop("__need"), cut, keys, "n").where(F.col("at").isNull() | (F.col("__d") <= F.col("at")))
        sure = F.col("at").isNull() | (F.col("__d") < F.col("at")) | (F.col("open") == F.col("rest"))
        state = scratch.save(state.withColumn("__sure", sure), f"open-{at}")
        taken.append(state.where("__sure").select(*rows.columns))
        live = state.where("not __sure").select(*rows.columns, F.col("rest").alias("__need"))
        need = cut.where(F.col("open") > F.col("rest")).agg(F.max("open").alias("n")).first()["n"] or 0
        if need <= SORTED:
            break
    out = live.select(*rows.columns)
    for more in taken:
        out = out.unionByName(more)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def _byte(item: Column, at: int) -> Column:
    """1 more than the byte at a place; 0 where the item has ended."""
    return F.coalesce(F.conv(F.hex(F.substring(item.cast("binary"), at + 1, 1)), 16, 10).cast("int") + 1, F.lit(0))


def divergence_audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair`, each other source of the language by divergence; `term`, the
    terms that a source uses more than its language does, the first of them by divergence.

    Null texts, languages and sources are empty. A language without a kept term has pairs of value 0 and no terms, one
    with a single source no pairs; repeated rows count as often as they stand; an empty table gives none; other columns
    are not read.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "divergence")
    docs = df.select(*(F.coalesce(column(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    found, groups = shares(docs, scratch, least_docs)
    pairs = pair_divergences(found, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    scored = scratch.save(found.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value")), "scored")
    terms = first_ranks(scored, ["lang", "source"], ranks, scratch)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and telling terms of every source of documents."""
    return divergence_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL for op13_divergence: all shares of all terms, dense."""
    share = "(1 + (1000000000::hugeint * ({n} + 2)) // ({total} + 2 * v))"
    apart = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    return rf"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select distinct lang, source from d),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as n from t group by lang, term having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
tot as (select lang, source, sum(n) as total from c group by all),
l as (select lang, count(*) as v, sum(n) as total from k group by lang),
s as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, {share.format(n="coalesce(c.n, 0)", total="coalesce(tot.total, 0)")} as p, {share.format(n="k.n", total="l.total")} as q
  from g join k using (lang) join l using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join tot on tot.lang = g.lang and tot.source = g.source),
x as (select a.lang, a.source, 'pair' as part, b.source as item, sum({apart.format(p="a.p", q="b.p")}) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all select a.lang, a.source, 'pair', b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source where a.lang not in (select lang from l)
  union all select lang, source, 'term', term, {apart.format(p="p", q="q")} from s where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank
from x qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, encode(item)) <= 10"""
