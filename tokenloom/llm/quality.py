"""Quality rules as a short-circuit cascade: rules in the order of rejections per cost, learned on a sample.

A rule rejects a text by measures, column expressions over it. On a bounded sample the seconds of each measure and the
verdict of each rule are taken; rules are then ordered greedily: next is the one that rejects most of the texts left per
second of the measures not yet at hand. In the plan a measure is taken only of texts that no earlier rule has
rejected. The order decides what a text costs, never whether it is kept: a text is kept if no rule rejects it.

All of it is DataFrame functions. Per text the work is O(n log n), also for texts of many equal words.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm._common import Scratch, column, numbered, place_of

#: Texts that costs and selectivities are estimated on, at most. They decide the order of rules alone.
SAMPLE_ROWS = 2000

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: _without(line, SPACE) != "")


def _triples(words: Column) -> Column:
    """A hash of each run of three words; in one text two unlike runs share one with a chance below 1e-10."""
    n = F.size(words) - 2
    return F.transform(F.arrays_zip(*(F.slice(words, k, n).alias(f"w{k}") for k in (1, 2, 3))), lambda run: F.xxhash64(run))


def _ranked(triples: Column) -> Column:
    """The hashes with their places, sorted; null where all are unlike, so that most texts are not sorted."""
    return F.when(
        F.size(F.array_distinct(triples)) < F.size(triples), F.sort_array(F.transform(triples, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    )


def _starts(ranked: Column, same: Column) -> Column:
    """Places of the hashes that stand twice or more, ascending; same: whether the next one is equal."""
    before = F.slice(F.concat(F.array(F.lit(False)), same), 1, F.size(same))
    marked = F.arrays_zip(ranked.alias("x"), same.alias("next"), before.alias("before"))
    return F.sort_array(F.transform(F.filter(marked, lambda m: m["next"] | m["before"]), lambda m: m["x"]["k"]))


def _covered(starts: Column) -> Column:
    """Words that runs of three from these places cover, each once."""
    before = F.slice(F.concat(F.array(F.lit(-3)), starts), 1, F.size(starts))
    new = F.zip_with(starts, before, lambda at, last: F.least(F.lit(3), at - last))
    return F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda total, n: total + n), F.lit(0))


@dataclass(frozen=True)
class Measure:
    """uses: other measures; make: from the text and a function that gives those by name.

    Lambdas read their elements alone: an array inside one could be made anew for each element.
    """

    make: Callable[[Column, Callable[[str], Column]], Column]
    uses: tuple[str, ...] = ()


MEASURES: dict[str, Measure] = {
    "words": Measure(lambda t, m: _words(t)),
    "n_words": Measure(lambda t, m: F.size(m("words")).cast("long"), ("words",)),
    "word_chars": Measure(lambda t, m: F.length(_without(t, SPACE)).cast("long")),
    "n_symbols": Measure(lambda t, m: (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long")),
    "lines": Measure(lambda t, m: _lines(t)),
    "n_lines": Measure(lambda t, m: F.size(m("lines")).cast("long"), ("lines",)),
    "n_dup_lines": Measure(lambda t, m: (F.size(m("lines")) - F.size(F.array_distinct(m("lines")))).cast("long"), ("lines",)),
    "triples": Measure(lambda t, m: F.when(F.size(m("words")) > 2, _triples(m("words"))), ("words",)),
    "ranked": Measure(lambda t, m: _ranked(m("triples")), ("triples",)),
    "same": Measure(lambda t, m: F.zip_with(m("ranked"), F.slice(m("ranked"), 2, F.size(m("ranked"))), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))), ("ranked",)),
    "starts": Measure(lambda t, m: _starts(m("ranked"), m("same")), ("ranked", "same")),
    "n_repeat_words": Measure(lambda t, m: _covered(m("starts")).cast("long"), ("starts",)),
    "n_letters": Measure(lambda t, m: F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long")),
    "n_shouts": Measure(lambda t, m: (F.length(t) - F.length(_without(t, "!"))).cast("long")),
}


@dataclass(frozen=True)
class Rule:
    """rejects: from a function that gives measures by name, true for texts to reject. In whole numbers, so exact."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda m: m("n_words") < 50),
    Rule("repeated_runs", ("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("few_letters", ("word_chars", "n_letters"), lambda m: 10 * m("n_letters") < 6 * m("word_chars")),
    Rule("shouting", ("n_words", "n_shouts"), lambda m: 2 * m("n_shouts") > m("n_words")),
)


def closure(names: Sequence[str], have: Sequence[str] = ()) -> list[str]:
    """The measures that names need, those they use first, without the ones at hand."""
    out: list[str] = []

    def add(name: str) -> None:
        if name not in have and name not in out:
            for other in MEASURES[name].uses:
                add(other)
            out.append(name)

    for name in names:
        add(name)
    return out


def measured(rows: DataFrame, text: Column, names: Sequence[str], at: Callable[[str], str], have: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """rows with measures beside them, each a column named by at(); null where `where` is not true."""
    for name in closure(names, have):
        made = MEASURES[name].make(text, lambda other: F.col(at(other)))
        rows = rows.withColumn(at(name), made if where is None else F.when(where, made))
    return rows


def _at(name: str) -> str:
    return f"__{name}"


@dataclass(frozen=True)
class Estimate:
    """What the sample says of a rule at its place: seconds a text for the measures it adds, the share it rejects of
    the texts that come to it."""

    rule: Rule
    seconds: float
    rejects: float


def order_rules(
    texts: DataFrame, rules: Sequence[Rule] = RULES, have: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS, seconds: Mapping[str, float] | None = None
) -> list[Estimate]:
    """The rules in the order of rejections per cost, on a sample of texts (its one column, a string).

    have: measures that are at hand anyway and cost nothing. seconds: costs of measures, if they are known; else each is
    timed on the sample. What comes to the driver is one row of verdicts a sampled text, sample_rows at most.
    An empty table leaves the order as it is.
    """
    spark, scratch = texts.sparkSession, Scratch(texts.sparkSession, "quality")
    n = texts.count()
    share = min(1.0, 1.2 * sample_rows / max(1, n))
    text = F.col(texts.columns[0])
    taken = texts if share == 1 else texts.where(F.rand(11) < share)
    sample = scratch.save(taken.limit(sample_rows), "sample")
    needed = closure([name for rule in rules for name in rule.uses])
    verdicts = measured(sample, text, needed, _at).select(
        *(F.coalesce(rule.rejects(lambda name: F.col(_at(name))), F.lit(False)).alias(f"r{k}") for k, rule in enumerate(rules))
    )
    rejected = [tuple(row) for row in verdicts.collect()]
    costs = dict(seconds) if seconds is not None else _timed(spark, sample, text, [m for m in needed if m not in have])
    scratch.drop("sample")
    return greedy(rules, rejected, costs, have)


def _timed(spark: SparkSession, sample: DataFrame, text: Column, names: Sequence[str]) -> dict[str, float]:
    """Seconds a text of each measure by itself: the time of it and of what it uses, less that of what it uses."""

    def run(wanted: Sequence[str]) -> float:
        frame = measured(sample, text, wanted, _at)
        # a cheap function of every measure, so that none is pruned
        total = reduce(lambda a, b: a + b, (F.coalesce(F.hash(_at(name)), F.lit(0)).cast("long") for name in wanted), F.length(text).cast("long"))
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            frame.agg(F.max(total)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    nothing = run(())
    whole = {name: run([name]) for name in names}
    # what a measure adds to those it uses; never less than a hundredth of reading the texts
    return {name: max(whole[name] - max((whole[o] for o in MEASURES[name].uses if o in whole), default=nothing), nothing / 100) for name in names}


def greedy(rules: Sequence[Rule], rejected: Sequence[tuple[bool, ...]], seconds: Mapping[str, float], have: Sequence[str] = ()) -> list[Estimate]:
    """Order rules by the share they reject of the texts left, per cost of the measures not yet at hand; ties stand as
    they are given."""
    left, rest, at_hand, out = list(rejected), list(range(len(rules))), list(have), []
    while rest:
        cost = {k: sum(seconds.get(name, 0.0) for name in closure(rules[k].uses, at_hand)) + 1e-12 for k in rest}
        share = {k: sum(row[k] for row in left) / max(1, len(left)) for k in rest}
        best = max(rest, key=lambda k: (share[k] / cost[k], -rest.index(k)))
        out.append(Estimate(rules[best], cost[best], share[best]))
        at_hand += closure(rules[best].uses, at_hand)
        left = [row for row in left if not row[best]]
        rest.remove(best)
    return out


def judged(rows: DataFrame, text: Column, order: Sequence[Rule], out: str, have: Sequence[str] = ()) -> DataFrame:
    """rows with the name of the first rule that rejects them in `out`, null for texts to keep.

    have: measures already in the rows. Every other is taken only where no earlier rule has rejected the text.
    """
    rows, at_hand = rows.withColumn(out, F.lit(None).cast("string")), list(have)
    for rule in order:
        rows = measured(rows, text, rule.uses, _at, at_hand, F.col(out).isNull())
        at_hand += closure(rule.uses, at_hand)
        rows = rows.withColumn(out, F.coalesce(out, F.when(rule.rejects(lambda name: F.col(_at(name))), F.lit(rule.name))))
    # a filter on the verdict must stay above the cascade: pushed into it, its condition would double at every rule
    return rows.withColumn(out, F.when(F.spark_partition_id() >= 0, F.col(out)))


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of df whose text no rule rejects, all columns as they were.

    Null and empty texts have no words, so the default rules reject them. Repeated rows fare alike; ids are not read; an
    empty table stays empty; other columns pass through, whatever their names.
    """
    rows, names = numbered(df)
    t = F.coalesce(column(place_of(names, text)).cast("string"), F.lit(""))
    order = [e.rule for e in order_rules(rows.select(t.alias("t")), rules, (), sample_rows)]
    return judged(rows, t, order, "__by").where(F.col("__by").isNull()).select(*rows.columns).toDF(*names)


DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_rules(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of df: doc_id, the five measures, base_failed, kept.

    Null texts are empty: all measures 0, base_failed. Null ids and repeated rows are rows like others; an empty table
    gives none; other columns are not read.
    """
    rows = df.select(column(doc_id).alias("doc_id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("__text"))
    t = F.col("__text")
    have = closure(DIGEST)
    order = [e.rule for e in order_rules(rows.select("__text"), rules, have, sample_rows)]
    found = judged(measured(rows, t, DIGEST, _at), t, order, "__by", have)
    failed = reduce(lambda a, b: a | b, (rule.rejects(lambda name: F.col(_at(name))) for rule in BASE_RULES))
    return found.select(
        "doc_id", *(F.col(_at(name)).alias(name) for name in DIGEST), failed.alias("base_failed"), (~failed & F.col("__by").isNull()).alias("kept")
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five measures, the base verdict and the cascade's over every whole text of documents."""
    return score_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL for op11_quality."""
    return r"""with w as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as l from documents),
runs as (select r, k, w[k:k + 2] as run from (select r, w, unnest(range(1, len(w) - 1)) as k from w)),
twice as (select r, k from (select r, k, count(*) over (partition by r, run) as n from runs) where n > 1),
covered as (select r, count(distinct p) as n from (select r, unnest([k, k + 1, k + 2]) as p from twice) group by r),
m as (select doc_id, t, l, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words from w left join covered using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or 2 * n_dup_lines > len(l)
    or 10 * length(regexp_replace(t, '[^\p{L}]', '', 'g')) < 6 * word_chars or 2 * length(regexp_replace(t, '[^!]', '', 'g')) > n_words) as kept from b"""
