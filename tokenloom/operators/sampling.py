"""Stratified sampling: exact terciles, quotas, reproducible draws."""

from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.ranks import placed, written

QUOTAS = {"short": 3, "medium": 4, "long": 3}


def exact_quantile(values: list[int], p: Fraction) -> Fraction:
    """Linear interpolation at (n - 1) p in rational arithmetic."""
    ordered = sorted(values)
    whole, part = divmod((len(ordered) - 1) * p, 1)
    low = ordered[int(whole)]
    return Fraction(low) + part * (ordered[int(whole) + 1] - low if part else 0)


def draw(rows: list[tuple[str, int]], seed: int, quotas: dict[str, int] = QUOTAS) -> list[tuple[str, int, str, int, bool]]:
    """(uid, loc, group, rank, selected) of a small pool: Mersenne-Twister shuffles of id-sorted groups, in quota order."""
    if not rows:
        raise ValueError("nothing to draw from")
    cuts = [exact_quantile([n for _, n in rows], Fraction(k, 3)) for k in (1, 2)]
    names = list(quotas)
    groups: dict[str, list] = {g: [] for g in names}
    for uid, n in rows:
        groups[names[sum(n > c for c in cuts)]].append((uid, n))
    rng, out = random.Random(seed), []
    for g in names:
        pool = sorted(groups[g])
        if len(pool) < quotas[g]:
            raise ValueError(f"{g} has {len(pool)} of {quotas[g]}")
        rng.shuffle(pool)
        out += [(uid, n, g, rank, rank <= quotas[g]) for rank, (uid, n) in enumerate(pool, 1)]
    return out


def hashed_draw(df: DataFrame, seed: str, uid: str = "uid", size: str = "loc", quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """The scalable form, another draw: groups by exact thirds of size, ranks by a hash of seed and id.

    Borders are compared as integers: with k = rank of the tercile's left value, 3 * size against their weighted sum.
    """
    counts = written(df.groupBy(F.col(size).alias("v")).agg(F.count("*").alias("c")))  # a row for each size
    n = counts.agg(F.sum("c").alias("n")).first()["n"] or 0
    if not n:
        raise ValueError("nothing to draw from")
    ranks = sorted({(n - 1) * k // 3 for k in (1, 2)} | {min(n - 1, (n - 1) * k // 3 + 1) for k in (1, 2)})
    places = placed(counts.withColumn("all", F.lit(0)), ["all"], ["v"], "at", sums={"upto": "c"})
    found = places.agg(*(F.min(F.when(F.col("upto") > r, F.col("v"))).alias(f"v{r}") for r in ranks)).first()
    value, cuts = {r: found[f"v{r}"] for r in ranks}, []
    for k in (1, 2):
        low, part = divmod((n - 1) * k, 3)
        cuts.append((3 - part) * value[low] + part * value[min(n - 1, low + 1)])
    names = list(quotas)
    group = F.when(F.col(size) * 3 <= cuts[0], names[0]).when(F.col(size) * 3 <= cuts[1], names[1]).otherwise(names[2])
    drawn = written(df.withColumns({"grp": group, "__h": F.md5(F.concat(F.lit(seed), F.col(uid).cast("string")))}))
    ranked = placed(drawn, ["grp"], ["__h", uid], "draw_rank").drop("__h")
    limits = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))
    return ranked.withColumn("draw_rank", F.col("draw_rank").cast("long")).withColumn("selected", F.col("draw_rank") <= F.element_at(limits, F.col("grp")))


def select_cases(cases: DataFrame, spec: str, known: list[str] | None = None) -> DataFrame:
    """Cases by `all`, `first:N` in manifest order, or a comma-separated list of ids; unknown or repeated ids are errors."""
    if spec == "all":
        return cases
    if spec.startswith("first:"):
        return cases.orderBy("ord").limit(int(spec[6:]))
    ids = [s.strip() for s in spec.split(",")]
    if len(set(ids)) != len(ids):
        raise ValueError("an id stands twice")
    if known is not None and (unknown := sorted(set(ids) - set(known))):
        raise ValueError(f"unknown ids: {unknown}")
    return cases.where(F.col("case_id").isin(ids)).orderBy("ord")


def first_applicable(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The first candidate with status ok by line and index."""
    rest = [c for c in candidates.columns if c not in keys]
    best = candidates.where("status = 'ok'").groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("start_line", "index")).alias("c"))
    return best.select(*keys, "c.*")


def eligibility(records: DataFrame, swaps: DataFrame, keys: list[str], language: str = "lang_cluster", tests: str = "n_tests") -> DataFrame:
    """Records with eligible, reason and if_line: what first keeps a record out of the sample.

    In this order: not_python; python_parse_failed with the parser's words; no_applicable_if_else with the reasons of
    its ifs, or no_if; first_candidate_failed with the reason; missing_or_invalid_hidden_tests (null or none); eligible.
    swaps: rows of swap_table() of the records' sources. A record without a row there has no if.
    """
    tried = F.when(F.col("index").isNotNull() & (F.col("status") != "not_applicable"), F.struct("start_line", "index", "status", "reason"))
    parse = F.when(F.col("index").isNull(), F.regexp_replace("reason", "^doesn't parse: ", ""))
    ifs = swaps.groupBy(*keys).agg(F.min(tried).alias("__first"), F.max(parse).alias("__parse"), F.sort_array(F.collect_set(F.when(F.col("status") == "not_applicable", F.col("reason")))).alias("__why"))
    joined = records.join(ifs, keys, "left")
    why = F.concat(F.lit("no_applicable_if_else: "), F.when(F.size(F.coalesce("__why", F.array())) > 0, F.array_join("__why", "; ")).otherwise("no_if"))
    reason: Column = F.when(F.coalesce(F.col(language) != "Python", F.lit(True)), "not_python").when(F.col("__parse").isNotNull(), F.concat(F.lit("python_parse_failed: "), "__parse"))
    reason = reason.when(F.col("__first").isNull(), why).when(F.col("__first.status") != "ok", F.concat(F.lit("first_candidate_failed: "), F.coalesce("__first.reason", F.lit(""))))
    reason = reason.when(F.coalesce(F.col(tests), F.lit(0)) <= 0, "missing_or_invalid_hidden_tests").otherwise("eligible")
    return joined.withColumns({"reason": reason, "if_line": F.col("__first.start_line")}).withColumn("eligible", F.col("reason") == "eligible").drop("__first", "__parse", "__why")
