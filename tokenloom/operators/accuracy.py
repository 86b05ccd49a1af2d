"""Answers and behaviour: scoring, aggregation to pass@1, comparison of test observations, opt-in running of code."""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import END_MARK, answer_of, plain_answer


#: Fixed value: the status of an answer that has been scored.
SCORED = "scored"


def score_answers(answers: DataFrame, response: str = "response", truth: str = "truth") -> DataFrame:
    """answers with prediction and correct: the marked answer against the truth, both made plain."""
    prediction = answer_of(F.col(response))
    given = F.replace(plain_answer(prediction), F.lit(END_MARK), F.lit(""))  # what spaces had kept from being the mark
    correct = F.coalesce(given == plain_answer(F.col(truth)), F.lit(False))
    return answers.withColumns({"prediction": prediction, "correct": correct})


def pass_rates(answers: DataFrame, keys: list[str], planned: int | None = None) -> DataFrame:
    """planned, scored, n_correct, complete and pass_at_1 (only where every planned trial is scored).

    planned: trials per item; None takes the item's rows.
    """
    scored = F.coalesce(F.col("status") == SCORED, F.lit(False))
    agg = answers.groupBy(*keys).agg(F.count("*").cast("long").alias("rows"), F.count_if(scored).cast("long").alias("scored"), F.count_if(scored & F.coalesce("correct", F.lit(False))).cast("long").alias("n_correct"))
    agg = agg.withColumn("planned", F.lit(planned).cast("long") if planned else F.col("rows")).drop("rows")
    complete = F.col("scored") == F.col("planned")
    return agg.withColumns({"complete": complete, "pass_at_1": F.when(complete & (F.col("planned") > 0), F.col("n_correct") / F.col("planned"))})


def against_original(rates: DataFrame, keys: list[str], variant: str = "variant_id", original: str = "original") -> DataFrame:
    """Variants with pass_at_1_delta against the original of the same keys."""
    base = rates.where(F.col(variant) == original).select(*keys, F.col("pass_at_1").alias("__base"))
    joined = rates.where(F.col(variant) != original).join(base, keys, "left")
    return joined.withColumn("pass_at_1_delta", F.col("pass_at_1") - F.col("__base")).drop("__base")


def imported_answers(details: DataFrame, items: DataFrame) -> DataFrame:
    """Trials of known items: details (task_id, test_results array<boolean>) exploded, the trial its place."""
    each = details.select("task_id", F.posexplode("test_results").alias("trial", "correct"))
    return each.join(items, "task_id").withColumn("status", F.lit(SCORED))


def behaviour(observations: DataFrame, keys: list[str]) -> DataFrame:
    """match, mismatch or unverified per pair of versions, from one row per test case (equal, timeout).

    No cases are unverified; any unequal case is a mismatch, also beside timeouts; then any timeout is unverified.
    """
    agg = observations.groupBy(*keys).agg(
        F.count("case_id").cast("long").alias("n_cases"), F.count_if(F.col("equal") & ~F.col("timeout")).cast("long").alias("n_equal"), F.count_if("timeout").cast("long").alias("n_timeout")
    )
    status = F.when(F.col("n_cases") == 0, "unverified").when(F.col("n_equal") + F.col("n_timeout") < F.col("n_cases"), "mismatch").when(F.col("n_timeout") > 0, "unverified").otherwise("match")
    return agg.withColumn("status", status)


def observations_of(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per case: whether outputs, exit codes and exceptions are the same, and whether either side timed out."""
    seen = ["stdout", "returncode", "exception"]
    a = before.select(*keys, "case_id", F.col("timeout").alias("t0"), F.struct(*seen).alias("a"))
    b = after.select(*keys, "case_id", F.col("timeout").alias("t1"), F.struct(*seen).alias("b"))
    joined = a.join(b, [*keys, "case_id"])
    return joined.select(*keys, "case_id", F.col("a").eqNullSafe(F.col("b")).alias("equal"), (F.col("t0") | F.col("t1")).alias("timeout"))


def run_cases(programs: DataFrame, keys: list[str], allow: bool = False, timeout: float = 5.0) -> DataFrame:
    """Run programs (code, case_id, stdin) in child processes: stdout, returncode, exception, timeout of each.

    The code runs as it stands, with the worker's rights: off unless allowed.
    """
    if not allow:
        raise PermissionError("running code under test must be allowed explicitly")
    kind = ", ".join(f"`{k}` {programs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *head, case, code, stdin in batch.itertuples(index=False):
                try:
                    done = subprocess.run([sys.executable, "-I", "-c", code], input=stdin or "", capture_output=True, text=True, timeout=timeout, check=False)
                    last = done.stderr.strip().rsplit("\n", 1)[-1].split(":")[0] if done.returncode else None
                    rows.append([*head, case, done.stdout, done.returncode, last, False])
                except subprocess.TimeoutExpired:
                    rows.append([*head, case, None, None, None, True])
            yield pd.DataFrame(rows, columns=[*keys, "case_id", "stdout", "returncode", "exception", "timeout"]).astype({"returncode": "Int64"})

    return programs.select(*keys, "case_id", "code", "stdin").mapInPandas(run, f"{kind}, case_id string, stdout string, returncode long, exception string, timeout boolean")


#: What a called expression's value follows in the output of its program.
_MARK = "\x1evalue "


def run_calls(programs: DataFrame, keys: list[str], allow: bool = False, timeout: float = 5.0) -> DataFrame:
    """Run programs (code, case_id, expression) in child processes and evaluate the expression after the code:
    value (its str), stdout (before it), returncode, exception, timeout. Off unless allowed, as run_cases()."""
    tail = F.concat(F.lit("\n\nprint('\\x1evalue ' + str("), F.col("expression"), F.lit("))\n"))
    done = run_cases(programs.select(*keys, "case_id", F.concat("code", tail).alias("code"), F.lit("").alias("stdin")), keys, allow, timeout)
    parts = F.split("stdout", _MARK)
    value = F.when(F.size(parts) > 1, F.regexp_replace(F.element_at(parts, -1), "\n$", ""))
    return done.withColumns({"value": value, "stdout": F.element_at(parts, 1)})


def call_expressions(tests: DataFrame, entry: str = "entry", args: str = "args") -> DataFrame:
    """tests with expression: the entry called with args, an array of Python literals."""
    return tests.withColumn("expression", F.concat(F.col(entry), F.lit("("), F.array_join(args, ", "), F.lit(")")))


def stdin_cases(tests: str) -> list[dict]:
    """Cases of a JSON text of hidden tests: input, and the outputs that are right."""
    return [{"case_id": str(k), "stdin": c["input"], "expected": [c["output"]] if isinstance(c["output"], str) else list(c["output"])} for k, c in enumerate(json.loads(tests))]


def stage_counts(expected: DataFrame, status: DataFrame, keys: list[str], condition: str | None = None) -> DataFrame:
    """(stage, status, n) of expected keys: not_run without a row, stale where the condition's hash has changed."""
    state = status.select(*keys, F.col("status").alias("__s"), *([F.col(condition).alias("__c")] if condition else []))
    joined = expected.join(state, keys, "left")
    now = F.coalesce("__s", F.lit("not_run"))
    if condition:
        now = F.when(F.col("__s").isNotNull() & ~F.col("__c").eqNullSafe(F.col(condition)), "stale").otherwise(now)
    return joined.groupBy("stage", now.alias("status")).agg(F.count("*").cast("long").alias("n"))
