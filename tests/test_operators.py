import json
import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import stats
from tokenloom.functions import text as fx
from tokenloom.operators import accuracy, bins, code, compare, correlation, glm, joins, markup, metrics, models, sampling, units
from tokenloom.operators import tokens as tok
from tokenloom.schema import TOKENS, conform
from tokenloom.sources import readers, writers

K = ["dataset", "uid"]


def token_frame(spark, strings, entropies, **more):
    rows = [("d", "u", k, t, e, 1.0, 1) for k, (t, e) in enumerate(zip(strings, entropies, strict=True))]
    return spark.createDataFrame(rows, "dataset string, uid string, idx long, token_str string, metric_entropy double, metric_surprisal double, line long")


def test_units_of_two_lines(spark):
    strings = ["x", "▁=", "▁1", "▁", "<0x0A>", "y", "▁=", "▁2"]
    t = units.clean(token_frame(spark, strings, [0.1, 0.8, 0.1, 0.1, 0.1, 0.1, 0.7, 0.1]), K)
    got = units.unit_counts(t, K, {"a": 0.67, "b": 1.0}).first()
    assert (got["num_semantic_units_a"], got["num_semantic_units_b"]) == (3, 1)
    rows = {r["su"]: r["n_tokens"] for r in units.unit_rows(t, K, 0.67).collect()}
    assert rows == {0: 0, 1: 5, 2: 3}  # a boundary on the first line leaves unit 0 empty


def test_first_token_and_missing_entropy_do_not_trigger(spark):
    t = units.clean(token_frame(spark, ["a", "b", "c"], [9.0, float("nan"), None]), K)
    assert units.unit_counts(t, K, {"a": 1.0}).first()[2] == 1


def test_conform_fills_and_cleans(spark):
    df = conform(spark.createDataFrame([(1, float("nan"))], "idx long, metric_entropy double"), TOKENS)
    assert df.first()["metric_entropy"] is None and df.columns[: len(TOKENS.names)] == TOKENS.names


def test_tree_metrics(spark):
    rows = [("d", "u", 0, None, 1), ("d", "u", 1, 0, 2), ("d", "u", 2, 0, 2), ("d", "u", 3, 2, 3)]
    m = metrics.tree_metrics(spark.createDataFrame(rows, "dataset string, uid string, node_id long, parent_id long, depth long"), K).first()
    assert math.isclose(m["lm_cc"], 8 * 0.2 + 3 * 0.8) and m["max_width"] == 2 and m["avg_children"] == 1.5


def test_frequency_table(spark):
    df = spark.createDataFrame([(0, 0.2, 1.0), (4, 0.4, 1.0), (5, 0.5, 1.0), (9, 0.7, 1.0), (10, 0.8, 1.0)], "num_semantic_units long, pass_at_1 double, lm_cc double")
    rows = bins.frequency_table(df, [], 5).orderBy("bin_start").collect()
    assert len(rows) == 41 and [r["n"] for r in rows[:4]] == [2, 2, 1, 0]
    assert [round(r["pass_at_1_mean"], 6) for r in rows[:3]] == [0.3, 0.6, 0.8] and rows[2]["pass_at_1_std"] is None


def test_scores_are_checked(spark, tmp_path):
    assert readers.parse_scores('{"a": {"task_id": "a", "pass@1": 0.5}, "b": {}}', "nested") == {"a": 0.5}
    for bad in ('{"a": 1, "a": 0}', '{"a": 1.1}', '{"a": NaN}', '{"a": "1"}', '{"a": -0.1}', '{"a": true}'):
        with pytest.raises(ValueError):
            readers.parse_scores(bad, "simple")
    with pytest.raises(ValueError):
        readers.parse_scores('{"a": {"task_id": "b", "pass@1": 1}}', "nested")
    p = tmp_path / "s.json"
    p.write_text('{"a__1": {"pass@1": 1}, "b": {}}')
    assert [tuple(r) for r in readers.scores(spark, str(p), "nested", "d").collect()] == [("d", "a__1", 1.0)]
    assert [tuple(r) for r in readers.scores(spark, str(p), "nested", "d", legacy=True).collect()] == [("d", "b", 0.0)]


def test_unique_keys(spark):
    df = spark.createDataFrame([("d", "a"), ("d", "a")], "dataset string, uid string")
    with pytest.raises(Exception, match="twice"):
        joins.assert_unique(df, K).collect()


def test_text_functions(spark):
    df = spark.createDataFrame([("x <<<Output>>> no <<<Output>>>\"a b\"[END-OF-RESPONSE] y", "u12__3", ["a", "▁b", "<0xC3>", "<0xA9>"], 0.004)], "r string, u string, t array<string>, p double")
    r = df.select(fx.plain_answer(fx.answer_of(F.col("r"))), fx.base_id(F.col("u")), fx.first_number(F.col("u")), fx.decode_tokens(F.col("t")), fx.significance(F.col("p"))).first()
    assert tuple(r) == ("ab", "u12", 12.0, "a bé", "<0.01 ")
    with pytest.raises(Exception, match="multiple"):
        spark.range(1).select(fx.recovered_count(F.lit(0.3), F.lit(7))).collect()


def test_answers_and_outputs(spark):
    rows = [("<<<Output>>> 'a b'[END-OF-RESPONSE] x", '"ab"', True), ("`7`\n", "7", True), ("<<<Output>>>3 [END-OF -RESPONSE]", "3", True), ("[1, 2]", "[1,2]", True), ("<<<Output>>>[END-OF-RESPONSE]7", "7", False), (None, "7", False)]
    got = accuracy.score_answers(spark.createDataFrame(rows, "response string, truth string, want boolean")).collect()
    assert all(r["correct"] == r["want"] for r in got)
    outs = [(" 3\t\n", ["3"], True), ("3", ["3", "4"], False), ("", [], True), (" \n", [], True), ("", [""], False), ("3 ", ["3 "], False), ("3", [], False)]
    got = spark.createDataFrame(outs, "o string, e array<string>, want boolean").select(fx.same_output(F.col("o"), F.col("e")).alias("same"), "want").collect()
    assert all(r["same"] == r["want"] for r in got)
    trials = spark.createDataFrame([("a", "scored", True), ("a", "scored", False), ("b", "scored", True), ("b", "error", None)], "uid string, status string, correct boolean")
    assert {r["uid"]: r["pass_at_1"] for r in accuracy.pass_rates(trials, ["uid"]).collect()} == {"a": 0.5, "b": None}


def test_paths(spark):
    paths = ["/Users/x/y/data/humaneval/HumanEval_0.py", "/nonexistent/file.py", "/a/data/b/data/c.py"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(readers.relative_data_path(F.col("p"))).collect()
    assert [r[0] for r in got] == ["humaneval/HumanEval_0.py", "/nonexistent/file.py", "c.py"]


def test_reproduction_status(spark):
    errors = {"same": [0.0] * 9, "small": [0.005] * 9, "one": [0.05] + [0.0] * 8, "short": [0.0]}
    own = spark.createDataFrame([("d", u, k, float(k % 4)) for u, e in errors.items() for k in range(len(e))], "dataset string, uid string, pos long, entropy double")
    prior = spark.createDataFrame([("d", u, k, k % 4 + x) for u, e in errors.items() for k, x in enumerate(e)], "dataset string, uid string, pos long, entropy double")
    assert {r["uid"]: r["status"] for r in compare.reproduction(prior, own, K).collect()} == {"same": "Perfect", "small": "Acceptable", "one": "Error"}


def test_verification(spark):
    row = lambda u, k, t, e: ("d", u, k, t, e)
    own = [row("a", 0, "x", 1.0), row("b", 0, "x", 1.0), row("b", 1, "y", None), row("c", 0, "x", None), row("e", 0, "x", 1.0)]
    base = [row("a", 0, "x", 1.0), row("b", 0, "x", 1.5), row("c", 0, "x", 1.0)]
    kind = "dataset string, uid string, pos long, token_str string, metric_entropy double"
    got = compare.verification(spark.createDataFrame(base, kind), spark.createDataFrame(own, kind), K)
    assert {r["status"]: r["n"] for r in got.collect()} == {"perfect": 1, "high_error": 1, "read_error": 1, "not_in_baseline": 1}


def test_pooled_percentiles(spark):
    rnd = np.random.default_rng(8)
    for x in (rnd.exponential(size=999), rnd.integers(0, 4, 500).astype(float), np.array([2.0]), np.array([5.0, 5.0, 5.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "metric_entropy double")
        got = {r["percentile"]: r["value"] for r in bins.entropy_percentiles(df).collect()}
        assert len(got) == 21 and all(math.isclose(v, np.percentile(x, p), rel_tol=1e-12) for p, v in got.items())
    assert bins.entropy_percentiles(spark.createDataFrame([], "metric_entropy double")).count() == 0


def test_distributions():
    assert math.isclose(stats.t_sf(2.0, 10), 0.03669401738537018, rel_tol=1e-9)
    assert math.isclose(stats.t_quantile(0.975, 5), 2.570581835636314, rel_tol=1e-9)
    assert math.isclose(stats.f_sf(3.0, 2, 10), 0.0953674316406251, rel_tol=1e-9)
    assert stats.correlation_p(1.0, 3) == 0.0 and stats.correlation_p(0.5, 0) is None
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])
    assert stats.outside_fraction(square, np.array([[0.5, 0.2], [2, 2]])) == 0.5 and math.isnan(stats.outside_fraction(square[:2], square))


def test_partial_correlation(spark):
    rnd = random.Random(2)
    rows = [("d", str(k), rnd.random(), float(rnd.randint(1, 60)), float(rnd.randint(1, 50))) for k in range(96)]
    df = spark.createDataFrame(rows, "dataset string, uid string, score double, metric double, loc double")
    b = correlation.buckets(df, ["dataset"], 8)
    got = correlation.with_p(correlation.bucket_correlation(b, ["dataset"], partial=True), 1).first()
    p = b.toPandas()
    x, y, z = (stats.average_ranks(p[c].to_numpy()) for c in ("median_metric", "mean_score", "median_control"))
    res = lambda v: v - np.polyval(np.polyfit(z, v, 1), z)
    want = np.corrcoef(res(x), res(y))[0, 1]
    assert math.isclose(got["r"], want, rel_tol=1e-9) and math.isclose(got["p"], stats.correlation_p(want, got["groups"] - 3), rel_tol=1e-9)


def test_sweep_by_running_sums(spark):
    rnd = random.Random(6)
    rows = [(g, f"{k:03d}", rnd.random(), float(rnd.randint(1, 40)), float(rnd.randint(1, 50))) for g, n in (("a", 97), ("b", 40), ("c", 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "dataset string, uid string, score double, metric double, loc double")
    for partial in (False, True):
        got = {(r["dataset"], r["min_cnt"]): r for r in correlation.sweep(df, ["dataset"], partial=partial).collect()}
        want = {}
        for g in "abc":
            n = sum(r[0] == g for r in rows)
            for size in range(max(1, n // 20), max(1, n // 8) + 1):
                if 9 <= n // size <= 11:
                    want[g, size] = correlation.bucket_correlation(correlation.buckets(df.where(F.col("dataset") == g), ["dataset"], size), ["dataset"], partial).first()
        assert got.keys() == want.keys() and len(got) >= 3
        assert all(got[k]["groups"] == w["groups"] and math.isclose(got[k]["r"], w["r"], rel_tol=1e-9) for k, w in want.items())


def test_hinges_are_least_squares(spark):
    rnd = np.random.default_rng(13)
    rows = [(g, float(x), float(0.9 - 0.02 * max(0, x - 20) + 0.1 * k + rnd.normal(0, 0.1))) for k, g in enumerate("ab") for x in rnd.integers(0, 50, 120)]
    df = spark.createDataFrame(rows, "dataset string, x double, y double").withColumn("scope", F.lit("all"))
    x, y, g = (np.array(v) for v in ([r[1] for r in rows], [r[2] for r in rows], [r[0] == "b" for r in rows]))

    def best(columns):
        fits = []
        for bp in np.linspace(*np.percentile(x, [5, 95]), 300):
            d = np.stack([*columns, x, np.maximum(0, x - bp)], axis=1)
            b = np.linalg.lstsq(d, y, rcond=None)[0]
            fits.append((round(((y - d @ b) ** 2).sum(), 9), bp, b))
        return min(fits, key=lambda f: f[0])

    one, two = models.hinge(df, ["scope"]).first(), models.hinge_by_dataset(df, ["scope"]).first()
    rss, bp, b = best([np.ones_like(x)])
    assert math.isclose(one["rss"], rss, abs_tol=1e-8) and math.isclose(one["bp"], bp) and np.allclose([one["a"], one["b"], one["c"]], b, rtol=1e-6)
    rss, bp, b = best([~g, g])
    assert math.isclose(two["rss"], rss, abs_tol=1e-8) and math.isclose(two["bp"], bp) and np.allclose([two["b"], two["c"]], b[2:], rtol=1e-6)
    flat = models.hinge(spark.createDataFrame([("g", 3.0, 0.5), ("g", 3.0, 0.7)], "g string, x double, y double"), ["g"]).first()
    assert math.isclose(flat["rss"], 0.02) and flat["b"] == flat["c"] == 0
    assert models._weighted_median(np.array([5.0, 1.0, 3.0]), np.array([2.0, 1.0, 1.0])) == 4.0


def test_curves(spark):
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 60, 300).astype(float)
    y = np.where(x < 25, 0.9, 0.4) + rnd.normal(0, 0.05, 300)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y}))
    line, step, hinge, logistic = (f(df, ["g"]).first() for f in (models.linear, models.step, models.hinge, models.logistic))
    b, a = np.polyfit(x, y, 1)
    assert math.isclose(line["rss"], ((y - a - b * x) ** 2).sum(), rel_tol=1e-9)
    assert 24 < step["bp"] <= 25 and step["rss"] < hinge["rss"] < line["rss"] and logistic["rss"] < step["rss"] * 1.02
    d = np.stack([np.ones_like(x), x, np.maximum(0, x - hinge["bp"])], axis=1)
    assert math.isclose(hinge["rss"], ((y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) ** 2).sum(), rel_tol=1e-6)


def test_fractional_logit(spark):
    rnd = np.random.default_rng(4)
    n = 400
    su, loc, cl = rnd.normal(0, 1, n), rnd.normal(0, 1, n), rnd.integers(0, 30, n)
    y = rnd.binomial(5, 1 / (1 + np.exp(-(0.3 + 0.5 * su - 0.4 * loc)))) / 5
    df = spark.createDataFrame(pd.DataFrame({"su": su, "logloc": loc, "interval": 0, "y": y, "cluster_id": cl}))
    names = glm.design_columns("B", 1)
    x = glm.design(df, names)
    beta, at = glm.fit(x, names)
    m = np.stack([np.ones(n), su, loc], axis=1)
    b = np.zeros(3)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-m @ b))
        b = b + np.linalg.solve((m * (mu * (1 - mu))[:, None]).T @ m, m.T @ (y - mu))
    assert np.allclose(beta, b, atol=1e-9)
    cov, g = glm.sandwich(x, beta, at)
    s = pd.DataFrame(m * (y - mu)[:, None]).groupby(cl).sum().to_numpy()
    bread = np.linalg.inv((m * (mu * (1 - mu))[:, None]).T @ m)
    assert np.allclose(cov, g / (g - 1) * (n - 1) / (n - 3) * bread @ (s.T @ s) @ bread, rtol=1e-7)
    p = glm.marginal_mean(x, beta, cov, g - 1)
    assert math.isclose(p["mean"], mu.mean(), rel_tol=1e-9) and p["low"] < p["mean"] < p["high"]
    assert glm.contrast(beta, cov, np.eye(3)[1], g - 1)["p"] < 0.01
    one = glm.wald(beta, cov, np.eye(3)[1:2], g - 1)
    assert math.isclose(one["p"], glm.contrast(beta, cov, np.eye(3)[1], g - 1)["p"], rel_tol=1e-6)


def test_separation():
    x = np.stack([np.ones(6), np.arange(6.0)], axis=1)
    assert glm.separated(x, np.array([0, 0, 0, 1, 1, 1.0])) and not glm.separated(x, np.array([0, 1, 0, 1, 0, 1.0])) and not glm.separated(x, np.full(6, 0.5))


def test_separation_has_a_proof_either_way():
    rng = np.random.default_rng(12)
    for k in range(60):
        n, p = int(rng.integers(4, 40)), int(rng.integers(1, 4))
        x = np.concatenate([np.ones((n, 1)), rng.normal(size=(n, p))], axis=1)
        d = rng.normal(size=p + 1)
        split = k % 2 == 0
        y = (x @ d > 0).astype(float) if split else (rng.random(n) < 0.5).astype(float)
        found = glm.separated(x, y)
        if split:
            assert found
        elif not found:  # then a finite fit exists: Newton steps settle
            b = np.zeros(p + 1)
            for _ in range(200):
                mu = 1 / (1 + np.exp(-x @ b))
                b = b + 0.5 * np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x + 1e-12 * np.eye(p + 1), x.T @ (y - mu))
            assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ b)))).max() < 1e-4
    assert not glm.separated(np.stack([np.ones(5000), rng.normal(size=5000)], axis=1), (rng.random(5000) < 0.5).astype(float))


def test_frozen_input(spark):
    from tokenloom.plans import audit

    kind = "dataset string, uid string, "
    m = spark.createDataFrame([("d", u, 10, su) for u, su in (("a", 1), ("b", 2), ("c", 3), ("e", 0), ("f", 4), ("g", 5))], kind + "loc long, num_semantic_units_p67 long")
    s = spark.createDataFrame([("d", u, v) for u, v in (("a", 0.2), ("b", 0.4), ("c", 1.0), ("e", 0.0), ("f", 0.6), ("x", 1.0))], kind + "score double")
    n = spark.createDataFrame([("d", u, 5, k) for u, k in (("a", 1), ("b", None), ("c", 5), ("e", 0), ("f", 3), ("g", 0))], kind + "n long, k long")
    c = spark.createDataFrame([("d", u, "x = 1", "x = 2" if u == "f" else "x  =  1") for u in "abcefg"], kind + "measured_code string, scored_code string")
    g = spark.createDataFrame([("d", u, "g") for u in "abcefg"], kind + "cluster_id string")
    got = audit.prepare(m, s, n, c, g, {"p67": 0.6813})
    assert {(r["uid"], r["k"], r["interval"]) for r in got["input"].collect()} == {("a", 1, 0), ("b", 2, 1), ("c", 5, 2)}
    assert {r["uid"]: r["reason"] for r in got["excluded"].collect()} == {"e": "missing or empty metric", "f": "code differs", "g": "no score", "x": "no metric row"}
    assert got["describe"].first()["n"] == 3 and len(got["config"]["key"]) == 16
    with pytest.raises(Exception, match="differ"):
        audit.prepare(m, s, n.withColumn("k", F.lit(2).cast("long")), c, g, {"p67": 0.6813})["input"].collect()
    trials = spark.createDataFrame([("d", "a", 1, True), ("d", "a", 2, False)], kind + "trial long, correct boolean")
    assert tuple(audit.trial_counts(trials).first())[2:] == (1, 2)
    report = audit.verify({"same": (m, m, K), "less": (m, m.where("uid <> 'a'"), K)})
    assert {(r["table"], r["column"]): r["agrees"] for r in report.collect()} == {("same", "loc"): True, ("same", "num_semantic_units_p67"): True, ("less", "loc"): False, ("less", "num_semantic_units_p67"): False}


def test_draw():
    rows = [(f"u{k:02d}", k % 11) for k in range(60)]
    assert sampling.exact_quantile([1, 2, 4], Fraction(1, 3)) == Fraction(5, 3)
    a = sampling.draw(rows, 7)
    assert a == sampling.draw(rows[::-1], 7) and sum(r[4] for r in a) == 10
    with pytest.raises(ValueError):
        sampling.draw(rows[:6], 7)


SOURCE = "def f(a, b):\n    if a > b:\n        # up\n        return a\n\n    else:\n        b += 1\n        return b\n"


def test_swap():
    r = code.first_swap(SOURCE)
    assert r["status"] == "ok" and r["method"] == "add_not_paren"
    assert r["text"] == "def f(a, b):\n    if not (a > b):\n        b += 1\n        return b\n        # up\n\n    else:\n        return a\n" or "not (a > b)" in r["text"]
    assert code.first_swap("if not x:\n    a = 1\nelse:\n    a = 2\n")["text"] == "if x:\n    a = 2\nelse:\n    a = 1\n"
    assert code.first_swap("if(x):\n    a = 1\nelse:\n    a = 2\n")["text"] == "if not (x):\n    a = 2\nelse:\n    a = 1\n"
    reasons = [c["reason"] for c in code.swap_candidates("if a: b = 1\nelse:\n    b = 2\nif a:\n    b = 1\nif a:\n    b = 1\nelif c:\n    b = 2\n")]
    assert reasons == ["body on the line of if", "no else", "has elif"]


def test_statements_and_owners():
    s = code.statements(SOURCE)
    assert [(x["node_type"], x["parent"], x["depth"]) for x in s] == [("FunctionDef", -1, 0), ("If", 0, 1), ("Return", 1, 2), ("AugAssign", 1, 2), ("Return", 1, 2)]
    starts = [0, SOURCE.index("if"), SOURCE.index("return a"), SOURCE.index("b +=")]
    assert [o["owner_type"] for o in code.assign_tokens(starts, SOURCE)] == ["FunctionDef", "If", "Return", "AugAssign"]
    found = code.align_statements(s, code.statements(SOURCE.replace("b += 1", "b += 2")))
    assert [p["match"] for p in found["pairs"]][:3] == ["same_head", "same_head", "same_subtree"] and len(found["only_before"]) == 1


def test_runs_are_the_longest():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = (np.array([rnd.randint(0, 4) for _ in range(rnd.randint(0, 12))], int) for _ in "ab")
        runs = code.common_runs(a, b)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in runs)
        assert all(i + n <= k and j + n <= m for (i, j, n), (k, m, _) in zip(runs, runs[1:], strict=False))
        longest = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if (a[i : i + n] == b[j : j + n]).all()), default=0)
        assert max((n for _, _, n in runs), default=0) == longest


def test_complexity():
    assert code.cognitive("if a:\n    pass\nelif b:\n    if c:\n        pass\n") == 4
    assert code.cognitive("if a:\n    pass\nelif b:\n    pass\nelif c:\n    if d:\n        pass\n") == 5
    assert code.cyclomatic("def f(a):\n    if a and a > 1:\n        return 1\n    for i in a:\n        pass\n") == 4
    assert code.cognitive("def f(a):\n    if a:\n        for i in a:\n            if i:\n                pass\n    else:\n        pass\n") == 10  # the wrapped file nests the function
    assert code.without_comments('def f():\n    """doc"""\n    # c\n    return "#"  # d\n') == 'def f():\n    return "#"'
    assert code.cyclomatic("def (") is None and code.cognitive(" ") is None
    assert code.code_match("a=1", "a = 1 # x") == "ast_equal" and code.code_match("a", None) == "missing"


def test_sources_beyond_the_parsers_stack():
    deep = "not " * 20000 + "x"  # the parser runs out of its stack, a MemoryError
    assert code.code_match(deep, deep + " !") == "different" and code.code_match(deep, deep) == "exact"
    assert code.cyclomatic(deep) is None and code.cognitive(deep) is None and code.maintainability(deep) is None


def test_block_tree_of_a_construct():
    nodes, n = code.block_tree(["x", "=", "1", "<0x0A>", "if", "▁x", ":", "<0x0A>", "▁▁▁▁", "y", "<0x0A>", "else", ":", "<0x0A>", "▁▁▁▁", "z"], [None, 0.9, 0, 0, 0.9, 0, 0, 0, 0, 0, 0, 0.9, 0, 0, 0, 0], 0.67)
    assert n == 4 and [(x["depth"], x["start_line"], x["end_line"]) for x in nodes] == [(1, 1, 5), (2, 1, 1), (2, 2, 5), (3, 4, 5)]


def test_behaviour_precedence(spark):
    rows = [("a", "1", True, False), ("b", "1", False, False), ("b", "2", True, True), ("c", "1", True, True), ("d", None, None, None)]
    got = accuracy.behaviour(spark.createDataFrame(rows, "uid string, case_id string, equal boolean, timeout boolean"), ["uid"])
    assert {r["uid"]: r["status"] for r in got.collect()} == {"a": "match", "b": "mismatch", "c": "unverified", "d": "unverified"}


def test_running_code_is_opt_in(spark):
    p = spark.createDataFrame([("u", "1", "print(input())", "hi\n"), ("u", "2", "1/0", ""), ("u", "3", "while 1: pass", "")], "uid string, case_id string, code string, stdin string")
    with pytest.raises(PermissionError):
        accuracy.run_cases(p, ["uid"])
    got = {r["case_id"]: r for r in accuracy.run_cases(p, ["uid"], allow=True, timeout=2).collect()}
    assert got["1"]["stdout"] == "hi\n" and got["2"]["exception"] == "ZeroDivisionError" and got["3"]["timeout"]


def test_called_expressions(spark):
    rows = [("u", "1", "def f(a, b):\n    print('in f')\n    return a + b", "f", ["1", "2"]), ("u", "2", "def f(a):\n    return 1 / a", "f", ["0"]), ("u", "3", "def g(s):\n    return s[::-1]", "g", ["'ab\\n'"])]
    t = accuracy.call_expressions(spark.createDataFrame(rows, "uid string, case_id string, code string, entry string, args array<string>"))
    with pytest.raises(PermissionError):
        accuracy.run_calls(t, ["uid"])
    got = {r["case_id"]: r for r in accuracy.run_calls(t, ["uid"], allow=True).collect()}
    assert (got["1"]["value"], got["1"]["stdout"]) == ("3", "in f\n") and got["2"]["exception"] == "ZeroDivisionError" and got["2"]["value"] is None
    assert got["3"]["value"] == "\nba"


def test_targets(spark):
    work = spark.createDataFrame([(u, v) for u in "abc" for v in ("v1", "v2")], "uid string, variant_id string")
    pick = lambda t: {tuple(r) for r in joins.selected(work, t).collect()}
    assert pick(["a:v1", "b"]) == {("a", "v1"), ("b", "v1"), ("b", "v2")} and pick(["a:v1", "a"]) == {("a", "v1"), ("a", "v2")} and len(pick([])) == 6


def test_tree_documents(spark):
    t = spark.createDataFrame([("d", "u", k, s, e) for k, (s, e) in enumerate([("x", None), ("<0x0A>", 0.9), ("y", 0.9), ("<0x0A>", 0.0), ("z", 0.0)])], "dataset string, uid string, pos long, token_str string, metric_entropy double")
    nodes = code.block_trees(t, K, 0.67)
    tree = json.loads(code.tree_documents(nodes, K).first()["tree"])
    rows = code.block_tree(["x", "<0x0A>", "y", "<0x0A>", "z"], [None, 0.9, 0.9, 0.0, 0.0], 0.67)[0]
    assert tree == json.loads(code.tree_json(rows)) and tree["start_line"] == 1 and tree["children"]


def test_token_positions(spark):
    t = tok.tokenize(spark.createDataFrame([("d", "u", "ab\tc\n  d")], "dataset string, uid string, text string"), K).orderBy("pos").collect()
    assert [(r["tok"], r["char_start"], r["line"], r["column"]) for r in t] == [("ab", 0, 1, 0), ("c", 3, 1, 3), ("\n", 4, 1, 4), ("  d", 5, 2, 0)]
    assert [r["token_id"] for r in t] == [3, 4, 5, 6]
    odd = tok.tokenize(spark.createDataFrame([("d", "u", "a\u00a0b \u0663\u0664 é\x1c\r\n")], "dataset string, uid string, text string"), K).orderBy("pos").collect()
    assert [(r["tok"], r["char_start"]) for r in odd] == [("a", 0), ("b", 2), (" \u0663\u0664", 3), (" ", 6), ("é", 7), ("\n", 10)]


def test_one_pass_gives_what_windows_give(spark):
    rnd = random.Random(9)
    rows = [("d", f"u{k}", "".join(rnd.choice(["a", " b1", "\n", "  ", "é", ", ", "x_y"]) for _ in range(rnd.randint(0, 80)))) for k in range(20)] + [("d", "none", None)]
    docs = spark.createDataFrame(rows, "dataset string, uid string, text string")
    t = tok.tokenize(docs, K)
    w = tok.dummy_metrics(units.segments(tok.paragraph_attributes(tok.dummy_metrics(t, K), K), K), K, window=["function_id"], isolated=True)
    m = tok.measure(docs, K)
    order = sorted(m.columns)
    assert sorted(map(tuple, m.select(*order).collect())) == sorted(map(tuple, w.select(*order).collect()))
    by_line = compare.line_stats(m, K, {"a": 1.0, "b": 2.5})
    owned = units.unit_of_token(m, K, 2.5).groupBy(*K, "line").agg(F.count_if("trigger").alias("t"), F.bool_or("trigger").alias("b"), F.min_by("su", "pos").alias("su"))
    assert sorted(map(tuple, by_line.select(*K, "line", "triggers_b", "boundary_b", "su_b").collect())) == sorted(map(tuple, owned.collect()))


def test_span_starts(spark):
    t = tok.tokenize(spark.createDataFrame([("d", "u", "ab cd" + "x" * 700 + " e")], "dataset string, uid string, text string"), K)
    spans = spark.createDataFrame([("d", "u", k) for k in (3, 600, 705)], "dataset string, uid string, span_start long")
    assert [r["is_function_start"] for r in tok.starts_span(t, spans, K).orderBy("pos").collect()] == [False, True, True]


def test_package(tmp_path, spark):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "t.json").write_text("[1, 2]")
    (tmp_path / "manifest.json").write_text(json.dumps([{"case_id": "c", "original": "a.py", "transformed": "a.py", "tests": "t.json", "test_count": 2}]))
    assert readers.package_cases(spark, str(tmp_path)).first()["test_count"] == 2
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            readers.safe_member(bad)


def test_sinks(tmp_path, spark):
    df = spark.createDataFrame([("d", "u10", 1.0), ("d", "u9", 2.0), ("d", "x", 3.0)], "dataset string, uid string, ppl double")
    writers.write_summary(df, str(tmp_path / "s"))
    got = spark.read.csv(str(tmp_path / "s"), header=True).collect()
    assert [r["uid"] for r in got] == ["u9", "u10", "x"]
    with pytest.raises(Exception):
        writers.write_summary(df, str(tmp_path / "s"))
    r = writers.receipt(spark, str(tmp_path / "s"))
    assert writers.verify_receipt(r, r).count() == 0
    assert "<td>" in writers.html_report("t", [{"orig_line": 1, "text_before": "a<b", "new_line": 1, "text_after": "a", "status": "same"}])


def test_experiment(tmp_path, spark):
    from tokenloom.plans.experiment import Experiment

    e = Experiment(spark, str(tmp_path), {"a": 1})
    work = spark.createDataFrame([("k1",), ("k2",)], "key string")
    step = lambda w: w.select("key", F.when(F.col("key") == "k1", "ok").otherwise("failed").alias("status"), F.lit("").alias("detail"))
    assert e.run("measure", work, step).count() == 2 and e.pending("measure", work).count() == 0
    assert [r["key"] for r in e.pending("measure", work, retry_failed=True).collect()] == ["k2"]
    expected = spark.createDataFrame([("measure", "k1"), ("compare", "k1")], "stage string, key string")
    assert {(r["stage"], r["status"]) for r in Experiment(spark, str(tmp_path), {"a": 2}).counts(expected).collect()} == {("measure", "stale"), ("compare", "not_run")}


def test_stream(tmp_path, spark):
    from tokenloom.streaming import summaries

    src = tmp_path / "in" / "d"
    src.mkdir(parents=True)
    t = conform(spark.createDataFrame([(0, "a", 1.0, 1.0, 1), (1, "b", 3.0, 1.0, 1)], "idx long, token_str string, metric_entropy double, metric_surprisal double, line long"), TOKENS)
    pq.write_table(t.select(*TOKENS.names).toArrow(), src / "result_u.parquet")
    q = summaries.summarise(summaries.token_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), {"p": 2.0})
    q.awaitTermination(120)
    row = summaries.latest(spark, str(tmp_path / "out")).first()
    assert row["uid"] == "u" and row["num_semantic_units_p"] == 2


def test_alignment_and_repeatability(spark):
    m = spark.createDataFrame([("d", "u", 1, 1)], "dataset string, uid string, orig_line long, new_line long")
    side = lambda toks: spark.createDataFrame([("d", "u", 1, k, t, 1.0) for k, t in enumerate(toks)], "dataset string, uid string, line long, pos long, token_str string, metric_entropy double")
    got = compare.align_tokens(m, side(["a", "b", "c"]), side(["a", "c", "d"]), K)
    assert sorted((r["token_str"], r["status"]) for r in got.collect()) == [("a", "equal"), ("b", "only_before"), ("c", "equal"), ("d", "only_after")]


def _rows_and_files(spark, columns):
    """Tokens of four texts as rows and as files, one text empty, one with a second version's line."""
    texts = [("d", "a", "one two  one\nthree 4 five\n\n six"), ("d", "b", ""), ("d", "c", "x"), ("d", "e", "one\ttwo\nü three three\n" * 3)]
    docs = spark.createDataFrame(texts, "dataset string, uid string, text string")
    return docs, tok.measure(docs, K, form="md5"), tok.by_file(docs, K, form="md5", columns=columns)


def test_files_of_tokens_hold_what_rows_hold(spark):
    columns = ["pos", "tok", "token_str", "char_start", "seg", "metric_entropy", "function_id", "metric_isolated_surprisal"]
    _, rows, held = _rows_and_files(spark, columns)
    flat = held.select(*K, F.inline(F.arrays_zip(*columns)))
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, rows.select(*K, *columns).collect()))
    assert {r["uid"] for r in held.collect()} == {"a", "c", "e"}  # as rows, a text without tokens has nothing


def test_comparisons_of_files_equal_those_of_rows(spark):
    _, rows, held = _rows_and_files(spark, ["token_str", "metric_entropy", "metric_surprisal"])
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    # repetitions: the second has another token in one file and one token less in another
    other = F.when(F.col("uid") == "a", F.when(F.col("pos") == 2, F.lit("?")).otherwise(F.col("token_str"))).otherwise(F.col("token_str"))
    second = rows.withColumn("token_str", other).withColumn("metric_entropy", F.col("metric_entropy") + 0.25 * (F.col("pos") == 3).cast("int")).where("not (uid = 'e' and pos = 9)")
    r = rows.withColumn("repetition", F.lit(0)).unionByName(second.withColumn("repetition", F.lit(1)))
    listed = F.array_sort(F.collect_list(F.struct("pos", "token_str", "metric_surprisal", "metric_entropy")))
    packed = r.groupBy(*K, "repetition").agg(listed.alias("x")).select(*K, "repetition", "x.token_str", "x.metric_surprisal", "x.metric_entropy")
    got, want = compare.repeatability(packed, K), compare.repeatability(r, K)
    assert {x["uid"]: x["same_tokens"] for x in got.collect()} == {x["uid"]: x["same_tokens"] for x in want.collect()} == {"a": False, "c": True, "e": False}
    assert {x["uid"]: x["max_abs_difference"] for x in got.where("uid <> 'e'").collect()} == {x["uid"]: x["max_abs_difference"] for x in want.where("uid <> 'e'").collect()}
    # errors against prior values, with missing entropies
    own = held.select(*K, F.transform("metric_entropy", lambda e, k: F.when(k != 1, e)).alias("entropy"))
    prior = held.select(*K, F.transform("metric_entropy", lambda e, k: e + k % 2 * 0.001).alias("entropy"))
    as_rows = lambda df: df.select(*K, F.posexplode("entropy").alias("pos", "entropy"))
    found = compare.reproduction(prior, own, K)
    assert same(found, compare.reproduction(as_rows(prior), as_rows(own), K)) and {x["uid"] for x in found.collect()} == {"a", "e"}
    base = lambda df: df.where("uid <> 'c'")
    assert same(compare.verification(base(held), held, K), compare.verification(base(rows), rows, K))


def test_places_in_files_equal_those_in_rows(spark):
    docs, rows, held = _rows_and_files(spark, ["char_start", "tok"])
    spans = spark.createDataFrame([("d", "a", 0, 7, 0, 20), ("d", "a", 1, 8, 4, 9), ("d", "a", 2, 9, 4, 6), ("d", "a", 3, 5, 15, 15), ("d", "e", 0, 1, 6, 30)], "dataset string, uid string, span_ord long, span_id long, span_start long, span_end long")
    own = tok.innermost(held, spans, K).select(*K, F.inline(F.arrays_zip("char_start", "owner", "owner_depth")))
    want = tok.innermost(rows, spans, K).select(*K, "char_start", "owner", "owner_depth")
    assert sorted(map(str, own.collect())) == sorted(map(str, want.collect()))
    starts = tok.starts_span(held, spans, K).select(*K, F.inline(F.arrays_zip("char_start", "is_function_start")))
    assert sorted(map(str, starts.collect())) == sorted(map(str, tok.starts_span(rows.drop("is_function_start"), spans, K).select(*K, "char_start", "is_function_start").collect()))
    windows = spark.createDataFrame([("d", "a", 0, 4, 1.0), ("d", "a", 1, 4, 2.0), ("d", "a", 1, 99, 3.0), ("d", "c", 0, 0, 4.0)], "dataset string, uid string, ord long, char_start long, metric_isolated_surprisal double")
    lists = windows.groupBy(*K).agg(*(F.collect_list(c).alias(c) for c in ("ord", "char_start", "metric_isolated_surprisal")))
    got = tok.isolated_windows(held.select(*K, "char_start"), lists, K).select(*K, F.inline(F.arrays_zip("char_start", "metric_isolated_surprisal")))
    want = tok.isolated_windows(rows.select(*K, "char_start"), windows, K).select(*K, "char_start", "metric_isolated_surprisal")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_regions_of_lines_equal_those_of_tokens(spark):
    docs, rows, _ = _rows_and_files(spark, ["tok"])
    m = docs.where("uid <> 'b'").select(*K, F.lit(1).cast("long").alias("orig_line"), F.lit(1).cast("long").alias("new_line"), F.lit("condition").alias("region"))
    rows = rows.withColumn("file", F.col("uid"))
    t = compare.with_regions(rows, m, K).withColumn("trigger_p", units.trigger(1.0))
    lines = compare.with_regions(compare.line_sums(rows, K, {"p": 1.0}), m, K)
    fixed = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert fixed(compare.region_table(t, t, ["dataset"], "p")) == fixed(compare.region_table(lines, lines, ["dataset"], "p"))


def test_unit_rows_count_their_triggers(spark):
    _, rows, _ = _rows_and_files(spark, ["tok"])
    got = units.unit_rows(rows, K, 1.0).collect()
    assert got and all(r["n_triggers"] == len(r["triggers"] or []) for r in got) and any(r["n_triggers"] for r in got)
    counts = units.unit_counts(rows, K, {"p": 1.0}, loc=True)
    want = rows.groupBy(*K).agg(F.max("line").alias("loc"))
    assert {(r["uid"], r["loc"]) for r in counts.collect()} == {(r["uid"], r["loc"]) for r in want.collect()}


def test_alignment_trees_and_markup_of_files_equal_those_of_rows(spark):
    columns = ["pos", "tok", "token_str", "line", "char_start", "metric_entropy"]
    docs, rows, held = _rows_and_files(spark, columns)
    later = docs.withColumn("text", F.replace("text", F.lit("three"), F.lit("3 x")))
    m = rows.select(*K, F.col("line").alias("orig_line"), F.col("line").alias("new_line")).distinct()
    want = compare.align_tokens(m, rows, tok.measure(later, K, form="md5"), K)
    got = compare.align_tokens(m, held, tok.by_file(later, K, form="md5", columns=columns), K)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and {r["status"] for r in got.collect()} == {"equal", "only_before", "only_after"}
    assert sorted(map(str, code.block_trees(held, K, 1.0).collect())) == sorted(map(str, code.block_trees(rows, K, 1.0).collect()))
    assert sorted(map(str, markup.highlighted(docs, held, K).collect())) == sorted(map(str, markup.highlighted(docs, rows, K).collect()))


def test_sources_are_parsed_once_with_the_same_numbers():
    source = "def f(a):\n    def g():\n        return 1 if a else 2\n    if a and g() or a:\n        return g\n\nclass A:\n    def h(self):\n        for x in self: pass\n"
    nodes, found = code.syntax(source)
    assert nodes == code.node_spans(source) and found == code.functions(source) and [f["name"] for f in found] == ["f", "g", "h"]
    assert code._complexity(source, "sum") == (code.cyclomatic(source), code.cognitive(source), code.halstead_difficulty(source), code.maintainability(source))
    assert code.cyclomatic(source) == 8 and code._complexity("def f(:", "sum")[0] is None  # three functions and five points
