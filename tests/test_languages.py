"""C and Java syntax, maintainability, eligibility, weighted trees, and logistic curves by rounds over Spark."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import code, languages, metrics, models, sampling, syntax

K = ["dataset", "uid"]

C = """#include <stdio.h>
/* a comment { */
struct point { int x; int y; } origin;
static const int table[] = { 1, 2, 3 };

static int *find(struct point *p, int n) {
    const char *s = "a } \\" b";
    unsigned x = 0;
    point_t *q = p;
    for (int i = 0; i < n; i++)
        if (p[i].x == ';') { return &table[i]; } else x *= 2;
    do { x--; } while (x);
    switch (n) {
    case 1: x = 1; break;
    default: goto done;
    }
done:
    return 0;
}
int main(void) { return find(0, 0) != 0; }
"""

JAVA = """package a.b;
import java.util.*;
@Deprecated
public class Box<T> extends Base {
    private final Map<String, List<T>> held = new HashMap<>();
    public Box(int n) { super(n); }
    @Override public String name(T t) throws IOException {
        List<T> all = new ArrayList<>();
        for (T x : all) { if (x == null) continue; }
        Runnable r = () -> { work("} // no"); };
        Thread k = new Thread() { public void run() { go(); } };
        try (Reader in = open()) { in.read(); } catch (IOException e) { throw e; } finally { close(); }
        all.add(t);
        outer: while (true) break outer;
        return "x";
    }
    enum Kind { A, B }
    static { init(); }
}
"""


def found(source, language):
    nodes, functions = languages.syntax(source, language)
    return [(n["ast_type"], n["nesting_depth"], source[n["start"] : n["end"]]) for n in nodes if n["statement"]], [(f["name"], source[f["start"] : f["end"]]) for f in functions], nodes


def test_c():
    statements, functions, nodes = found(C, "c")
    assert [n for n, _ in functions] == ["find", "main"] and functions[0][1].startswith("static int *find") and functions[0][1].endswith("}")
    kinds = [(k, d) for k, d, _ in statements]
    assert kinds == [
        ("declaration", 0), ("declaration", 0), ("compound_statement", 0), ("declaration", 1), ("declaration", 1), ("declaration", 1), ("for_statement", 1), ("if_statement", 1),
        ("compound_statement", 1), ("return_statement", 2), ("expression_statement", 1), ("do_statement", 1), ("compound_statement", 1), ("expression_statement", 2), ("switch_statement", 1),
        ("compound_statement", 1), ("expression_statement", 2), ("break_statement", 2), ("goto_statement", 2), ("labeled_statement", 1), ("return_statement", 1), ("compound_statement", 0), ("return_statement", 1),
    ]
    assert next(t for k, _, t in statements if k == "if_statement").endswith("else x *= 2;") and ("do_statement", 1, "do { x--; } while (x);") in statements
    assert any(n["ast_type"] == "comment" for n in nodes) and any(n["ast_type"] == "char_literal" for n in nodes)


def test_java():
    statements, functions, _ = found(JAVA, "java")
    assert [n for n, _ in functions] == ["Box", "name", "run"] and functions[1][1].startswith("@Override public")
    kinds = [k for k, _, _ in statements]
    assert kinds[:3] == ["block", "expression_statement", "block"] and "enhanced_for_statement" in kinds and "try_statement" in kinds and "throw_statement" in kinds and "labeled_statement" in kinds
    assert kinds.count("local_variable_declaration") == 3 and ("expression_statement", 1, "all.add(t);") in statements
    assert ("expression_statement", 2, 'work("} // no");') in statements and ("expression_statement", 2, "go();") in statements and next(t for k, _, t in statements if k == "try_statement").endswith("{ close(); }")


def test_islands_in_odd_sources(spark):
    for bad in ("int f( {", "}", "int f() { ( } )"):
        with pytest.raises(ValueError):
            languages.syntax(bad, "c")
    for odd in ("", ";;", "#define X {\n", "int", "f()", "x = {1, {2}};", 'extern "C" { int g(void) { } }', "enum e { A, B };", "int f() { if (x) }", "int f() { do } ", "MACRO(x) int h(int a) { for (;;) ; else ; case 1: }"):
        languages.syntax(odd, "c")
        languages.syntax(odd, "java")
    docs = spark.createDataFrame([("d", "a", "int f(int n) {\n  return n;\n}\n"), ("d", "b", "int f( {"), ("d", "c", None)], "dataset string, uid string, text string")
    rows = syntax.syntax_rows(docs, K, language="c").orderBy("uid", "pos").collect()
    by = {r["tok"].strip(): r for r in rows if r["uid"] == "a"}
    assert by["return"]["ast_type"] == "return" and by["return"]["nesting_depth"] == 1 and by["return"]["is_statement_start"] and by["return"]["function_id"] == "f" and by["int"]["function_id"] == "f"
    assert [r["tok"] for r in rows if r["is_function_start"]] == ["int"] and all(r["ast_type"] is None for r in rows if r["uid"] == "b") and not any(r["uid"] == "c" for r in rows)
    with pytest.raises(ValueError):
        syntax.syntax_rows(docs, K, language="cobol")


def test_maintainability():
    index = lambda volume, points, lines, share: round(min(max((171 - 5.2 * math.log(volume) - 0.23 * points - 16.2 * math.log(lines) + 50 * math.sin(math.sqrt(2.46 * math.radians(share)))) * 100 / 171, 0), 100), 2)
    assert code.maintainability("x = 1\n") == 100.0 == code.maintainability("") and code.maintainability("def (") is None
    assert code.maintainability("a = b + c\n") == index(3 * math.log2(3), 1, 1, 0)
    assert code.maintainability("# n\nif a > 0: a += 1\nelse:\n    a = -a\n") == index(8 * math.log2(3 + 3), 2, 4, 100 / 3)
    assert code.maintainability("def f(a):\n    return a + 1\ndef g(a):\n    return a + 1\n") == index(6 * math.log2(1 + 4), 1, 4, 0)


def test_eligibility(spark):
    text = {"ok": "if a:\n    x = 1\nelse:\n    x = 2\n", "none": "x = 1\n", "bare": "if a:\n    x = 1\nif b:\n    y = 1\nelif c:\n    y = 2\n", "broken": "def (", "untested": "if a:\n    x = 1\nelse:\n    x = 2\n", "c": "int x;"}
    docs = spark.createDataFrame([("d", u, t) for u, t in text.items()], "dataset string, uid string, text string")
    records = docs.select(*K, F.when(F.col("uid") == "c", "C").otherwise("Python").alias("lang_cluster"), F.when(F.col("uid") != "untested", 2).alias("n_tests"))
    got = {r["uid"]: r for r in sampling.eligibility(records, code.swap_table(docs, K, first=True), K).collect()}
    assert {u: r["reason"].split(": ")[0] for u, r in got.items()} == {"ok": "eligible", "none": "no_applicable_if_else", "bare": "no_applicable_if_else", "broken": "python_parse_failed", "untested": "missing_or_invalid_hidden_tests", "c": "not_python"}
    assert got["ok"]["if_line"] == 1 and got["ok"]["eligible"] and got["bare"]["reason"] == "no_applicable_if_else: has elif; no else" and got["none"]["reason"].endswith("no_if")


def test_weighted_width(spark):
    rows = [("d", "u", 0, None, 1, 1.0), ("d", "u", 1, 0, 2, 2.5), ("d", "u", 2, 0, 2, None), ("d", "u", 3, 2, 3, 3.0)]
    nodes = spark.createDataFrame(rows, "dataset string, uid string, node_id long, parent_id long, depth long, weight double")
    assert metrics.tree_metrics(nodes, K, "weight").first()["max_width"] == 3.5 and metrics.tree_metrics(nodes, K).first()["max_width"] == 2


def test_logistic_rounds_meet_the_one_task_form(spark):
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 50, 400).astype(float)
    by = np.where(np.arange(400) % 3 == 0, "p", "q")
    y = np.clip(0.9 - 0.5 / (1 + np.exp(-0.3 * (x - 20))) + np.where(by == "q", 0.1, 0) + rnd.normal(0, 0.05, 400), 0, 1)
    df = spark.createDataFrame(pd.DataFrame({"g": np.where(np.arange(400) < 150, "a", "b"), "x": x, "y": y, "dataset": by}))
    for intercepts in (None, "dataset"):
        one, many = ({r["g"]: r for r in models.logistic(df, ["g"], intercepts=intercepts, one_task=n).collect()} for n in (10**6, 0))
        for g in "ab":
            assert one[g]["n"] == many[g]["n"] and math.isclose(one[g]["rss"], many[g]["rss"], rel_tol=1e-5)
    c = models.model_comparison(df.drop("g"), "dataset", 30, "p").collect()
    assert {(r["scope"], r["model"]) for r in c} == {(s, m) for s in ("all", "p", "q") for m in ("linear", "hinge", "step", "logistic")} | {("all_dataset_controlled", f"{m}_ds") for m in ("linear", "hinge", "logistic")}
    assert all(r["delta_aic"] >= 0 for r in c)
