"""Markup of token tables, and the small sinks beside it."""

import html
import json
import re

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.text import fixed
from tokenloom.operators import code, compare, markup, syntax
from tokenloom.operators import tokens as tok
from tokenloom.sources import readers, writers

K = ["dataset", "uid"]
KIND = "dataset string, uid string, text string"


def test_highlighted_text_is_recovered(spark):
    texts = {"a": 'x = "<b>" & y\n\tif a < b:\n', "b": "", "c": None, "d": "  é\t\t'q' "}
    docs = spark.createDataFrame([("d", u, t) for u, t in texts.items()], KIND)
    tokens = tok.tokenize(docs, K).withColumn("metric_entropy", F.when(F.col("tok") == "x", 2.0).when(F.col("tok") == " y", float("nan")).otherwise(1.0))
    got = {r["uid"]: r for r in markup.highlighted(docs, tokens, K, 0.9).collect()}
    for u, t in texts.items():
        assert html.unescape(re.sub(r"</?span[^>]*>", "", got[u]["html"])) == (t or "")
        assert got[u]["html"].count("<span") == got[u]["html"].count("</span>") == sum(bool(m.strip()) for m in tok._placed(t or "")[1])
    assert got["a"]["n_hot"] == 1 and '<span class="hot" title="2.000">x</span>' in got["a"]["html"] and got["b"]["n_hot"] == got["c"]["n_hot"] == 0


@pytest.fixture(scope="module")
def pair(spark):
    source = "def f(x):\n    if x > 0:\n        return '<&|`'\n    else:\n        return 2\n"
    swap = code.first_swap(source)
    pairs = spark.createDataFrame([("d", "u", source, swap["text"], json.dumps(swap["line_map"]))], "dataset string, uid string, before string, after string, line_map string")
    b, a = (tok.tokenize(pairs.select(*K, F.col(c).alias("text")), K).withColumns({"metric_entropy": F.when(F.col("tok") == " 2", 2.0).otherwise(0.1), "metric_surprisal": F.lit(1.0)}) for c in ("before", "after"))
    return syntax.line_maps(pairs, K), b, a


def test_reports(spark, pair, tmp_path):
    lines, b, a = pair
    parts = syntax.compare_pair(b, a, lines, K, {"p67": 0.7})
    page = markup.reports(lines, b, a, parts["summary"], K, 0.7).first()["report"]
    rows = re.findall(r"<tr class=.*?</tr>", page)
    assert len(rows) == 6 and page.count("<span") == page.count("</span>") == b.count() + a.count()  # the last line is empty
    seen = [html.unescape(re.sub(r"<[^>]*>", "", re.findall(r'<td class="code">(.*?)</td>', r)[0])) for r in rows]
    assert seen[2] == "        return '<&|`'↵" and 'title="pos=' in rows[0]
    assert [r.count('<td class="b">|</td>') for r in rows] == [0, 0, 0, 0, 2, 0] and rows[4].count("trig") == 2
    text = markup.reports(lines, b, a, parts["summary"], K, 0.7, "markdown").first()["report"]
    assert "`        return '<&\\|''`" in text and "| total_tokens |" in text
    with pytest.raises(ValueError):
        markup.reports(lines, b, a, parts["summary"], K, 0.7, "pdf")
    writers.write_reports(markup.reports(lines, b, a, parts["summary"], K, 0.7), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).where("value like '<!doctype%'").count() == 1


def test_token_table_has_units_of_each_threshold(pair):
    lines, b, _ = pair
    rows = compare.token_table(b, lines, K, {"a": 0.7, "z": 9.0}).orderBy("pos").collect()
    hot = next(r for r in rows if r["tok"] == " 2")
    assert hot["trigger_a"] and not hot["trigger_z"] and hot["su_a"] == 1 and hot["su_z"] == 0 and hot["region"] == "else_body" and hot["partner_line"] == 3 and hot["text"] == " 2"
    assert rows[0]["su_a"] == 0


def test_small_sinks(spark, tmp_path):
    writers.atomic_csv(str(tmp_path / "a.csv"), [{"x": 1, "y": 'q"z'}, {"x": 2, "y": None}], ["x", "y"])
    assert (tmp_path / "a.csv").read_text() == 'x,y\n1,"q""z"\n2,\n'
    with pytest.raises(ValueError):
        writers.atomic_csv(str(tmp_path / "a.csv"), [{"z": 1}], ["x", "y"])
    assert (tmp_path / "a.csv").read_text().startswith("x,y\n1")  # the old file stays whole
    t = spark.createDataFrame([("d", f"u{k}", k, "x") for k in range(6)], "dataset string, uid string, idx long, token_str string")
    writers.write_tokens(t, t.select(*K, F.lit("m").alias("meta_model_name")), str(tmp_path / "t"), buckets=3)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 6 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("bucket=")]) <= 3
    t.coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    assert readers.token_table(spark, str(tmp_path / "one.parquet")).count() == 6
    with pytest.raises(ValueError):
        readers.token_table(spark, str(tmp_path / "a.csv"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.token_table(spark, str(tmp_path / "none.parquet"))


def test_same_code_ignores_line_breaks_around_it(spark):
    cases = spark.createDataFrame([("a", "a", "\nx = 1\n\n"), ("a", "a__0", " x = 1"), ("a", "a__1", "x = 1")], "uid string, case_id string, text string")
    tasks = spark.createDataFrame([("a", "x = 1\n")], "uid string, code string")
    assert sorted(r["case_id"] for r in readers.same_code(cases, tasks).collect()) == ["a", "a__1"]


TEXTS = [
    ("d", "a", "a = '<b>'\nif x:\n    y = 1\nelse:\n    z = \"|`\"\n", '[{"orig_line": 2, "new_line": 2, "region": "if_header", "text_changed": true}, {"orig_line": 3, "new_line": 5, "region": "then_body"}, {"orig_line": null, "new_line": 4, "region": null}, {"orig_line": 1, "new_line": null}, {"orig_line": 6, "new_line": 6, "region": "after"}]'),
    ("d", "b", "", '[{"orig_line": 1, "new_line": 1, "region": "<r>"}]'), ("d", "c", "x\n\ny  z\té▁\n" * 20, "[]"), ("d", None, "x\n" * 3 + "w " * 300, '[{"orig_line": 4, "new_line": 4, "region": "after"}]'),
]


@pytest.mark.parametrize("form", ["html", "markdown"])
def test_reports_of_pairs_where_they_stand(spark, form):
    s = spark.createDataFrame([(d, u, t, t.replace("x", "not x").replace("y", "zz  z"), m) for d, u, t, m in TEXTS], "dataset string, uid string, before string, after string, line_map string").where("uid is not null")
    b, a = (tok.measure(s.select(*K, F.col(c).alias("text")), K, form="md5") for c in ("before", "after"))
    lines, thresholds = syntax.line_maps(s, K), {"p67": 2.4}
    summary = syntax.compare_pair(b, a, lines, K, thresholds)["summary"]
    whole = syntax.pair_summaries(s, K, thresholds, form="md5")
    got = markup.pair_reports(s, K, 2.4, "p67", measure="md5", form=form)
    assert sorted(map(str, whole.collect())) == sorted(map(str, summary.select(*whole.columns).collect()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, markup.reports(lines, b, a, summary, K, 2.4, form).collect()))
    for df in (whole, got):  # nothing is dealt out, sorted or joined
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Sort", "Join", "Window"))


def test_numbers_as_spark_writes_them(spark):
    values = [0.0005, 1.0005, 2.6745, -1.0005, -0.0001, 1234.5675, 0.015 / 3, 2.5, 1e-9, 12.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [tuple(r) for r in df.select(F.format_string("%.3f", "v"), F.format_string("%+.3f", "v"), F.format_string("%.2f", "v")).collect()] == [(fixed(v), fixed(v, 3, "+"), fixed(v, 2)) for v in values]
