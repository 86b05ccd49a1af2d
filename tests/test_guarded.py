"""Damaged token files as rows, in batch and as a stream."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tokenloom.operators.metrics import file_metrics
from tokenloom.operators.units import clean
from tokenloom.sources import guarded
from tokenloom.sources.readers import token_tree

KEYS = ["dataset", "uid"]


def table(n, **more):
    columns = {"idx": list(range(n)), "token_str": [f"t{k}" for k in range(n)], "line": [1 + k // 3 for k in range(n)], "metric_surprisal": [0.1 * k for k in range(n)], "metric_entropy": [float(k % 4) for k in range(n)]}
    return pa.table(columns | more)


@pytest.fixture()
def tree(tmp_path):
    """Two good files; a cut, an empty and a scrambled one; other columns, other types, no rows."""
    root = tmp_path / "in"
    for d in ("A", "B"):
        (root / d).mkdir(parents=True)
    pq.write_table(table(40), root / "A/result_good.parquet")
    pq.write_table(table(25_000, extra=["x"] * 25_000), root / "B/result_long.parquet")
    whole = (root / "A/result_good.parquet").read_bytes()
    (root / "A/result_cut.parquet").write_bytes(whole[: len(whole) // 2])
    (root / "A/result_empty.parquet").write_bytes(b"")
    (root / "A/result_scrambled.parquet").write_bytes(whole[:4] + bytes(255 - b for b in whole[4:300]) + whole[300:])
    pq.write_table(pa.table({"a": [1]}), root / "B/result_other.parquet")
    pq.write_table(table(3).set_column(4, "metric_entropy", pa.array(["no", "number", "here"])), root / "B/result_types.parquet")
    pq.write_table(table(0), root / "B/result_none.parquet")
    (root / "B/readme.txt").write_text("not a token file")
    return root


BAD = {("A", "cut"), ("A", "empty"), ("A", "scrambled"), ("B", "other"), ("B", "types"), ("B", "none")}


def test_bad_files_are_rows(spark, tree):
    found = guarded.guarded_tree(spark, str(tree))
    errors = found.where("error is not null").collect()
    assert {(r["dataset"], r["uid"]) for r in errors} == BAD and len(errors) == len(BAD)
    reasons = {r["uid"]: r["error"] for r in errors}
    assert reasons["empty"] == "empty file" and "no column token_str" in reasons["other"] and "no tokens" in reasons["none"]
    assert found.where("error is null").groupBy(*KEYS).count().collect().__len__() == 2
    for name in BAD:  # what is left is what the plain reader gives
        (tree / name[0] / f"result_{name[1]}.parquet").unlink()
    plain = token_tree(spark, str(tree))
    again = guarded.guarded_tree(spark, str(tree)).select(*plain.columns)
    assert again.exceptAll(plain).isEmpty() and plain.exceptAll(again).isEmpty() and again.count() == 25_040


def test_summaries(spark, tree):
    got = {(r["dataset"], r["uid"]): r for r in guarded.summaries(guarded.guarded_tree(spark, str(tree)), {"p": 2.0}).collect()}
    assert {k for k, r in got.items() if r["status"] == "error"} == BAD and all(got[k]["ppl"] is None and got[k]["error"] for k in BAD)
    good = got["A", "good"]
    want = file_metrics(clean(token_tree(spark, str(tree / "A/result_good.parquet")).drop("dataset").selectExpr("*", "'A' as dataset"), KEYS), KEYS, {"p": 2.0}).first()
    assert good["status"] == "ok" and good["ppl"] == pytest.approx(want["ppl"]) and good["num_semantic_units_p"] == want["num_semantic_units_p"]
    counts = {tuple(r) for r in guarded.tally(guarded.summaries(guarded.guarded_tree(spark, str(tree)), {"p": 2.0})).collect()}
    assert counts == {("A", "ok", 1), ("A", "error", 3), ("B", "ok", 1), ("B", "error", 3)}


def test_too_large_a_file_is_not_read(spark, tree):
    got = guarded.guarded_tree(spark, str(tree), most_bytes=50_000)
    assert [r["uid"] for r in got.where("error like 'larger%'").collect()] == ["long"]


def test_stream(spark, tree, tmp_path):
    """Good and damaged files in several batches, then one file more."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        query = guarded.summarise(guarded.guarded_stream(spark, str(tree), files=3), str(tree), out, checkpoint, {"p": 2.0})
        query.awaitTermination(120)
        return {(r["dataset"], r["uid"]): r["status"] for r in spark.read.parquet(out).collect()}

    first = run()
    assert {k for k, s in first.items() if s == "error"} == BAD and len(first) == 8
    pq.write_table(table(7), tree / "B/result_later.parquet")
    assert run() == first | {("B", "later"): "ok"}
