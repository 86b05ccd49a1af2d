"""Frozen runs: one writer, bound inputs, resumption, repetitions and invalidation by content."""

import threading

import pytest
from pyspark.sql import functions as F

from tokenloom.plans.frozen import CommitLog, FrozenRun, content_key, digest, manifest


@pytest.fixture()
def place(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "code").mkdir()
    (tmp_path / "in/a.txt").write_text("a")
    (tmp_path / "in/b.txt").write_text("b")
    (tmp_path / "code/run.py").write_text("pass")
    return tmp_path


def frozen(spark, place, settings=None, **more):
    return FrozenRun(spark, str(place / "run"), settings or {"model": "none"}, [str(place / "in")], [str(place / "code")], **more)


def upper(calls):
    def step(todo):
        calls.append(sorted((r["key"], r["repetition"]) for r in todo.collect()))
        bad = F.col("code") == "bad"
        return todo.select("key", "repetition", "basis", F.when(bad, "failed").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("detail"), F.upper("code").alias("output"))

    return step


def work(spark, **code):
    return spark.createDataFrame([(k, v, "t") for k, v in code.items()], "key string, code string, tests string")


CONTENT = ["tests", "code"]


def test_one_of_many_gets_a_number(spark, tmp_path):
    log, start, won = CommitLog(spark, str(tmp_path / "log")), threading.Barrier(8), []

    def race(k):
        start.wait()
        if log.append(1, {"kind": "claim", "owner": k}):
            won.append(k)

    threads = [threading.Thread(target=race, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and [e["owner"] for e in log.entries()] == won
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["000000000001.json"]


def test_one_stage_at_a_time(spark, place):
    first, second = frozen(spark, place), frozen(spark, place)
    with first.claimed("behavior"):
        with pytest.raises(RuntimeError, match="another stage is running: behavior"), second.claimed("measure"):
            pass
    with second.claimed("measure"):
        pass
    with pytest.raises(KeyError), first.claimed("behavior"):
        raise KeyError
    with second.claimed("measure"):  # a claim ends with its block, however it ends
        pass


def test_a_dead_owner_loses_its_claim_and_can_commit_nothing(spark, place):
    dead, calls = frozen(spark, place, lease=-1), []
    run = frozen(spark, place)

    def step(todo):
        run.run("behavior", work(spark, a="x"), CONTENT, upper(calls))  # meanwhile, the lease being over
        return upper(calls)(todo)

    with pytest.raises(RuntimeError, match="claim was lost"):
        dead.run("behavior", work(spark, a="x"), CONTENT, step)
    assert [r["output"] for r in run.results("behavior").collect()] == ["X"]


def test_what_is_frozen_cannot_change(spark, place):
    frozen(spark, place).bind()
    frozen(spark, place).bind()
    with pytest.raises(ValueError, match="settings changed"):
        frozen(spark, place, {"model": "other"}).bind()
    (place / "code/run.py").write_text("pass  # other")
    with pytest.raises(ValueError, match="code changed"):
        frozen(spark, place).bind()
    (place / "code/run.py").write_text("pass")
    (place / "in/b.txt").write_text("c")
    (place / "in/a.txt").unlink()
    (place / "in/d.txt").write_text("d")
    run = frozen(spark, place)
    with pytest.raises(ValueError, match="inputs changed"):
        run.run("behavior", work(spark, a="x"), CONTENT, upper([]))
    assert {(r["path"][-5:], r["state"]) for r in run.changed_inputs().collect()} == {("a.txt", "missing"), ("b.txt", "changed"), ("d.txt", "new")}


def test_looking_writes_nothing(spark, place):
    run = frozen(spark, place)
    assert {r["state"] for r in run.state("behavior", work(spark, a="x"), CONTENT).collect()} == {"not_run"}
    assert run.results("behavior").isEmpty() and not (place / "run").exists()


def test_resumes_repeats_and_retries(spark, place):
    run, calls = frozen(spark, place), []
    todo = work(spark, a="x", b="bad")
    run.run("behavior", todo, CONTENT, upper(calls), repetitions=2)
    again = run.run("behavior", todo, CONTENT, upper(calls), repetitions=2)
    assert calls == [[("a", 1), ("a", 2), ("b", 1), ("b", 2)], []] and again.count() == 4
    run.run("behavior", todo, CONTENT, upper(calls), repetitions=3)
    run.run("behavior", todo, CONTENT, upper(calls), repetitions=3, retry_failed=True)
    assert calls[2:] == [[("a", 3), ("b", 3)], [("b", 1), ("b", 2), ("b", 3)]]
    got = run.counts(("behavior", run.state("behavior", work(spark, a="x", b="bad", c="z"), CONTENT, repetitions=3)))
    assert {tuple(r) for r in got.collect()} == {("behavior", "ok", 3), ("behavior", "failed", 3), ("behavior", "not_run", 3)}


def test_what_rests_on_changed_results_is_stale(spark, place):
    run, calls = frozen(spark, place), {"behavior": [], "measure": []}

    def both(todo):
        run.run("behavior", todo, CONTENT, upper(calls["behavior"]))
        # what is measured is bound to the key and to what the behaviour gave
        return run.run("measure", todo, ["key"], upper(calls["measure"]), after=["behavior"])

    both(work(spark, a="x", b="y", c="bad"))
    assert [r["state"] for r in run.state("measure", work(spark, a="x"), ["key"], ["behavior"]).collect()] == ["ok"]
    changed = work(spark, a="x", b="z", c="bad")
    assert {(r["key"], r["state"]) for r in run.state("behavior", changed, CONTENT).collect()} == {("a", "ok"), ("b", "stale"), ("c", "failed")}
    both(changed)
    assert calls["behavior"] == [[("a", 1), ("b", 1), ("c", 1)], [("b", 1)]]
    assert calls["measure"] == [[("a", 1), ("b", 1)], [("b", 1)]]  # failed behaviour is not measured
    both(work(spark, a="X", b="z", c="bad"))  # other code, the same output
    assert calls["behavior"][-1] == [("a", 1)] and calls["measure"][-1] == []


def test_hashes(spark, place):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("", "c")], "x string, y string")
    assert rows.select(content_key("x", "y").alias("k")).distinct().count() == 4
    before = digest(manifest(spark, [str(place / "in")]))
    assert before == digest(manifest(spark, [str(place / "in")]), 4096) and len(before) == 64
    (place / "in/a.txt").write_text("changed")
    assert before != digest(manifest(spark, [str(place / "in")]))
