"""Frozen runs: stages bound to their inputs, settings and code, one at a time, whose results are reused by content.

A run is a folder with an append-only log of numbered entries. The entry that first takes a number has it, which no second
writer can; claims, bindings and results all become true by one such entry. Rows lie in tables beside the log and count
only once an entry names them, so a run that dies leaves nothing half done.

A result holds for its basis: a hash of what its key was computed from (tests, entry point, code, ...) and of the outputs
of the stages before it. Where the basis has changed the result is stale and is computed again; where an earlier stage
ran again and gave the same output, what follows stays.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.plans.experiment import condition_key

#: Seconds after which another may take a claim whose owner no longer answers.
LEASE = 6 * 3600
RESULT = "key string, repetition int, basis string, status string, detail string, output string"


class CommitLog:
    """Entries 1, 2, ... as JSON files in a folder. There is one for each claim, release and finished stage: few, read by the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def entries(self) -> list[dict]:
        fs, folder = self._fs()
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        if not any(name.endswith(".json") for name in names):
            return []
        rows = self.spark.read.text(f"{self.root}/*.json", wholetext=True).select("value").collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda e: e["n"])

    def append(self, n: int, entry: dict) -> bool:
        """Whether this entry got number n. A whole file is moved to a name that must be free.

        On a local disk by a hard link, elsewhere by a rename that does not overwrite: atomic on HDFS. A store without
        such a rename needs a file system layer that has one.
        """
        fs, folder = self._fs()
        fs.mkdirs(folder)
        name, text = f"{n:012d}.json", json.dumps({**entry, "n": n}, sort_keys=True)
        if fs.getUri().getScheme() == "file":
            home = Path(folder.toUri().getPath())
            new = home / f".{uuid.uuid4().hex}"
            with new.open("w", encoding="utf-8") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            try:
                os.link(new, home / name)
            except FileExistsError:
                return False
            finally:
                new.unlink()
            return True
        jvm = self.spark._jvm
        new, final = (jvm.org.apache.hadoop.fs.Path(folder, x) for x in (f".{uuid.uuid4().hex}", name))
        out = fs.create(new, False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(new, final, self.spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as error:
            fs.delete(new, False)
            if fs.exists(final):
                return False
            raise error
        return True


def manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, bytes, sha256) of all files under paths, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def digest(found: DataFrame, buckets: int = 4096) -> str:
    """One hash of a manifest: of the sorted hashes of its buckets, each a hash of its sorted lines."""
    line = F.concat_ws(" ", "path", "bytes", "sha256")
    parts = found.groupBy(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h")).first()["h"]


def content_key(*columns: Column | str) -> Column:
    """SHA-256 of columns; lengths stand before values, so that no two rows run together, and null is no text."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)), 256)


class FrozenRun:
    """Stages over keyed work at root. inputs, code: folders or files whose contents the run is bound to."""

    def __init__(self, spark: SparkSession, root: str, settings, inputs: Sequence[str], code: Sequence[str] = (), lease: float = LEASE, owner: str | None = None):
        self.spark, self.root, self.lease = spark, root.rstrip("/"), lease
        self.owner, self.log = owner or uuid.uuid4().hex, CommitLog(spark, f"{root.rstrip('/')}/log")
        self.settings, self.inputs, self.code = settings, list(inputs), list(code)

    # -- binding --------------------------------------------------------------------------------------------------

    def binding(self) -> dict[str, str]:
        hashed = {name: digest(manifest(self.spark, paths)) if paths else "" for name, paths in (("inputs", self.inputs), ("code", self.code))}
        return {"settings": condition_key(self.settings)} | hashed

    def bind(self) -> None:
        """Bind the folder at first use; later, refuse other settings, inputs or code."""
        now = self.binding()
        while True:
            log = self.log.entries()
            bound = next((e for e in log if e["kind"] == "bind"), None)
            if bound is not None:
                changed = [k for k, v in now.items() if bound[k] != v]
                if changed:
                    raise ValueError(f"{', '.join(changed)} changed since the run began; use a new folder")
                return
            at = f"{self.root}/manifest/{uuid.uuid4().hex}"
            manifest(self.spark, self.inputs).write.parquet(at)
            if self.log.append(len(log) + 1, {"kind": "bind", "manifest": at, **now}):
                return

    def changed_inputs(self) -> DataFrame:
        """(path, state): files that are changed, missing or new since the run was bound."""
        bound = next(e for e in self.log.entries() if e["kind"] == "bind")
        was, now = self.spark.read.parquet(bound["manifest"]), manifest(self.spark, self.inputs)
        both = was.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("now")), "path", "full")
        state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed")
        return both.select("path", state.alias("state")).where("state is not null")

    # -- claims ---------------------------------------------------------------------------------------------------

    @staticmethod
    def _open(log: list[dict], now: float) -> dict | None:
        """The claim in force: the last one, unless its owner has let it go or its lease is over."""
        claim = next((e for e in reversed(log) if e["kind"] == "claim"), None)
        if claim is None or claim["until"] <= now or any(e["kind"] == "release" and e["owner"] == claim["owner"] and e["n"] > claim["n"] for e in log):
            return None
        return claim

    @contextmanager
    def claimed(self, stage: str) -> Iterator[None]:
        """The run is this owner's until the block ends. Of those that ask at once one gets it."""
        self.bind()
        while True:
            log, now = self.log.entries(), time.time()
            held = self._open(log, now)
            if held is not None:
                raise RuntimeError(f"another stage is running: {held['stage']} of {held['owner']}")
            if self.log.append(len(log) + 1, {"kind": "claim", "stage": stage, "owner": self.owner, "until": now + self.lease}):
                break
        try:
            yield
        finally:
            self._commit({"kind": "release", "owner": self.owner}, held=False)

    def _commit(self, entry: dict, held: bool = True) -> int:
        while True:
            log = self.log.entries()
            last = next((e for e in reversed(log) if e["kind"] == "claim"), None)
            if held and (last is None or last["owner"] != self.owner):
                raise RuntimeError("the claim was lost to another owner; nothing was committed")
            if self.log.append(len(log) + 1, entry):
                return len(log) + 1

    # -- results --------------------------------------------------------------------------------------------------

    def results(self, stage: str) -> DataFrame:
        """The latest committed row of each key and repetition."""
        tables = {e["data"]: e["n"] for e in self.log.entries() if e["kind"] == "rows" and e["stage"] == stage}
        if not tables:
            return self.spark.createDataFrame([], RESULT)
        rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.root}/rows/{t}" for t in tables))
        order = F.create_map(*(F.lit(x) for pair in tables.items() for x in pair))[F.regexp_extract(F.col("_metadata.file_path"), "/rows/([0-9a-f]+)/", 1)]
        rest = [c for c in rows.columns if c not in ("key", "repetition")]
        latest = rows.groupBy("key", "repetition").agg(F.max_by(F.struct(*rest), order).alias("r"))
        return latest.select("key", "repetition", "r.*")

    def based(self, work: DataFrame, content: Sequence[str], after: Sequence[str] = (), repetitions: int = 1) -> DataFrame:
        """work (by key) with its repetitions from 1 and the basis of each: its content and the outputs it rests on."""
        parts: list[Column] = [content_key(*content)]
        for k, stage in enumerate(after):
            found = self.results(stage).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("repetition", "status", "output"))).alias("o"))  # a few repetitions
            work = work.join(found.select("key", F.sha2(F.to_json("o"), 256).alias(f"__after_{k}")), "key", "left")
            parts.append(F.col(f"__after_{k}"))
        work = work.withColumn("basis", content_key(*parts) if after else parts[0]).drop(*(f"__after_{k}" for k in range(len(after))))
        return work.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))

    def state(self, stage: str, work: DataFrame, content: Sequence[str], after: Sequence[str] = (), repetitions: int = 1) -> DataFrame:
        """(key, repetition, basis, state): not_run, stale, or the status of the result. Writes nothing."""
        known = self.results(stage).select("key", "repetition", F.col("basis").alias("was"), "status")
        joined = self.based(work, content, after, repetitions).join(known, ["key", "repetition"], "left")
        state = F.when(F.col("status").isNull(), "not_run").when(F.col("was") != F.col("basis"), "stale").otherwise(F.col("status"))
        return joined.select("key", "repetition", "basis", state.alias("state"))

    def run(
        self, stage: str, work: DataFrame, content: Sequence[str], step: Callable[[DataFrame], DataFrame], after: Sequence[str] = (), repetitions: int = 1,
        retry_failed: bool = False, need: Sequence[str] = ("ok",),
    ) -> DataFrame:
        """Compute what has no valid result, commit it, and give the stage's results.

        step: from rows of work with repetition and basis to rows with key, repetition, status, detail, output and more;
        a bad item is a row with another status than ok. Work without all its earlier stages in a status of `need` waits.
        """
        with self.claimed(stage):
            todo = self.based(work, content, after, repetitions)
            for earlier in after:
                bad = self.results(earlier).where(~F.col("status").isin(*need)).select("key")
                todo = todo.join(self.results(earlier).select("key").distinct(), "key", "left_semi").join(bad, "key", "left_anti")
            valid = self.results(stage)
            if retry_failed:
                valid = valid.where("status = 'ok'")
            todo = todo.join(valid.select("key", "repetition", "basis"), ["key", "repetition", "basis"], "left_anti")
            made = step(todo)
            if "basis" not in made.columns:
                made = made.join(todo.select("key", "repetition", "basis"), ["key", "repetition"])
            lacking = [c for c in ("key", "repetition", "basis", "status", "detail", "output") if c not in made.columns]
            if lacking:
                raise ValueError(f"the step gives no {', '.join(lacking)}")
            name = uuid.uuid4().hex
            made.write.parquet(f"{self.root}/rows/{name}")
            if not self.spark.read.parquet(f"{self.root}/rows/{name}").isEmpty():
                self._commit({"kind": "rows", "stage": stage, "data": name})
        return self.results(stage)

    def counts(self, *states: tuple[str, DataFrame]) -> DataFrame:
        """(stage, state, n) of several stages' state()."""
        each = [found.groupBy("state").agg(F.count("*").cast("long").alias("n")).select(F.lit(stage).alias("stage"), "state", "n") for stage, found in states]
        return reduce(DataFrame.unionByName, each)
