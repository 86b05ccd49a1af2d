"""Toxicity: noisy-channel restoration of obfuscated words, then a linear score of the restored text.

Words written with digits and signs for letters, with stretched letters, or letter by letter are decoded: a lattice
of what each character may stand for is searched by Viterbi under a character trigram model of the whole corpus. The
words as they stand and as restored give features (whole words and their beginnings); a logistic model over the
features that tell the classes apart is trained on labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import Scratch, arrow_batches, column, numbered, only_remember, per_text, place_of

#: Labelled rows that the classifier is fitted on, at most; ids in order of a hash.
SAMPLE = 12_000
#: Features of the classifier at most; documents of class 1 that a feature needs; beginnings of words as features.
FEATURES, LEAST, PREFIXES = 2000, 3, (4, 5, 6)
#: Words remembered by a worker, and the longest one that is; results do not depend on it.
REMEMBERED, LONGEST = 200_000, 64

#: What a character may stand for beside itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "#": "h", "*": "aeiou",
}
SEPARATORS = "._-*~^'`´"
#: Log costs of the channel: another character, a dropped separator, a stretched letter told as one or as two.
SUBSTITUTED, DROPPED, STRETCHED = -1.0, -0.2, -0.3

_CLASSES = 64


def _class_table() -> np.ndarray:
    """Class of each code point: 0 no letter, 1 to 26 a to z, others by remainder."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x10000):
        ch = chr(c).lower()
        if ch[:1].isalpha():
            o = ord(ch[0])
            table[c] = o - 96 if 97 <= o <= 122 else 27 + o % (_CLASSES - 27)
    table[0x10000:] = 0
    return table


_table: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _table:
        _table.append(_class_table())
    return _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter-class trigrams over all texts; the driver gets one row per trigram that occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_remember("toxicity")
        total = np.zeros(_CLASSES**3, np.int64)
        for batch in batches:
            c = classes("\n\n".join(["", *(t or "" for t in batch.column(0).to_pylist()), ""])).astype(np.int32)
            total += np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = docs.select(column(text).cast("string").alias("text")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_CLASSES**3, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) as (a, b, c), trigrams interpolated with bigrams and single classes."""
    n = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(np.float64)
    one = n.sum((0, 1)) + 1.0
    one /= one.sum()
    two = n.sum(0)
    two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    three = (n + 10 * two[None]) / (n.sum(2, keepdims=True) + 10)
    return np.log(three).astype(np.float32)


def _options(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n characters c may stand for, with the channel's log costs."""
    if c == " ":
        return [("", DROPPED), (" ", 0.0)]
    options: list[tuple[str, float]] = []
    if c.isalpha():
        options = [(c, 0.0)] if n == 1 else [(c, STRETCHED * (n > 1)), (c + c, STRETCHED * (n > 2))]
    for letter in LEET.get(c, ""):
        options += [(letter, SUBSTITUTED + STRETCHED * (n > 1))] + ([(letter * 2, SUBSTITUTED)] if n == 2 else [])
    if c in SEPARATORS:
        options.append(("", DROPPED))
    return options or [(c, 0.0)]


def restore(word: str, lm: np.ndarray) -> str:
    """The likeliest plain text behind a lower-case writing, by Viterbi search over its lattice of runs of characters.

    A state is the last two classes of what has been written; of the paths to a state the best goes on, and all states
    do. A space in the writing may go or stay: what is spelled letter by letter falls into words as the model likes it.
    Paths are chains shared from their ends; once one state is left its path is written out. Time and memory are linear
    in the number of runs.
    """
    if not _table:
        _table.append(_class_table())
    table, done = _table[0], []
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for m in re.finditer(r"(.)\1*", word, re.S):
        steps = [([int(table[ord(ch)]) for ch in letters], letters, cost) for letters, cost in _options(m.group(1), m.end() - m.start())]
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for kinds, letters, cost in steps:
                x, y, s = a, b, score + cost
                for k in kinds:
                    s += float(lm[x, y, k])
                    x, y = y, k
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (path, letters) if letters else path)
        states = new
        if len(states) == 1:
            (state, (score, path)), = states.items()
            done.append(_written(path))
            states = {state: (score, ())}
    return "".join(done) + _written(max((s + float(lm[a, b, 0]), k, path) for k, ((a, b), (s, path)) in enumerate(states.items()))[2])


def _written(path: tuple) -> str:
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(out[::-1])


_EDGE = ".,;:!?\"'()[]{}<>*&%$#@+=~^|/\\-_`´«»„“”’…"
#: What is stripped of a token before it is restored: signs that stand for letters stay, but for marks that end sentences.
_LEFT, _RIGHT = ("".join(c for c in _EDGE if c not in keep) for keep in ("$@!|+", "$@"))
_ODD = re.compile(
    r"[^\W\d_][0-9@$!|+(€£¥§#*._~^'`´-]+[^\W\d_]|[0-9@$!|+][^\W\d_]{2}|[^\W\d_]{2}[0-9@$!|+]|([^\W\d_])\1\1|[^\W\d_][@$]|[@$][^\W\d_]|\A[^\W\d_][0-9]{2,3}\Z"
)
#: Three or more single letters, or signs for them, with any white space and signs between.
_SPELLED = re.compile(r"(?<![^\s.,_*/~|(\[\"'-])(?:[^\W_]|[@$!|])(?![^\W_])(?:[\s.,_*/~-]++(?:[^\W_]|[@$!|])(?![^\W_])){2,}")
_BETWEEN = re.compile(r"[\s.,_*/~-]+")
_SIGNS = re.compile(r"[\W_]+")


class Restorer:
    """Plain words of texts: as they stand, and restored where their writing is odd."""

    def __init__(self, lm: np.ndarray):
        self.lm = lm

    def words(self, token: str) -> tuple[str, ...]:
        """Words that one token between white space gives, of any length: itself, what it stands for, and parts joined by signs."""
        token = token.lower()
        plain = token.strip(_EDGE)
        out = [plain] if plain else []
        kept = token.rstrip(_RIGHT).lstrip(_LEFT)
        if _ODD.search(kept):
            found = restore(kept, self.lm)
            out.append(found)
            if not found.isalpha():
                out += filter(None, _SIGNS.split(found))
        if not plain.isalpha():
            out += filter(None, _SIGNS.split(plain))
        return tuple(dict.fromkeys(out))

    def spelled(self, text: str) -> list[str]:
        """Words written letter by letter, three letters or more: each run of single letters joined, and as the model parts it into words."""
        out = []
        for m in _SPELLED.finditer(text):
            letters = _BETWEEN.sub("", m.group()).lower()
            joined = letters if letters.isalpha() else restore(letters, self.lm)
            out += dict.fromkeys([joined, *restore(" ".join(letters), self.lm).split()])
        return out


def features_of(word: str) -> list[str]:
    return [word] if len(word) < PREFIXES[0] else ["=" + word, *(word[:k] for k in PREFIXES if k <= len(word))]


def _remember(known: dict, token: str, found: tuple) -> None:
    if len(token) <= LONGEST:
        if len(known) >= REMEMBERED:
            known.clear()
        known[token] = found


def _document_features(text: str, restorer: Restorer, known: dict) -> set[str]:
    out: set[str] = set()
    for token in set(text.split()):
        found = known.get(token)
        if found is None:
            found = tuple(f for w in restorer.words(token) for f in features_of(w))
            _remember(known, token, found)
        out.update(found)
    for w in restorer.spelled(text):
        out.update(features_of(w))
    return out


class Model:
    """Weights of selected features and a bias."""

    def __init__(self, lm: np.ndarray, weights: dict[str, float], bias: float):
        self.restorer, self.weights, self.bias, self.known = Restorer(lm), weights, bias, {}

    def _of(self, words: Iterable[str]) -> tuple[str, ...]:
        return tuple(f for w in words for f in features_of(w) if f in self.weights)

    def score(self, text: str) -> float:
        """Probability of class 1 of a whole text."""
        known, hit = self.known, set()
        for token in set(text.split()):
            found = known.get(token)
            if found is None:
                found = self._of(self.restorer.words(token))
                _remember(known, token, found)
            if found:
                hit.update(found)
        for w in self.restorer.spelled(text):
            hit.update(self._of((w,)))
        z = self.bias + sum(self.weights[f] for f in sorted(hit))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(key):
    """Whether a row is kept from learning: crc32 of its id as text is divisible by five."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fit(rows: list[list[int]], y: np.ndarray, n: int, penalty: float = 0.02, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features by accelerated gradient descent, with an L2 penalty per row."""
    size = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    col = np.array([f for r in rows for f in r], np.int64)
    rate = 4.0 / (1 + np.bincount(col, minlength=n).astype(float))
    share = min(max(float(y.mean()), 0.5 / len(y)), 1 - 0.5 / len(y))
    w, b = np.zeros(n), math.log(share / (1 - share))
    v, c = np.zeros(n), 0.0
    per_row = np.maximum(1, size)[row]
    for _ in range(steps):
        z = b + np.bincount(row, w[col], len(rows))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        v = 0.8 * v - rate * (np.bincount(col, g[row] / per_row, n) + penalty * w)
        c = 0.8 * c - g.mean()
        w, b = w + v, b + c
    return w, b


def _sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str, key: str, label: str, most: int) -> DataFrame:
    """(y, text) of labelled rows that are not held out, `most` rows at most: ids in order of a hash, with all their rows,
    as long as these are no more than that. The driver gets `most` ids with their numbers of rows at most."""
    known = labels.where(column(label).isNotNull() & column(key).isNotNull()).groupBy(column(key).alias("key")).agg(F.max(column(label)).cast("int").alias("y"))
    rows = docs.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    ids = known.where(~held_out(F.col("key"))).withColumn("h", F.xxhash64("key")).orderBy("h", "key").limit(most)
    ids = scratch.save(rows.select("key").join(F.broadcast(ids), "key").groupBy("h", "key", "y").count(), "ids")  # `most` narrow rows
    found = sorted(((r["h"], r["key"], r["y"], r["count"]) for r in ids.collect()), key=lambda r: r[:2])
    size = np.array([min(r[3], most + 1) for r in found], np.int64)
    taken, room = [], most
    for r, n in zip(found, size.tolist(), strict=True):
        if n <= room:
            taken.append((r[1], r[2]))
            room -= n
    kind = known.schema["key"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(taken, f"key {kind}, y int")
    return scratch.save(rows.join(F.broadcast(chosen), "key").select("y", "text"), "sample")


def train(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", label: str = "toxic",
    sample: int = SAMPLE, features: int = FEATURES, least: int = LEAST,
) -> Model:
    """The character model over all texts, and a classifier fitted on labelled rows that are not held out.

    sample: labelled rows that it learns from at most; features: how many it weighs at most; least: documents of class
    1 that a feature needs. A row's label is the greatest of its id's labels; null ids and labels teach nothing.
    Without a labelled row of each class every text scores the share of class 1.
    """
    lm = language_model(trigram_counts(docs, text))
    rows = _sample(docs, labels, scratch, text, key, label, sample)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_remember("toxicity")
        restorer, seen = Restorer(lm), {}
        by = (Counter(), Counter())
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by[y > 0].update(_document_features(t, restorer, seen))
        names = list(by[1])  # features of class 0 alone are of no use
        for k in range(0, len(names), 10_000):
            part = names[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[f] for f in part], pa.int64()) for c in (by[1], by[0]))], names=["f", "pos", "neg"])

    sizes = rows.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0)).alias("pos")).first()
    n, pos = sizes["n"], sizes["pos"]
    if not 0 < pos < n:
        return Model(lm, {}, math.log((pos + 0.5) / (n - pos + 0.5)))
    counted = rows.mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = (F.col("pos") + 0.1) / (pos + 1) / ((F.col("neg") + 0.5) / (n - pos + 1))
    counted = counted.where((F.col("pos") >= least) & (odds >= 4)).withColumn("gain", F.col("pos") * F.log(odds))
    chosen = [r["f"] for r in counted.orderBy(F.desc("gain"), "f").limit(features).select("f").collect()]
    number = {f: k for k, f in enumerate(chosen)}

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_remember("toxicity")
        restorer, seen = Restorer(lm), {}
        for batch in batches:
            lists = [sorted(number[f] for f in _document_features(t, restorer, seen) if f in number) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(lists, pa.list_(pa.int32()))], names=["y", "at"])

    data = rows.mapInArrow(encode, "y int, at array<int>").toArrow()
    pairs = sorted(zip(data.column("at").to_pylist(), data.column("y").to_pylist(), strict=True))
    w, b = _fit([p[0] for p in pairs], np.array([float(p[1] > 0) for p in pairs]), len(chosen))
    return Model(lm, {f: float(w[k]) for f, k in number.items()}, b)


def _scores(docs: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    lm, weights, bias = model.restorer.lm, model.weights, model.bias
    shared = docs.sparkSession.sparkContext.broadcast((lm, weights, bias))

    def make():
        only_remember("toxicity")
        m = Model(*shared.value)
        return lambda texts: [[m.score(t) for t in texts]]

    return per_text(docs, text, keep, "__score double", make)


def score_table(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One row per row of docs: key, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Only texts are inputs of a score. Whole texts are read; a null text counts as empty and scores by the bias. Null
    keys and repeated rows pass through; an empty table gives no rows; other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    model = train(docs, labels, Scratch(docs.sparkSession, "toxicity"), text, key, label)
    found = _scores(docs, model, [key], text)
    score = F.col("__score")
    return found.select(column(key), held_out(column(key)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The rows of docs whose texts score under 0.5, with all their columns, whatever their names.

    A null or empty text scores by the bias and so stays where most labelled texts are clean; null keys and repeated
    rows stay or go by their texts; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    model = train(docs, labels, Scratch(docs.sparkSession, "toxicity"), text, key, label)
    rows, names = numbered(docs)
    return _scores(rows, model, rows.columns, place_of(names, text)).where("__score < 0.5").drop("__score").toDF(*names)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
