"""Token production without a language model: regex tokens, positions, and deterministic metrics in their place."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tokenloom.functions.text import NEWLINE_TOKEN, SPACE_MARK

#: The pattern of the model-free tokenizer (white space and digits by Unicode), and the first token id.
PATTERN = r"\n| *[A-Za-z_][A-Za-z0-9_]*| *\d+| +|[^\sA-Za-z0-9_]"
FIRST_ID = 3

#: The plain implementation, without what a call to a provider costs, where Python has it.
try:
    from _md5 import md5 as _MD5
except ImportError:
    from hashlib import md5 as _MD5

#: Tokens that go into one Arrow batch.
BATCH = 1 << 16

#: Tokenizers by name: functions from (docs, key columns, text column) to token rows; register() adds to them.
TOKENIZERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        TOKENIZERS[name] = f
        return f

    return add


#: Columns of a token as it is made, and those that measure() adds.
_PLACED = "pos long, tok string, token_str string, token_id long, char_start long, line long, column long"
_MEASURED = (
    "metric_entropy double, metric_surprisal double, seg long, function_id string, is_function_start boolean, is_statement_start boolean, "
    "nesting_depth long, metric_isolated_surprisal double"
)


def _values(contexts: list[bytes], form: str) -> np.ndarray:
    """A number in [0, 3) for each context."""
    if form == "crc32":
        numbers = np.fromiter(map(zlib.crc32, contexts), np.int64, len(contexts))
    else:
        digests = b"".join([h.digest() for h in map(_MD5, contexts)])
        numbers = np.frombuffer(digests, ">u4")[::4].astype(np.int64)
    return numbers % 3000 / 1000.0


def _contexts(ids: list[int], form: str) -> np.ndarray:
    """A number in [0, 3) for each token, from its id and the two before it in the list."""
    s = [*map(str, ids)]
    texts = [*s[:1], *map(",".join, zip(s[:1], s[1:2], strict=False)), *map(",".join, zip(s, s[1:], s[2:], strict=False))]
    return _values("\n".join(texts).encode().split(b"\n") if texts else [], form)


_EVERY = re.compile(PATTERN + r"|\s")


def _placed(text: str) -> list[list]:
    """The columns of _PLACED for a whole text."""
    tok = _EVERY.findall(text)  # white space that is no token is found too, so that lengths give places
    size = np.fromiter(map(len, tok), np.int64, len(tok))
    start = np.cumsum(size) - size
    shown: dict[str, str | None] = {}
    for t in dict.fromkeys(tok):
        shown[t] = NEWLINE_TOKEN if t == "\n" else t.replace(" ", SPACE_MARK) if t[-1] == " " or not t.isspace() else None
    if None in shown.values():
        kept = np.fromiter((shown[t] is not None for t in tok), bool, len(tok))
        start, tok = start[kept], [t for t in tok if shown[t] is not None]
    marks = [*map(shown.__getitem__, tok)]
    ids = {t: k + FIRST_ID for k, t in enumerate(dict.fromkeys(marks))}
    newline = np.fromiter((t == "\n" for t in tok), bool, len(tok))
    before = np.cumsum(newline) - newline
    begins = np.concatenate([[0], start[newline] + 1])
    return [np.arange(len(tok)), tok, marks, [*map(ids.__getitem__, marks)], start, before + 1, start - begins[before]]


def _measured(columns: list[list], form: str, lines: int, wanted: set[str]) -> dict[str, list]:
    """Those of the columns of _MEASURED that are wanted: metrics, and syntax attributes of running text as
    paragraph_attributes() gives them."""
    _, tok, _, ids, _, line, _ = columns
    n, block, out = len(tok), (line - 1) // lines, {"seg": line - 1, "nesting_depth": (line - 1) % lines}
    alone = "metric_isolated_surprisal" in wanted
    if alone or wanted & {"metric_entropy", "metric_surprisal"}:
        entropy = _contexts(ids, form)
        out |= {"metric_entropy": entropy, "metric_surprisal": entropy * 1.5}
    for name, by in (("is_function_start", block), ("is_statement_start", line)):
        if name in wanted:
            at = np.flatnonzero(np.fromiter((t != "\n" for t in tok), bool, n))
            out[name] = np.zeros(n, bool)
            out[name][at[np.unique(by[at], return_index=True)[1]]] = True
    if alone or "function_id" in wanted:
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), n] if n else [0]
        out["function_id"] = [f for a, b in zip(cuts[:-1], cuts[1:], strict=True) for f in [f"b{block[a]}"] * (b - a)]
    if alone:  # from the third token of a block on, the context within it is the whole one
        first = [k for a, b in zip(cuts[:-1], cuts[1:], strict=True) for k in range(a, min(a + 2, b))]
        begin = dict.fromkeys(cuts)
        own = [(str(ids[k]) if k in begin else f"{ids[k - 1]},{ids[k]}").encode() for k in first]
        value = entropy.copy()
        value[first] = _values(own, form)
        out["metric_isolated_surprisal"] = value * 1.5
    return out


def _rows(docs: DataFrame, keys: list[str], text: str, schema: str, make: Callable[[str], list[list]]) -> DataFrame:
    """A row for each token of each text, made text by text: a document's rows stand together in order, without a shuffle."""
    source = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    added = StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(added)
        for batch in batches:
            row, held, n = [], [], 0

            def part() -> pa.RecordBatch:
                at = pa.array(np.concatenate(row))
                columns = [batch.column(k).take(at) for k in range(len(keys))]  # noqa: B023
                for k, f in enumerate(fields):
                    columns.append(pa.concat_arrays([pa.array(c[k], type=f.type) for c in held]))
                row.clear()
                held.clear()
                return pa.RecordBatch.from_arrays(columns, names=[*keys, *fields.names])

            for k, t in enumerate(batch.column(len(keys))):
                columns = make(t.as_py() or "")
                for s in range(0, len(columns[0]), BATCH):
                    held.append([c[s : s + BATCH] for c in columns])
                    row.append(np.full(len(held[-1][0]), k))
                    n += len(row[-1])
                    if n >= BATCH:
                        yield part()
                        n = 0
            if held:
                yield part()

    return source.mapInArrow(run, f"{kept}, {schema}")


@register("regex")
def tokenize(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per token: keys, pos, tok (as it stands), token_str, token_id, char_start, line, column.

    token_str has marks for spaces and newlines. Ids count strings in order of first appearance in the file, from 3.
    Lines count from 1, columns from 0. White space other than spaces and newlines gives no token. A null text has none.
    """
    return _rows(docs, keys, text, _PLACED, _placed)


def _measuring(columns: Iterable[str], form: str, lines: int) -> tuple[list[tuple[str, str]], Callable[[str], list[list]]]:
    """Names and types of the columns of measure() that are asked for, and what makes them of a text."""
    every = [c.split() for c in f"{_PLACED}, {_MEASURED}".split(", ")]
    if unknown := set(columns) - {name for name, _ in every}:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    made = [(name, kind) for name, kind in every if not columns or name in columns]
    wanted = {name for name, _ in made}
    placed = [c.split()[0] for c in _PLACED.split(", ")]

    def make(t: str) -> list[list]:
        first = _placed(t)
        found = dict(zip(placed, first, strict=True)) | _measured(first, form, lines, wanted)
        return [found[name] for name, _ in made]

    return made, make


def measure(docs: DataFrame, keys: list[str], text: str = "text", form: str = "crc32", lines: int = 4, columns: Iterable[str] = ()) -> DataFrame:
    """tokenize() with what dummy_metrics(), segments() and paragraph_attributes() add, and the metric within each
    function alone, in one pass over each text and without windows over token rows.

    columns: the ones to make; without any, all. What isn't made costs nothing, neither here nor on the way to Spark.
    """
    made, make = _measuring([*columns], form, lines)
    return _rows(docs, keys, text, ", ".join(map(" ".join, made)), make)


def by_file(docs: DataFrame, keys: list[str], text: str = "text", form: str = "crc32", lines: int = 4, columns: Iterable[str] = ()) -> DataFrame:
    """measure() with a row for each text that has tokens: keys, and each column as an array over its tokens in order.

    For tables that are joined by file: a token costs its values alone, keys and places are not written for each, and
    nothing is sorted by place.
    """
    made, make = _measuring([*columns], form, lines)
    source = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    added = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in made))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(added)
        for batch in batches:
            row, held, n = [], [], 0

            def part() -> pa.RecordBatch:
                columns = [batch.column(k).take(pa.array(row)) for k in range(len(keys))]  # noqa: B023
                ends = pa.array(np.cumsum([0, *(len(c[0]) for c in held)]), pa.int32())
                for k, f in enumerate(fields):
                    columns.append(pa.ListArray.from_arrays(ends, pa.concat_arrays([pa.array(c[k], type=f.type) for c in held])))
                row.clear()
                held.clear()
                return pa.RecordBatch.from_arrays(columns, names=[*keys, *fields.names])

            for k, t in enumerate(batch.column(len(keys))):
                columns = make(t.as_py() or "")
                if len(columns[0]):
                    row.append(k)
                    held.append(columns)
                    n += len(columns[0])
                if n >= BATCH:
                    yield part()
                    n = 0
            if held:
                yield part()

    return source.mapInArrow(run, f"{kept}, " + ", ".join(f"{name} array<{kind}>" for name, kind in made))


def hash_value(text: Column, form: str = "crc32") -> Column:
    """A number in [0, 3) from a text's hash: crc32, or md5 where another engine must give the same."""
    n = F.crc32(text.cast("binary")) if form == "crc32" else F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return (n % 3000) / F.lit(1000.0)


def dummy_metrics(tokens: DataFrame, keys: list[str], form: str = "crc32", window: list[str] | None = None, isolated: bool = False) -> DataFrame:
    """metric_entropy and metric_surprisal (1.5 times as much) from the ids of each token and the two before it.

    window: columns that restart the context, as isolated inference of a function does; isolated: the result is
    metric_isolated_surprisal alone.
    """
    order = Window.partitionBy(*keys, *(window or [])).orderBy("pos")
    context = F.concat_ws(",", F.lag("token_id", 2).over(order).cast("string"), F.lag("token_id", 1).over(order).cast("string"), F.col("token_id").cast("string"))
    value = hash_value(context, form)
    if isolated:
        return tokens.withColumn("metric_isolated_surprisal", value * 1.5)
    return tokens.withColumn("metric_entropy", value).withColumn("metric_surprisal", F.col("metric_entropy") * 1.5)


def paragraph_attributes(tokens: DataFrame, keys: list[str], lines: int = 4) -> DataFrame:
    """Syntax attributes for running text: blocks of lines stand for functions, lines for statements.

    function_id, is_function_start (a block's first token that is no newline), is_statement_start (a line's), and
    nesting_depth (the line's place in its block).
    """
    word = F.col("tok") != "\n"
    block = F.floor((F.col("line") - 1) / lines)
    tokens = tokens.withColumn("function_id", F.concat(F.lit("b"), block.cast("string")))
    first = lambda by: F.min(F.when(word, F.col("pos"))).over(Window.partitionBy(*keys, by))
    return tokens.withColumns({
        "is_function_start": F.coalesce(first("function_id") == F.col("pos"), F.lit(False)),
        "is_statement_start": F.coalesce(first("line") == F.col("pos"), F.lit(False)),
        "nesting_depth": ((F.col("line") - 1) % lines).cast("long"),
    })


def isolated_windows(tokens: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with the value of the last window (by ord) that has one at their char_start; null outside windows.

    windows: keys, ord, char_start, metric_isolated_surprisal. Both may be rows of tokens, or files of by_file(), whose
    tokens get their values where they stand, without a join by place.
    """
    if not isinstance(windows.schema["char_start"].dataType, ArrayType):
        best = windows.groupBy(*keys, "char_start").agg(F.max_by("metric_isolated_surprisal", "ord").alias("metric_isolated_surprisal"))
        return tokens.join(best, [*keys, "char_start"], "left")

    named = windows.select(*keys, F.col("char_start").alias("__at"), F.col("ord").alias("__ord"), F.col("metric_isolated_surprisal").alias("__value"))
    return tokens.join(named, keys, "left").withColumn("metric_isolated_surprisal", values_at("char_start", "__at", "__ord", "__value")).drop("__at", "__ord", "__value")


def values_at(place: Column | str, at: Column | str, order: Column | str, value: Column | str) -> Column:
    """isolated_windows() of a file whose windows stand in its own row: for each place the value there that is last in order; all arrays."""

    @F.pandas_udf("array<double>")
    def found(place: pd.Series, at: pd.Series, order: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([_looked_up(*x) for x in zip(place, at, order, value, strict=True)])

    return found(place, at, order, value)


def _looked_up(places: np.ndarray, at: np.ndarray | None, order: np.ndarray | None, values: np.ndarray | None) -> list[float | None]:
    """For each place the value that stands there last in order, or none."""
    if at is None or not len(at):
        return [None] * len(places)
    by = np.lexsort((order, at))
    last = by[np.append(at[by][1:] != at[by][:-1], True)]
    k = np.minimum(np.searchsorted(at[last], places), len(last) - 1)
    return [v if hit else None for v, hit in zip(values[last][k].tolist(), (at[last][k] == places).tolist(), strict=True)]


def covering(tokens: DataFrame, spans: DataFrame, keys: list[str], at: str = "char_start", width: int = 256) -> DataFrame:
    """Tokens with each span [span_start, span_end) over their place, one row for each."""
    pieces = spans.select(*keys, "span_ord", "span_id", "span_start", "span_end").where("span_end > span_start")
    pieces = pieces.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("span_start") / width), F.floor((F.col("span_end") - 1) / width))))
    met = tokens.withColumn("__bucket", F.floor(F.col(at) / width)).join(pieces, [*keys, "__bucket"]).drop("__bucket")
    return met.where((F.col("span_start") <= F.col(at)) & (F.col(at) < F.col("span_end")))


def innermost(tokens: DataFrame, spans: DataFrame, keys: list[str], at: str = "char_start", name: str = "owner", width: int = 256) -> DataFrame:
    """Tokens with the innermost span [span_start, span_end) over their place; of equal starts the later (span_ord).

    A range join by buckets of `width` places: a span goes to each bucket that it meets, a token to one, so that the
    join is on equality of keys and bucket. A bucket's spans come as one array (there are few over any place), and a
    token takes its own where it stands: one join, no second copy of the tokens. Tokens may be files of by_file() too:
    these meet all spans of their file, and owners and depths are arrays.
    """
    if isinstance(tokens.schema[at].dataType, ArrayType):
        @F.pandas_udf(f"struct<owner: array<{spans.schema['span_id'].dataType.simpleString()}>, depth: array<bigint>>")
        def owned(place: pd.Series, order: pd.Series, start: pd.Series, end: pd.Series, ids: pd.Series) -> pd.DataFrame:
            found = [_owned(*x) for x in zip(place, order, start, end, ids, strict=True)]
            return pd.DataFrame({"owner": [f[0] for f in found], "depth": [f[1] for f in found]})

        each = F.array_sort(F.collect_list(F.struct("span_start", "span_ord", "span_end", "span_id")))
        given = spans.where("span_end > span_start").groupBy(*keys).agg(each.alias("__s"))
        met = tokens.join(given, keys, "left").withColumn("__o", owned(at, *(F.col(f"__s.{c}") for c in ("span_ord", "span_start", "span_end", "span_id"))))
        return met.withColumns({name: F.col("__o.owner"), f"{name}_depth": F.col("__o.depth")}).drop("__o", "__s")
    pieces = spans.select(*keys, "span_ord", "span_id", "span_start", "span_end").where("span_end > span_start")
    pieces = pieces.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("span_start") / width), F.floor((F.col("span_end") - 1) / width))))
    cells = pieces.groupBy(*keys, "__bucket").agg(F.collect_list(F.struct("span_start", "span_ord", "span_end", "span_id")).alias("__spans"))
    over = F.filter("__spans", lambda s: (s["span_start"] <= F.col(at)) & (F.col(at) < s["span_end"]))
    met = tokens.withColumn("__bucket", F.floor(F.col(at) / width)).join(cells, [*keys, "__bucket"], "left").withColumn("__over", over)
    met = met.withColumns({name: F.array_max("__over")["span_id"], f"{name}_depth": F.nullif(F.size("__over").cast("long"), F.lit(0).cast("long"))})
    # -1 is the size of no array
    return met.withColumn(f"{name}_depth", F.when(F.col(f"{name}_depth") > 0, F.col(f"{name}_depth"))).drop("__bucket", "__spans", "__over")


def _owned(places: np.ndarray, order: np.ndarray | None, start: np.ndarray | None, end: np.ndarray | None, ids: np.ndarray | None) -> tuple[list, list]:
    """For each place the id of the span over it that starts last, and the number of spans over it; spans by start, then order."""
    if order is None:
        return [None] * len(places), [None] * len(places)
    borders = np.unique(np.concatenate([start, end]))
    owner, open_, i = [], [], 0
    for b in borders.tolist():  # a stack of the spans met: those on top that have ended are done with
        while i < len(start) and start[i] <= b:
            open_.append(i)
            i += 1
        while open_ and end[open_[-1]] <= b:
            open_.pop()
        owner.append(ids[open_[-1]] if open_ else None)
    depth = np.searchsorted(start, borders, "right") - np.searchsorted(np.sort(end), borders, "right")
    owner, depth = [*owner, None], [*(int(d) or None for d in depth), None]  # the last one is of places before all spans
    at = (np.searchsorted(borders, places, "right") - 1).tolist()
    return [owner[k] for k in at], [depth[k] for k in at]


def starts_span(tokens: DataFrame, spans: DataFrame, keys: list[str], name: str = "is_function_start", width: int = 256) -> DataFrame:
    """Whether a span starts inside the token [char_start, char_start + length).

    A span's start meets the tokens of its bucket of `width` places; a token goes to each bucket that it reaches into.
    Tokens may be files of by_file() too (char_start and tok): these meet the starts of their file, and the answers are an array.
    """
    if isinstance(tokens.schema["char_start"].dataType, ArrayType):
        @F.pandas_udf("array<boolean>")
        def starts(place: pd.Series, size: pd.Series, at: pd.Series) -> pd.Series:
            return pd.Series([np.zeros(len(p), bool) if s is None else np.searchsorted(np.sort(s), p + np.maximum(n, 1)) > np.searchsorted(np.sort(s), p) for p, n, s in zip(place, size, at, strict=True)])

        given = spans.where("span_start is not null").groupBy(*keys).agg(F.collect_set(F.col("span_start").cast("long")).alias("__at"))
        sized = tokens.withColumn("__size", F.transform("tok", lambda t: F.length(t).cast("long"))).drop("tok")
        return sized.join(given, keys, "left").withColumn(name, starts("char_start", "__size", "__at")).drop("__size", "__at")
    place = spans.select(*keys, F.col("span_start").alias("__s")).distinct().withColumn("__bucket", F.floor(F.col("__s") / width))
    t = tokens.select(*keys, "pos", "char_start", (F.col("char_start") + F.greatest(F.length("tok"), F.lit(1))).alias("__end"))
    t = t.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("char_start") / width), F.floor((F.col("__end") - 1) / width))))
    hit = t.join(place, [*keys, "__bucket"]).where((F.col("__s") >= F.col("char_start")) & (F.col("__s") < F.col("__end")))
    hit = hit.select(*keys, "pos").distinct().withColumn(name, F.lit(True))
    return tokens.join(hit, [*keys, "pos"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def anchor(char_start: Column, tok: Column) -> Column:
    """The first character of a token that is no white space; the start of a token of white space."""
    lead = F.length(tok) - F.length(F.regexp_replace(tok, r"^\s+", ""))
    return char_start + F.when(lead < F.length(tok), lead).otherwise(0)


def next_start(tokens: DataFrame, keys: list[str], length: str) -> DataFrame:
    """char_end: the next known start, else the source's length. Starts that go back are an error."""
    order = Window.partitionBy(*keys).orderBy("pos")
    last = F.max("char_start").over(order.rowsBetween(Window.unboundedPreceding, -1))
    checked = F.when(F.col("char_start") < last, F.raise_error(F.lit("token starts go back"))).otherwise(F.col("char_start"))
    # a frame up to the end of the file would be gone through anew for each row
    named = tokens.withColumn("__next", F.expr(f"lead(char_start) ignore nulls over (partition by {', '.join(f'`{k}`' for k in keys)} order by pos)"))
    end = F.coalesce("__next", F.col(length))
    return named.withColumn("char_end", F.when(F.col("char_start").isNotNull(), F.greatest(end, checked))).drop("__next")
