"""Column expressions over token strings, ids, answers and labels."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_MARK, NEWLINE_TOKEN = "▁", "<0x0A>"


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def display_text(token: Column) -> Column:
    """Newline and space for their tokens; other byte tokens stay literal."""
    return F.replace(F.replace(token, F.lit(NEWLINE_TOKEN), F.lit("\n")), F.lit(SPACE_MARK), F.lit(" "))


def normalize_token(token: Column) -> Column:
    """Spaces as their mark, null as empty: the form in which saved token lists are compared."""
    return F.coalesce(F.replace(token, F.lit(" "), F.lit(SPACE_MARK)), F.lit(""))


def has_newline(token: Column) -> Column:
    return F.contains(display_text(token), F.lit("\n"))


def _decoded(tokens) -> str | None:
    if tokens is None:
        return None
    raw = b""
    for t in tokens:
        byte = len(t) == 6 and t.startswith("<0x") and t.endswith(">")
        raw += bytes([int(t[3:5], 16)]) if byte else t.replace(SPACE_MARK, " ").encode()
    return raw.decode("utf-8", "replace")


def decode_tokens(tokens: Column) -> Column:
    """Text of an array of tokens: runs of byte tokens <0xHH> are assembled to UTF-8, space marks become spaces."""

    def decode(s: pd.Series) -> pd.Series:
        return s.map(_decoded)

    return F.pandas_udf(decode, "string")(tokens)


def base_id(uid: Column) -> Column:
    """An id without its __ suffix."""
    return F.split_part(uid, F.lit("__"), F.lit(1))


def first_number(uid: Column) -> Column:
    """The first run of digits as a number, null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(uid, "([0-9]+)", 1), F.lit("")), F.lit("9" * 20)).cast("double")


def significance(p: Column) -> Column:
    """Labels of p-values; the trailing blanks are part of the label."""
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "0.001 ").when(p < 0.01, "<0.01 ").when(p < 0.05, "<0.05 ").otherwise("n.s.")


#: The marks that an answer stands between.
START_MARK, END_MARK = "<<<Output>>>", "[END-OF-RESPONSE]"


def answer_of(response: Column, start: str = START_MARK, end: str = END_MARK) -> Column:
    """What a response has between its last start mark and the first end mark after it, as it stands."""
    tail = F.element_at(F.split(response, _quoted(start)), -1)
    return F.element_at(F.split(tail, _quoted(end)), 1)


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def plain_answer(c: Column) -> Column:
    """Answers without newlines and spaces, with single quotes, and without one quote or backtick at either end."""
    flat = F.replace(F.regexp_replace(c, "[\n ]", ""), F.lit('"'), F.lit("'"))
    return F.regexp_replace(F.regexp_replace(flat, "^['`]", ""), "['`]$", "")


def same_output(stdout: Column, expected: Column) -> Column:
    """Whether output, without white space at its ends, is the one expected; no output asks for no expected one."""
    plain = F.regexp_replace(stdout, r"(?U)^\s+|\s+$", "")
    return F.when(plain == "", F.size(expected) == 0).otherwise((F.size(expected) == 1) & (F.get(expected, F.lit(0)) == plain))


def short_hash(c: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def non_blank_lines(code: Column) -> Column:
    return F.size(F.filter(F.split(code, "\n"), lambda s: F.trim(s) != "")).cast("long")


def char_to_byte(text: Column, chars: Column) -> Column:
    """UTF-8 bytes of the first characters of a text."""
    return F.octet_length(F.substring(text, F.lit(1), chars.cast("int"))).cast("long")


def recovered_count(score: Column, n: Column) -> Column:
    """k of a score k/n, rounded half to even; an error where the score is no such fraction to 1e-10."""
    k = F.rint(score * n)
    return F.when(F.abs(score * n - k) <= 1e-10 * F.greatest(n, F.lit(1)), k.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("score is no multiple of 1/n: "), score.cast("string")))
    )


def fixed(value: float, places: int = 3, sign: str = "") -> str:
    """A number as format_string("%.3f") writes it: rounded by its shortest decimal form, halves away from zero; sign: + or nothing."""
    if not math.isfinite(value):
        return "NaN" if math.isnan(value) else f"{'-' if value < 0 else sign}Infinity"
    off = abs(value) * 10**places % 1 - 0.5
    if -1e-4 < off < 1e-4:
        return f"{Decimal(repr(value)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):{sign}f}"
    return f"{value:{sign}.{places}f}"
