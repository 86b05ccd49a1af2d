"""Personal data in whole texts: fixed patterns, and spans that a semi-Markov conditional random field adds.

The field scores whole candidate segments by features of the span: digit grouping, checksums, separators, ends, and
cue words beside it. A segment is as long as what it may be: a number ends with its digits, an address and a dotted
number with the chain of their parts. Dynamic programming over a region's tokens chooses boundaries and kinds jointly. It is trained here, by stochastic gradient on the exact log-likelihood, on generated sentences.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenloom.llm._common import arrow_batches, numbered, only_remember, per_text

KINDS = ("email", "ip", "card", "phone")

#: Digits of a number at least and at most, characters before a segment that its cues are sought in.
DIGITS, MOST_DIGITS, CONTEXT = 7, 19, 32
#: Log-odds by which the best labelling must beat the one without a span for the span to be reported.
MARGIN = 1.0

# -- fixed patterns ---------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_IP_LONG = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LONG_RUN = re.compile(r"[0-9]{400}")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d // 5 + d * 2 % 10 for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping within each kind, in linear time."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done, "email"))
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in (_IP_LONG if _LONG_RUN.search(text) else _IP).finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((*m.span(), "phone"))
    return out


# -- the semi-Markov field --------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[\n+(@]|[^A-Za-z0-9\n+(@]+")
#: A stretch of numbers: digits with any signs between two of them, and the sign that can stand before.
_STRETCH = re.compile(r"[+(]{0,2}[0-9](?:[^0-9A-Za-z@]*+[0-9]){6,}")
#: Writings of the sign for @, and of the dot: in brackets or as words, and as a sign between spaces (which can also end a sentence).
_AT_BRACKETS = re.compile(r"[\[({<][ \t]*+(?:[aA][tT]|@)[ \t]*+[\])}>]")
_DOT = r"(?:[ \t]*+[\[({<][ \t]*+(?:[dD][oO][tT]|\.)[ \t]*+[\])}>][ \t]*+|[ \t]++[dD][oO][tT][ \t]++)"
_TOD = r"(?:[ \t]*+[\])}>][ \t]*+(?:[tT][oO][dD]|\.)[ \t]*+[\[({<][ \t]*+|[ \t]++[tT][oO][dD][ \t]++)"
_LOOSE = r"[ \t]++\.[ \t]++"
_AT_WORD = re.compile(rf"(?<=[ \t])[aA][tT](?=[ \t]++[A-Za-z0-9.-]++{_DOT})")
_HAS_DOT = re.compile(r"[dD][oO][tT]|[\[({<][ \t]*+\.")
_RUN, _NAME = r"[A-Za-z0-9._%+-]++", r"[A-Za-z0-9.-]++"
#: The chain of parts before a sign for @, read backwards, and after it; each as far as sure dots go, and as loose ones go.
_BEFORE = [re.compile(rf"[ \t]*+({_RUN}(?:{dot}{_RUN})*+)") for dot in (_TOD, rf"(?:{_TOD}|{_LOOSE})")]
_AFTER = [re.compile(rf"[ \t]*+({_NAME}(?:{dot}{_NAME})*+)") for dot in (_DOT, rf"(?:{_DOT}|{_LOOSE})")]
#: A chain of numbers with dots, however these are written.
_CHAIN = re.compile(rf"[0-9]++(?:(?:{_DOT}|[ \t]*+\.[ \t]*+)[0-9]++)*+")
_CUES = {
    "email": ("email", "mail", "contact", "write"), "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax", "telephone"),
}
_PLAIN_DOT = re.compile(rf"{_DOT}|{_LOOSE}")
_PLAIN_AT = re.compile(r"[ \t]*+(?:[\[({<][ \t]*+(?:[aA][tT]|@)[ \t]*+[\])}>]|@)[ \t]*+|[ \t]++[aA][tT][ \t]++")
_ENDINGS = frozenset("com org net edu gov io de fr es it uk eu info".split())
_EMAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def shape_features(kind: str, shape: str, cue: bool) -> list[str]:
    """Features that hang on a span's shape alone: a number with every digit as 0, an address as it stands."""
    out = ["bias", f"cue={cue}"]
    if kind == "email":
        plain = _PLAIN_DOT.sub(".", _PLAIN_AT.sub("@", shape))
        spoken = "@" not in shape and not _AT_BRACKETS.search(shape)
        out.append(f"whole={bool(_EMAIL_LIKE.fullmatch(plain))}")
        out.append(f"loose={' . ' in shape}")
        out.append(f"spoken={spoken},{plain.rpartition('.')[2].lower() in _ENDINGS}")
        return out
    seps = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", shape))))
    groups = [len(g) for g in re.findall(r"[0-9]+", shape)]
    if kind == "ip":
        return [*out, f"written={'letters' if re.search('[A-Za-z]', shape) else seps}"]
    digits = f"digits={min(sum(groups), 20)}"
    grouped = f"groups={'-'.join(map(str, groups)) if len(groups) <= 6 else 'many'}"
    gaps = re.findall(r"[^0-9]+", shape[1:])
    even = f"even={len(groups) > 1 and len(set(groups[:-1])) == 1 and groups[-1] <= groups[0]}"
    return [
        *out, digits, f"seps={seps}", grouped, f"plus={shape[0] == '+'}", even, f"cue={cue},{digits}", f"cue={cue},{grouped}", f"cue={cue},n={min(len(groups), 7)}",
        f"gap={min(max(map(len, gaps), default=0), 4)}", f"gaps={min(len({g.strip(' ()') for g in gaps}), 3)}", f"lines={chr(10) in shape}", f"closed={shape.count('(') == shape.count(')')}", f"last={min(groups[-1], 8)}",
    ]


def value_features(kind: str, span: str) -> list[str]:
    """Features of a number's digits."""
    if kind == "card":
        d = _digits(span)
        good, groups = 13 <= len(d) <= 19 and luhn(d), [len(g) for g in re.findall(r"[0-9]+", span)]
        return [f"luhn={good}", f"luhn={good},{len(set(groups[:-1])) <= 1}", f"luhn={good},lines={chr(10) in span}"]
    if kind == "ip":
        return [f"parts={all(len(p) <= 3 and int(p) <= 255 for p in re.findall(r'[0-9]+', span))}"]
    if kind == "phone":
        lead = "plus" if span[0] == "+" else "open" if span[0] == "(" else "00" if span[:2] == "00" else "0" if span[0] == "0" else "other"
        return [f"lead={lead}", f"lead={lead},{min(len(re.findall('[0-9]+', span)), 5)}"]
    return []


_LEADS, _GOES_ON = re.compile(r"[0-9][ ./-]{1,3}\Z"), re.compile(r"[ ./-]{1,3}[0-9]")


def side_features(before: str, after: str) -> list[str]:
    """Features of the characters on both sides."""
    left = "edge" if not before else "word" if before[-1].isalnum() else before[-1] if before[-1] in " \n\"'(:=,." else "mark"
    right = "edge" if not after else "word" if after[0].isalnum() else "sign" if after[0] in "-+/=%" else "mark"
    return [f"left={left}", f"right={right}", f"goes on={bool(_LEADS.search(before))},{bool(_GOES_ON.match(after))}"]


_ZEROS = str.maketrans("123456789", "000000000")


def _shape(kind: str, span: str) -> str:
    return span if kind == "email" else span.translate(_ZEROS)


def has_cue(kind: str, before: str) -> bool:
    """Whether one of the last three words before a span begins as a cue word of the kind does."""
    return any(w.lower().startswith(c) for w in re.findall(r"[A-Za-z]+", before)[-3:] for c in _CUES[kind])


def span_features(kind: str, span: str, before: str, after: str) -> list[str]:
    """Names of the features of a whole candidate span with its context on both sides."""
    found = shape_features(kind, _shape(kind, span), has_cue(kind, before)) + value_features(kind, span) + side_features(before, after)
    return [f"{kind}:{f}" for f in found]


def _kinds_of(digits: int) -> list[str]:
    """Kinds that a number is tried as; its digits rule out the others."""
    return [kind for kind, fits in (("phone", DIGITS <= digits <= 15), ("card", 13 <= digits <= MOST_DIGITS)) if fits]


def chains(text: str, base: list[tuple[int, int]] = ()) -> dict[int, list[tuple[int, str]]]:
    """Candidate addresses and dotted numbers of a text by their ends: (start, kind).

    About each sign for @ outside the stretches of base, an address takes the whole chain of parts on both sides, with
    loose dots or without; a dotted number is a whole chain of four numbers, of three digits at most. Linear in the text.
    """
    out: dict[int, list[tuple[int, str]]] = {}

    def free(a: int, b: int) -> bool:
        k = bisect_right(base, a, key=lambda t: t[1])
        return k == len(base) or b <= base[k][0]

    signs = {m.span() for m in _AT_BRACKETS.finditer(text)} if "at" in text or "AT" in text or "At" in text or "@" in text else set()
    inside = {p for a, b in signs for p in range(a, b) if text[p] == "@"}
    signs |= {m.span() for m in re.finditer("@", text) if m.start() not in inside} if "@" in text else set()
    if _HAS_DOT.search(text):
        signs |= {m.span() for m in _AT_WORD.finditer(text)}
    floor = 0
    for a, b in sorted(signs):
        if free(a, b):
            floor = max(floor, text.rfind("\n", floor, a) + 1)
            back = text[floor:a][::-1]
            starts, ends = set(), set()
            for before, after in zip(_BEFORE, _AFTER, strict=True):
                left, right = before.match(back), after.match(text, b)
                if left and right:
                    low, high = a - left.end(1), right.end(1)
                    while low < a and not text[low].isalnum():
                        low += 1
                    while high > b and not text[high - 1].isalnum():
                        high -= 1
                    if low < a and high > b and text[b:high].strip(" \t.-"):
                        starts.add(low)
                        ends.add(high)
            for high in ends:
                out.setdefault(high, []).extend((low, "email") for low in sorted(starts, reverse=True))
        floor = b
    for m in _CHAIN.finditer(text) if _DIGIT.search(text) else ():
        a, b = m.span()
        if b - a >= 7 and not m.group().isdigit():
            parts = re.findall("[0-9]+", m.group())
            if len(parts) == 4 and max(map(len, parts)) <= 3 and free(a, b):
                out.setdefault(b, []).append((a, "ip"))
    return out


def segments(
    text: str, low: int, high: int, taken: list[tuple[int, int]] = (), found_chains: dict[int, list[tuple[int, str]]] | None = None,
) -> tuple[list[tuple[int, int]], Iterator[list[tuple[int, str]]]]:
    """Tokens of text[low:high], and for each token's end the segments (first token, kind) that end there, one after another.

    A segment overlaps none of the stretches taken. A number has DIGITS to MOST_DIGITS digits, any signs between them, no
    letter and no blank line, and begins with a digit or with one or two of +( before it; all else comes from `chains`.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
    whole = chains(text, taken) if found_chains is None else found_chains

    def ending() -> Iterator[list[tuple[int, str]]]:
        taken_at = 0
        for j, (last, end) in enumerate(tokens):
            found: list[tuple[int, str]] = []
            while taken_at < len(taken) and taken[taken_at][1] <= last:
                taken_at += 1
            floor = taken[taken_at - 1][1] if taken_at else 0
            inside = taken_at < len(taken) and taken[taken_at][0] < end
            if not inside and "0" <= text[last] <= "9":
                digits, lines, first = 0, 0, last
                for i in range(j, -1, -1):
                    a, b = tokens[i]
                    c = text[a]
                    if a < floor:
                        break
                    if "0" <= c <= "9":
                        digits, lines, first = digits + b - a, 0, a
                        if digits > MOST_DIGITS:
                            break
                    elif c == "\n":
                        lines += 1
                        if lines > 1:
                            break
                        continue
                    elif c == "@" or c.isascii() and c.isalpha():
                        break
                    elif c not in "+(" or b != first and (b != first - 1 or text[b] not in "+("):
                        continue
                    if digits >= DIGITS:
                        found += [(i, kind) for kind in _kinds_of(digits)]
            if not inside and end in whole:
                for a, kind in whole[end]:
                    i = bisect_left(tokens, a, key=lambda t: t[0])
                    if a >= max(floor, low) and tokens[i][0] == a:
                        found.append((i, kind))
            yield found

    return tokens, ending()


def lattice(text: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, str, list[str]]]]]:
    """Tokens of a whole text, and for each token end the segments (first token, kind, features) that end there."""
    tokens, ends = segments(text, 0, len(text))
    ending: list[list] = [[]]
    for found in ends:
        end = tokens[len(ending) - 1][1]
        ending.append([(i, kind, span_features(kind, text[(a := tokens[i][0]) : end], text[max(0, a - CONTEXT) : a], text[end : end + 4])) for i, kind in found])
    return tokens, ending


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


class Scorer:
    """Scores of segments: the sum of their features' weights. Sums are remembered by shape and sides within a bound."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.shapes, self.sides, self.cues = weights, {}, {}, {}

    def _sum(self, kind: str, names: list[str]) -> float:
        return sum(self.weights.get(f"{kind}:{f}", 0.0) for f in names)

    @staticmethod
    def _held(known: dict, key, make, most: int = 20_000):
        if len(key) == 3 and len(key[1]) > 200:
            return make()
        value = known.get(key)
        if value is None:
            if len(known) >= most:
                known.clear()
            value = known[key] = make()
        return value

    def __call__(self, kind: str, text: str, a: int, b: int) -> float:
        span, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + 4]
        cue = self._held(self.cues, (kind, before), lambda: has_cue(kind, before))
        key = (kind, _shape(kind, span), cue)
        score = self._held(self.shapes, key, lambda: self._sum(kind, shape_features(*key)))
        score += self._held(self.sides, (before[-4:].translate(_ZEROS), kind, after.translate(_ZEROS)), lambda: self._sum(kind, side_features(before, after)))
        return score + self._sum(kind, value_features(kind, span)) if kind != "email" else score


def decode(text: str, scorer: Scorer, low: int = 0, high: int | None = None, taken: list[tuple[int, int]] = (), found_chains: dict | None = None) -> list[tuple[int, int, str]]:
    """Spans of the best labelling of text[low:high]. A segment that does not beat its tokens unlabelled by MARGIN is none.

    Segments are made and scored as the search comes to their ends, and forgotten: what is held is a number and at most
    one segment for each token.
    """
    tokens, ends = segments(text, low, len(text) if high is None else high, taken, found_chains)
    best, back = [0.0], [None]
    for j, found in enumerate(ends, 1):
        top, choice = best[j - 1], None
        for i, kind in found:
            score = best[i] + scorer(kind, text, tokens[i][0], tokens[j - 1][1]) - MARGIN
            if score > top:
                top, choice = score, (i, kind)
        best.append(top)
        back.append(choice)
    out, j = [], len(tokens)
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((tokens[i][0], tokens[j - 1][1], kind))
            j = i
        else:
            j -= 1
    return out[::-1]


def _sentences(rnd: random.Random):
    """Generated training texts with their spans: personal data in several writings among numbers that are none."""
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("aeioustnrlhdc") for _ in range(rnd.randint(2, 9)))

    def card() -> str:
        n = rnd.choice((13, 14, 15, 16, 16, 16, 16, 19))
        d = num(n - 1)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        if n == 15 and rnd.random() < 0.5:
            groups = [d[:4], d[4:10], d[10:]]
        else:
            size = rnd.choice((1, 4, 4, 4, 4, 4, 4, 8))
            groups = [d[k : k + size] for k in range(0, n, size)]
        return rnd.choice(("", "", "", " ", "-", ".", "  ", " - ", " / ", "/", "_", ", ", "\n", rnd.choice(" -._") * rnd.randint(3, 8), " " + "-" * rnd.randint(1, 5) + " ")).join(groups)

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        if rnd.random() < 0.5:
            return rnd.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(1)} {a} {b} {c}", f"0{num(2)} {num(4)} {num(4)}", f"{b}-{c}", f"00{num(2)} {a} {num(6)}", f"1-{a}-{b}-{c}", f"+{num(2)}/{a}/{num(6)}"))
        lead = rnd.choice((f"+{num(2)}", f"+{num(1)}", f"+{num(2)} (0)", f"+{num(2)}(0)", f"00{num(2)}", f"(+{num(2)})", f"(0{num(2)})", f"({a})", f"0{num(2)}", f"0{num(3)}", f"(00{num(2)})"))
        sep = rnd.choice((" ", "-", ".", "/", " / ", " - ", "  ", " . ", "   ", " -- "))
        rest = rnd.choice(([num(rnd.choice((2, 3, 4))) for _ in range(rnd.choice((2, 3)))], [num(2) for _ in range(4)], [num(rnd.choice((2, 5))), num(rnd.choice((6, 7)))], [num(rnd.choice((6, 7)))]))
        return lead + rnd.choice((" ", sep)) + sep.join(rest)

    def email() -> str:
        at, dot = rnd.choice((
            (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", "."), (" @ ", "."), ("@", "[.]"), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "),
            ("{at}", "{dot}"), ("<at>", "<dot>"), ("[@]", "[.]"), (" (@) ", "."), (" @ ", " . "), (" [ at ] ", " [ dot ] "), ("   at   ", "   dot   "), (" @ ", " dot "),
        ))
        inner = rnd.choice((".", ".", dot, "_", "-", ""))
        name = inner.join([word() for _ in range(rnd.choice((1, 1, 2, 2, 3)))]) + rnd.choice(("", "", num(2)))
        host = dot.join([word() for _ in range(rnd.choice((1, 1, 1, 2)))])
        return f"{name}{at}{host}{dot}{rnd.choice(('com', 'org', 'net', 'de', 'fr', 'co.uk' if dot == '.' else 'io'))}"

    def ip(parts: int = 4, most: int = 255) -> str:
        dot = rnd.choice((".", "[.]", "[.]", " . ", " . ", "(.)", " dot ", "[dot]", " [dot] ", "(dot)", ". ", " .", "{.}", " DOT "))
        return dot.join(str(rnd.randint(0 if most < 256 else 256, most)) for _ in range(parts))

    def positive():
        kind = rnd.choice(("email", "email", "ip", "card", "card", "phone", "phone", "phone"))
        return kind, {"email": email, "card": card, "phone": phone, "ip": ip}[kind]()

    def listed() -> str:
        sep = rnd.choice((", ", ", ", " ", " ", "; ", " | ", "\n", "\n", " - ", " / ", " ..... ", "   ", ",", "\t"))
        size = rnd.choice((1, 2, 2, 3, 4, 5))
        return sep.join(num(rnd.randint(1, size)) for _ in range(rnd.randint(3, 12)))

    def negative() -> str:
        if rnd.random() < 0.3:
            return rnd.choice((listed(), listed(), listed(), ip(rnd.choice((3, 5, 6))), ip(4, 999), f"{word()} [at] {word()}", f"{word()} @ {word()}", f"{word()} ........ {num(2)}\n{word()} ........ {num(3)}"))
        return rnd.choice((
            num(rnd.randint(7, 20)), num(rnd.randint(7, 20)), f"{rnd.randint(1900, 2030)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", f"{num(2)}.{num(2)}.{rnd.randint(1900, 2030)}", f"{num(1)},{num(3)},{num(3)}.{num(2)}",
            f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(2)}.{num(5)}, {num(2)}.{num(5)}", f"{rnd.randint(1900, 2030)}/{num(2)}/{num(4)}", f"3.{num(12)}", f"{num(3)}.{num(3)}.{rnd.randint(256, 999)}.{num(3)}",
            f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(1)}.{num(2)}.{num(3)}.{num(5)}", f"{num(8)}-{num(4)}-{num(4)}-{num(12)}", f"{num(3)} {num(2)} {num(4)} {num(1)} {num(2)}", f"{num(2)}:{num(2)}:{num(2)}.{num(3)}", f"{word()} @ {num(3)}", f"@{word()}", f"{word()} at {word()} dot {word()}", f"{rnd.randint(1900, 2030)} {rnd.randint(1900, 2030)} {rnd.randint(1900, 2030)}",
        ))

    cues = {"email": "e-mail", "ip": "host", "card": "card", "phone": "phone"}
    while True:
        parts, spans, at = [], [], 0
        for _ in range(rnd.randint(1, 2)):
            lead = " ".join(word() for _ in range(rnd.randint(1, 4))) + " " if parts or rnd.random() < 0.9 else ""
            if rnd.random() < 0.5:
                kind, s = positive()
                # writings that numbers of other sorts share count as personal only beside a cue
                unclear = kind == "phone" and s[0] not in "+(" and "-" not in s
                if unclear or rnd.random() < 0.5:
                    lead += rnd.choice((cues[kind], rnd.choice(_CUES[kind]))) + rnd.choice((" ", ": ", " is "))
                spans.append((at + len(lead), at + len(lead) + len(s), kind))
            else:
                lead += rnd.choice(("", "number ", "no. ", "version ", "page ", "id "))
                s = negative()
            parts.append(lead + s + rnd.choice((" ", ". ", ", ")))
            at += len(parts[-1])
        yield "".join(parts) + word() if rnd.random() < 0.85 else "".join(parts).rstrip(" .,"), spans


@lru_cache(1)
def train(sentences: int = 2000, passes: int = 4, rate: float = 0.3, seed: int = 7) -> dict[str, float]:
    """Weights by stochastic gradient on the log-likelihood of whole segmentations; the same for the same arguments."""
    rnd = random.Random(seed)
    source = _sentences(rnd)
    data = []
    while len(data) < sentences:
        text, spans = next(source)
        tokens, ending = lattice(text)
        found = {(tokens[i][0], tokens[j - 1][1], kind) for j in range(len(ending)) for i, kind, _ in ending[j]}
        if all(s in found for s in spans):
            data.append((tokens, ending, set(spans)))
    w: dict[str, float] = {}
    for p in range(passes):
        rnd.shuffle(data)
        step = rate / (1 + p)
        for tokens, ending, gold in data:
            n = len(tokens)
            scores = [[sum(w.get(f, 0.0) for f in fs) for _, _, fs in e] for e in ending]
            alpha = [0.0] + [-math.inf] * n
            for j in range(1, n + 1):
                alpha[j] = alpha[j - 1]
                for (i, _, _), s in zip(ending[j], scores[j], strict=True):
                    alpha[j] = _add(alpha[j], alpha[i] + s)
            beta = [-math.inf] * n + [0.0]
            for j in range(n, 0, -1):
                beta[j - 1] = _add(beta[j - 1], beta[j])
                for (i, _, _), s in zip(ending[j], scores[j], strict=True):
                    beta[i] = _add(beta[i], beta[j] + s)
            for j in range(1, n + 1):
                for (i, kind, fs), s in zip(ending[j], scores[j], strict=True):
                    p_segment = math.exp(min(0.0, alpha[i] + s + beta[j] - alpha[n]))
                    g = ((tokens[i][0], tokens[j - 1][1], kind) in gold) - p_segment
                    if abs(g) > 1e-4:
                        for f in fs:
                            w[f] = w.get(f, 0.0) + step * (g - 1e-3 * w.get(f, 0.0))
    return {f: round(x, 6) for f, x in sorted(w.items())}


def regions(text: str, taken: list[tuple[int, int]], found_chains: dict[int, list[tuple[int, str]]]) -> list[tuple[int, int]]:
    """Stretches that hold all candidate segments: whole stretches of numbers, and whole chains of parts, merged where they meet.

    A number is a part of one stretch, so no candidate goes past a region's edge. Stretches inside one of those taken give none.
    """
    found = [m.span() for m in _STRETCH.finditer(text)] if _DIGIT.search(text) else []
    found += [(a, b) for b, heads in found_chains.items() for a, _ in heads]
    out: list[tuple[int, int]] = []
    k = 0
    for a, b in sorted(found):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] <= a and b <= taken[k][1]:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Finder:
    """Base spans and added spans of a text."""

    def __init__(self, weights: dict[str, float]):
        self.scorer = Scorer(weights)

    def __call__(self, text: str) -> tuple[list, list]:
        base, added = base_spans(text), []
        taken = _merged(base)
        found = chains(text, taken)
        for a, b in regions(text, taken, found):
            added += decode(text, self.scorer, a, b, _within(taken, a, b), found)
        return base, added


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans as stretches that don't overlap."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _within(taken: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Those of stretches in order that overlap [a, b)."""
    first = bisect_right(taken, a, key=lambda t: t[1])
    return taken[first : bisect_left(taken, b, first, key=lambda t: t[0])]


def spans_string(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in order)


def find_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_email, n_ip, n_card, n_phone (fixed patterns), base_sha256, spans, n_added.

    Whole texts are read; a null text counts as empty. Null keys and repeated rows pass through; an empty table gives
    no rows; other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    weights = train()

    def make():
        only_remember("pii")
        find = Finder(weights)

        def work(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in range(7)]
            for t in texts:
                base, added = find(t)
                row = [*(sum(k == kind for _, _, k in base) for kind in KINDS), hashlib.sha256(spans_string(base).encode()).hexdigest(), spans_string(base + added), len(added)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    return per_text(docs, text, [key], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", make)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def mask_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in text masked: a null text stays null, an empty one empty; all other columns, null keys and
    repeated rows pass through, whatever the columns' names; an empty table gives no rows."""
    arrow_batches(docs.sparkSession)
    weights = train()
    rows, names = numbered(docs)
    at = names.index(text)

    def run(batches):
        import pyarrow as pa

        only_remember("pii")
        find = Finder(weights)
        for batch in batches:
            texts = []
            for t in batch.column(at).to_pylist():
                base, added = find(t) if t else ((), ())
                texts.append(mask(t, [*base, *added]) if base or added else t)
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    rows = rows.withColumn(f"_{at}", F.col(f"_{at}").cast("string"))
    return rows.mapInArrow(run, rows.schema).toDF(*names)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return find_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
