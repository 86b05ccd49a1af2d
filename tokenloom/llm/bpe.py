"""Byte-level BPE as a streaming transducer, and its inverse as a byte-to-text state machine.

A byte string has one BPE encoding, and the encoding of each of its prefixes is known by its last token alone: the
last token t of the prefix that ends at i is the one token ending at i that is compatible with the last token of the
prefix that ends at i - len(t). So the encodings of all prefixes form a tree. Tokens are no longer than L bytes, the
longest that the merge list can make: whatever comes, the encoding passes through one of the last L prefixes. A token
is stable once all of these have it among their ancestors; then it is emitted, and what lies before is forgotten.

No token spans two pretokens, so the tree begins anew with each; in one shorter than L the empty prefix is live to the
end, and its tokens are stable there and no sooner. A text is read window by window, and its ids leave in blocks, which
the decoder takes as they come: beside the text itself only a window, a block and a few times L bytes are held.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import arrow_batches, column, only_remember, per_text, remembers
from tokenloom.llm.vocab import POINTS, REMEMBERED, SPACED, Remembered, byte_letters, public_file

#: How the byte-level pretokenizer cuts text; the published pattern of this vocabulary, a fixed value.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Compatible pairs that a worker remembers.
PAIRS = 1_000_000
#: Characters of a text that are read at once, at least.
WINDOW = 1 << 16


#: The end of a word before a single space: letters and digits on both sides.
_GAP = re.compile("[A-Za-z0-9] (?=[A-Za-z0-9])")


class ByteBPE:
    """A byte-level BPE tokenizer file: encoder by bounded lookahead, decoder, both over whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: raw(s) for s, i in spec["model"]["vocab"].items() if s not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        id_of = {b: i for i, b in self.tokens.items()}
        self.merge = {(id_of[raw(a)], id_of[raw(b)]): (k, id_of[raw(a + b)]) for k, (a, b) in reversed([*enumerate(merges)])}
        # only what the merge list makes of its own bytes can ever be a token of an encoding
        self.id_of = {b: i for b, i in id_of.items() if self.reduce([id_of[b[k : k + 1]] for k in range(len(b))]) == [i]}
        #: The sufficient lookahead in bytes: no token starts further back.
        self.lookahead = max(map(len, self.id_of))
        by_end: dict[int, set[int]] = {}
        for b in self.id_of:
            by_end.setdefault(b[-1], set()).add(len(b))
        self.lengths = [sorted(by_end.get(k, ()), reverse=True) for k in range(256)]
        #: The same for the first ends of a string, shorter than the lookahead: lengths that fit before end, by end and last byte.
        self.early = [[[n for n in lengths if n <= end] for lengths in self.lengths] for end in range(self.lookahead)]
        self.made = {new: (k, pair) for pair, (k, new) in self.merge.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        self.part = Remembered(self._part, REMEMBERED)
        self.find = regex.compile(PRETOKENS).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = dict(self.tokens) | {i: s.encode() for s, i in self.special.items()}

    def reduce(self, ids: list[int]) -> list[int]:
        """Merges, the earliest of the list first and leftmost among equals, until none applies."""
        merge = self.merge
        while len(ids) > 1:
            best = min(((merge[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merge), default=None)
            if best is None:
                break
            (_, new), k = best
            ids = [*ids[:k], new, *ids[k + 2 :]]
        return ids

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one end (0 left, 1 right) of a token as its merges build it, each with the rank that ends it."""
        found = self.spines[side].get(token)
        if found is None:
            chain, rank = [], float("inf")
            while True:
                chain.append((token, rank))
                if token not in self.made:
                    break
                rank, parts = self.made[token]
                token = parts[side]
            found = self.spines[side][chain[0][0]] = chain[::-1]
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart as neighbours: the bytes of both encode as [a, b].

        While both are built up, their tokens beside the border must not merge first; among equal ranks the merge
        further left comes first.
        """
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            left, right, merge, i, j = self._spine(a, 1), self._spine(b, 0), self.merge, 0, 0
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                across = merge.get((x, y))
                if across is not None and across[0] < until_x and across[0] <= until_y:
                    found = False
                    break
                if i == len(left) - 1 and j == len(right) - 1:
                    found = True
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            self.fits[a, b] = found
        return found

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The encoding of the joined chunks, each token as soon as it is stable."""
        data = bytearray()  # bytes not yet forgotten
        last: list[tuple[int, int] | None] = [None]  # for each prefix end since base: its last token and that one's start
        id_of, lengths, fits = self.id_of, self.lengths, self.compatible
        for chunk in chunks:
            for byte in chunk:
                data.append(byte)
                end, found = len(data), None
                for n in lengths[byte]:
                    if n > end:
                        continue
                    before = last[end - n]
                    if before is None and end - n:
                        continue
                    t = id_of.get(bytes(data[end - n :]))
                    if t is not None and (before is None or before[0] < 0 or fits(before[0], t)):
                        found = (t, end - n)
                        break
                last.append(found)
            if len(data) > 4 * self.lookahead:
                stable, root = self._stable(last, len(data))
                yield from stable
                if root:
                    kept = last[root][0]
                    data = data[root:]
                    last = [(kept, -1), *((t, s - root) if s >= root else None for t, s in (x or (0, -1) for x in last[root + 1 :]))]
        yield from self._path(last, len(data))

    @staticmethod
    def _path(last: list, end: int) -> list[int]:
        out = []
        while end and last[end]:
            t, end = last[end]
            out.append(t)
        return out[::-1]

    def _stable(self, last: list, end: int) -> tuple[list[int], int]:
        """Tokens that every live prefix has, and where they end."""
        live = {k for k in range(max(0, end - self.lookahead + 1), end + 1) if k == 0 or last[k]}
        while len(live) > 1:  # walk the furthest back until all meet
            far = max(live)
            live.discard(far)
            live.add(last[far][1] if far else 0)
        root = live.pop()
        return self._path(last, root), root

    def _short(self, raw: bytes) -> list[int]:
        """stream() for a whole string shorter than the lookahead: all prefixes stay live to its end."""
        id_of, known, fits, early = self.id_of, self.fits, self.compatible, self.early
        last, start = [-1], [0]
        for end, byte in enumerate(raw, 1):
            for n in early[end][byte]:
                begin = end - n
                t = id_of.get(raw[begin:end])
                if t is not None:
                    before = last[begin]
                    if begin == 0 or (before >= 0 and (known.get((before, t)) or ((before, t) not in known and fits(before, t)))):
                        last.append(t)
                        start.append(begin)
                        break
            else:
                last.append(-1)
                start.append(0)
        out, end = [], len(raw)
        while end:
            out.append(last[end])
            end = start[end]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        """Ids of one pretoken, as bytes."""
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.id_of.get(raw)
        if whole is not None:
            ids = [whole]
        elif len(raw) < self.lookahead:
            ids = self._short(raw)
        else:
            step = self.lookahead
            ids = [*self.stream(raw[k : k + step] for k in range(0, len(raw), step))]
        return array("I", ids).tobytes()

    def _part(self, part: str) -> bytes:
        word = part.rstrip(POINTS)  # no pretoken spans a word's end and the points after it
        if len(word) < len(part) and word and word[-1].isalnum():
            return self.part[word] + self.part[part[len(word) :]]
        plain = part[1:] if part[:1] == " " else part
        if plain.isalpha():  # one pretoken
            return self._word(part)
        return b"".join(map(self._word, self.find(part)))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.part.__getitem__, SPACED.findall(text)))

    def _windows(self, text: str) -> Iterator[str]:
        """The text in windows cut before a space that follows a word: no pretoken spans such a place."""
        start = 0
        while len(text) - start > 2 * WINDOW:
            at = start + WINDOW
            m = _GAP.search(text, at)
            if m is None:
                break
            at = m.start() + 1
            yield text[start:at]
            start = at
        yield text[start:]

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text as little-endian 32-bit bytes, a block for each window."""
        if self.cut is None or not any(s in text for s in self.special):
            for window in self._windows(text):
                yield self._plain(window)
            return
        at = 0
        for m in self.cut.finditer(text):
            for window in self._windows(text[at : m.start()]):
                yield self._plain(window)
            yield self.special[m.group()].to_bytes(4, "little")
            at = m.end()
        for window in self._windows(text[at:]):
            yield self._plain(window)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit bytes."""
        return b"".join(self.blocks(text))

    def decode(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """Text of blocks of ids, each as soon as its characters are whole; malformed bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.bytes_of.__getitem__
        for block in ids:
            yield machine.decode(b"".join(map(get, block)))
        yield machine.decode(b"", final=True)


_loaded: dict[str, ByteBPE] = {}
remembers("bpe", _loaded.clear)


def byte_bpe(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_table(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids binary (little-endian 32-bit) for each row of docs.

    A null or empty text has no ids. Keys pass through, null and repeated ones too; other columns are not read; an
    empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    path = path or public_file("byte_bpe_50k.json")
    return per_text(docs, text, [key], "ids binary", lambda: lambda texts: [[byte_bpe(path).encode(t) for t in texts]])


def decode_table(encoded: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key, text string for each row of ids, as decode(ids, skip_special_tokens=False) gives it.

    Null ids count as none and give the empty text; an unknown id is an error. Keys pass through, null and repeated
    ones too; other columns are not read; an empty table gives no rows.
    """
    path = path or public_file("byte_bpe_50k.json")
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        bpe = byte_bpe(path)
        for batch in batches:
            texts = ["".join(bpe.decode(_blocks(b or b""))) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(column(key).alias("key"), column(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def _blocks(ids: bytes, n: int = 1 << 14) -> Iterator[list[int]]:
    for k in range(0, len(ids), 4 * n):
        yield np.frombuffer(ids[k : k + 4 * n], "<u4").tolist()


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row: its encoding, and the text decoded from those ids.

    A null or empty text has no tokens and decodes to the empty text. Keys pass through, null and repeated ones too;
    other columns are not read; an empty table gives no rows. A text of any length is encoded, hashed and decoded block
    by block, in memory that does not grow with it beside the text itself.
    """
    arrow_batches(docs.sparkSession)
    path = path or public_file("byte_bpe_50k.json")

    def make():
        only_remember("bpe")
        bpe = byte_bpe(path)

        def work(texts: list[str]) -> list[list]:
            count, ids_hash, text_hash = [], [], []
            for t in texts:
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

                def passed():
                    nonlocal n
                    for block in bpe.blocks(t):  # noqa: B023
                        n += len(block) // 4
                        of_ids.update(block)  # noqa: B023
                        yield from _blocks(block)

                for piece in bpe.decode(passed()):
                    of_text.update(piece.encode())
                count.append(n)
                ids_hash.append(of_ids.hexdigest())
                text_hash.append(of_text.hexdigest())
            return [count, ids_hash, text_hash]

        return work

    return per_text(docs, text, [key], "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
