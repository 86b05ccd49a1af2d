"""Encoding whole texts with a tokenizer file: texts fall into parts that encode alone, and parts are remembered."""

from __future__ import annotations

import os
import re
from array import array
from unicodedata import is_normalized

from tokenloom.llm._common import remembers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space by Unicode's property, which the tokenizers' \s follows (Python's own \s has four more).
SPACE = "\t-\r \x85\xa0  -     　"
#: A word with the space before it, or white space up to the last before a word: no pretoken spans two of them.
SPACED = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: For tokenizers that drop white space, in texts where Python's idea of it differs.
WORDS = re.compile(r"[^ \n\r\t]+")
_ODD_SPACE = "\x1c\x1d\x1e\x1f"

#: Parts and words that a worker remembers, and the longest one that is.
REMEMBERED, LONGEST = 700_000, 48

#: Signs that make one pretoken after a word; the apostrophe can open another.
POINTS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def public_file(name: str) -> str:
    """The place of a public tokenizer file of this installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Remembered(dict):
    """Values by key, made when first asked for. Half of `most` are held here, as many from before in `old`: what is
    asked for again moves over, what is not goes with the next turn."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, part: str) -> bytes:
        value = self.old.get(part)
        if value is None:
            value = self.make(part)
            if len(part) > LONGEST:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[part] = value
        return value


class PartEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to Tokenizer.encode(text, add_special_tokens=False).

    A part that is a word and signs after it is the word's ids and the signs', since no pretoken spans both.
    A word of letters alone goes to the tokenizer's model directly, without the normalizer and pretokenizer that would
    leave it whole. All else is encoded by the tokenizer as it stands.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced, self.model = spaced, self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.part = Remembered(self._part, REMEMBERED)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, word: str) -> bytes:
        space = self.spaced and word[:1] == " "
        plain = word[1:] if space else word
        if not plain.isalpha():
            return self._whole(word)
        if plain.isascii():
            raw = ("\u0120" if space else "") + (plain if self.spaced else plain.lower())
        else:
            if max(plain) >= "\u0530":
                return self._whole(word)
            if not self.spaced:
                lower = word.lower()
                if "\u03a3" in word or not lower.isalpha() or len(lower) != len(word) or not is_normalized("NFC", word):
                    return self._whole(word)
                word = lower
            raw = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def _part(self, part: str) -> bytes:
        word = part.rstrip(POINTS)
        if not word or not word[-1].isalnum() or word[-1] == "\u0130":  # its lower case ends in a mark
            return self._whole(part)
        plain = word.lower() if not self.spaced and word.isascii() else word
        if len(word) < len(part):
            return self.part[plain] + self.part[part[len(word) :]]
        return self._core(part) if plain == part else self.part[plain]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # special tokens cut the text before it falls into words
            return self._whole(text)
        if self.spaced:
            parts = SPACED.findall(text)
        elif any(c in text for c in _ODD_SPACE):
            parts = WORDS.findall(text)
        else:
            parts = text.split()
        return b"".join(map(self.part.__getitem__, parts))


_encoders: dict[tuple[str, bool], PartEncoder] = {}
remembers("vocab", _encoders.clear)


def encoder(path: str, spaced: bool) -> PartEncoder:
    """One encoder a worker and file."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = PartEncoder(path, spaced)
    return _encoders[path, spaced]
