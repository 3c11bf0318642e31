"""Token ids of whole texts with the ``tokenizers`` library, fast enough for a corpus.

The library spends about a microsecond a byte.  Both vocabularies used here work on
pre-tokens that never reach over a space that is followed by a visible character, so a text
is cut at such spaces, each distinct unit is encoded once by the library, and its ids are kept
as bytes in a bounded table.  A unit of Latin letters, alone or with closing marks, goes to the
library's model without its text stages.  Tests hold the result against the library on whole
texts.

* ``byte_bpe``: a pre-token is a run of letters, digits or other visible characters with at
  most one space before it, or a run of white space.  White space before a visible character
  leaves its last space to that character, so a cut before a single space, and on both sides
  of a single line feed between visible characters, changes nothing.
* ``word_bpe``: white space is dropped and separates pre-tokens.
"""

from __future__ import annotations

import re
from array import array

import public_tokenizers
from tokenizers import Tokenizer

#: Units kept by a table of a worker, of which ``byte_bpe`` fills two; beyond that a table starts anew.
TABLE = {"word_bpe": 500_000, "byte_bpe": 250_000}
#: Longer units are encoded but not kept.
LONGEST = 64

_SPACE = re.compile(r" (?=\S)")
_LOADED: dict[tuple[str, str], Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: visible Latin-1 characters
    stand for themselves, the others are numbered from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()
_MARKS = ".,;:!?|"


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Table(dict):
    """Unit to packed ids.  Two generations: what was used lately outlives a full table."""

    def __init__(self, tokenizer: Tokenizer, before: str, lower: bool, even: bool):
        self.most = TABLE["word_bpe" if lower else "byte_bpe"]
        self.tokenizer, self.model, self.before, self.lower, self.even = tokenizer, tokenizer.model, before, lower, even
        self.mark = before.translate(_LETTERS)
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def library(self, unit: str) -> bytes:
        return _packed(self.tokenizer.encode(unit, add_special_tokens=False).ids)

    def word(self, unit: str) -> bytes | None:
        """The ids of a unit that is one pre-token of Latin letters; None for any other."""
        if not unit.isalpha():
            return None
        if self.lower:
            unit = unit.lower()
        if unit.isascii():
            letters = self.mark + unit
        elif max(unit) > "\u00ff":
            return None
        else:
            letters = (self.before + unit).encode().decode("latin-1").translate(_LETTERS)
        return _packed([t.id for t in self.model.tokenize(letters)])

    def known(self, unit: str) -> bytes | None:
        """The ids of a unit of letters, from the table if they are there."""
        out = self.get(unit)
        if out is None:
            out = self.old.get(unit)
        if out is None:
            out = self.word(unit)
            if out is not None:
                self.keep(unit, out)
        return out

    def keep(self, unit: str, ids: bytes) -> None:
        if len(unit) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = ids

    def __missing__(self, unit: str) -> bytes:
        out = self.old.get(unit)
        if out is None:
            if self.even and (not unit or unit[0].isspace() or unit[-1].isspace()):
                raise _Uneven
            core = unit.rstrip(_MARKS)
            out = self.known(core.lower() if self.lower else core) if core.isalpha() else None
            if out is None:
                out = self.library(self.before + unit)
            elif len(core) < len(unit):
                out += self.ends(unit[len(core) :])
        self.keep(unit, out)
        return out

    def ends(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(marks) > 3:
                return self.library(marks)
            self.marks[marks] = self.library(marks)
        return self.marks[marks]


class _Uneven(Exception):
    """White space beyond single blanks and line feeds: the text takes the other way."""


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers.  Null is empty."""

    def __init__(self, path: str, kind: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        lower = kind == "word_bpe"
        self.head = _Table(self.tokenizer, "", lower, not lower)
        self.tail = _Table(self.tokenizer, " ", lower, True)
        self.loose = _Table(self.tokenizer, " ", lower, False)
        self.bare = _Table(self.tokenizer, "", lower, False)
        self.line = _packed(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "word_bpe":
            if "<|" not in text and _latin(text):  # lower-casing first makes fewer units; special tokens keep their case
                text = text.lower()
            return b"".join(map(self.head.__getitem__, text.replace("\n", " ").split(" ")))
        try:
            out = []
            for line in text.split("\n"):
                units = line.split(" ")
                out.append(self.head[units[0]] + b"".join(map(self.tail.__getitem__, units[1:])))
            return self.line.join(out)
        except _Uneven:
            units = _SPACE.split(text)
            return self.bare[units[0]] + b"".join(map(self.loose.__getitem__, units[1:]))


def encoder(name: str, folder: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; ``folder`` replaces the installed one."""
    path = f"{folder}/{name}" if folder else str(public_tokenizers.path(name))
    key = (path, "word_bpe" if name.startswith("word_bpe") else "byte_bpe")
    if key not in _LOADED:
        _LOADED[key] = Encoder(*key)
    return _LOADED[key]
