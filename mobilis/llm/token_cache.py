"""Exact, cached encoding of whole texts with the public tokenizers.

A BPE tokenizer never merges across pre-token boundaries, so a text may be cut
at places that are pre-token boundaries in every context and its pieces encoded
one by one. Pieces repeat (words), so each Python worker keeps the ids of the
pieces that it saw last, and of those that come again and again. A new piece of printable Latin-1
characters is pre-tokenised here, where all Unicode versions agree on letters
and digits, and its pre-tokens go to the tokenizer's model; any other new piece
goes through the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable
from typing import NamedTuple

#: Pieces that are new since the cache aged last, and pieces that stay because they come again: at most 1,000,000 and 350 MB with the last new ones.
LIMIT, KEPT = 300_000, 400_000

_ENCODERS: dict[tuple, PieceEncoder] = {}
_PLAIN = re.compile("[ \n]?[!-~\xa1-\xff]*")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Cutter(NamedTuple):
    """How a kind of tokenizer sees text: safe pieces, and the pre-tokens of a plain piece."""

    name: str
    pieces: Callable[[str], list[str]]
    pre_tokens: Callable[[str], list[str]]
    lower: bool


def byte_letters() -> str:
    """The character that stands for each byte in byte-level vocabularies, as a table for str.translate."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


class _Pieces(dict):
    """Ids of pieces as 32-bit integers of this machine's (little-endian) order, found when they are first asked for."""

    def __init__(self, path: str, cutter: Cutter):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.letters, self.cutter = self.tokenizer.model, byte_letters(), cutter
        self.tokenize, self.lower = self.model.tokenize, cutter.lower
        self.older: dict[str, bytes] = {}
        self.kept: dict[str, bytes] = {}  # pieces that came again when they were old

    def _ids(self, word: str) -> bytes:
        """Of one pre-token of plain characters."""
        if word.isascii() and "\n" not in word:
            shown = "\u0120" + word[1:] if word[:1] == " " else word  # U+0120 stands for a blank
        else:
            shown = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is not None:
            self[piece] = self.kept[piece] = value
            return value
        text = piece.lower() if self.lower else piece
        body = text[1:] if text[:1] == " " else text
        word = body.rstrip(_MARKS)  # letters alone are one pre-token, and so are the marks after them
        if word.isalpha() and (word.isascii() or max(piece) <= "\xff"):
            marks = len(word) - len(body)
            value = self[text[:marks]] + self[text[marks:]] if marks else self._ids(text)
        elif _PLAIN.fullmatch(piece):
            words = self.cutter.pre_tokens(text)
            value = self._ids(piece) if words == [piece] else b"".join([self[w] for w in words])
        else:
            value = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = value
        return value

    def age(self) -> None:
        """Forgets what was not used since the last time, once there is much; what came again stays."""
        if len(self) - len(self.kept) > LIMIT:
            self.older = dict(self)
            self.clear()
            if len(self.kept) > KEPT:
                self.kept = {}
            self.update(self.kept)


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cutter: Cutter):
        self.cutter, self.known = cutter, _Pieces(path, cutter)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        self.known.age()
        ids = self.known.__getitem__
        return [b"".join(map(ids, self.cutter.pieces(t))) if t else b"" for t in texts]


def encoder(path: str, cutter: Cutter) -> PieceEncoder:
    """The encoder of this Python worker for a vocabulary file.

    It is found by the cutter's name: each task unpickles a cutter of its own, which does not equal the one before.
    """
    key = path, cutter.name
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, cutter)
    return _ENCODERS[key]


def _at_blanks(text: str) -> list[str]:
    """No token spans a blank or a line end."""
    return text.replace("\n", " ").split(" ")


_INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")


def _before_blanks(text: str) -> list[str]:
    """A blank starts the token of the word after it.

    A single blank between two other characters always starts a token; a single
    line end between two others is a token by itself. Where white space comes
    in runs, at the ends or in other kinds, only the first rule is used.
    """
    runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
    if not runs and text.replace("\n", " ").isprintable():  # any other white space counts as not printable
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
    return [text] if "\x00" in text else _INNER_BLANK.sub("\x00 ", text).split("\x00")


# How the two kinds of public vocabularies split text.
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _scanner(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return regex.compile(pattern).findall


#: For byte-level vocabularies that keep white space, and for lower-case ones that drop it.
BYTE_LEVEL = Cutter("byte level", _before_blanks, _scanner(_BYTE_WORDS), False)
LOWER_CASE = Cutter("lower case", _at_blanks, _scanner(_LOWER_WORDS), True)
