"""Splitting text by the public byte-level BPE pattern, and its vocabulary files.

``split`` gives exactly the matches of ``public_tokenizers.PATTERN``. Texts
whose code points are all below 256 go through an equivalent pattern of the
standard ``re`` module, where the Unicode classes are written out for that
range; it is about twice as fast. Other texts go through ``regex``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import regex

#: The Unicode letters, numbers and white space below U+0100.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
#: White space as Unicode has it; ``\s`` of Python's modules also takes U+001C to U+001F.
_ALL_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_LOW = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies keep ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _any(pattern: str) -> regex.Pattern:
    written_out = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_ALL_SPACE}\p{{L}}\p{{N}}]")
    written_out = written_out.replace(r"\s+(?!\S)|\s+", rf"[{_ALL_SPACE}]+(?![^{_ALL_SPACE}])|[{_ALL_SPACE}]+")
    return regex.compile(written_out)


def splitter() -> Callable[[str], list[str]]:
    """A function from a text to its list of pieces."""
    import public_tokenizers

    low, anything = _LOW.findall, _any(public_tokenizers.PATTERN).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return anything(text)
        return low(text)

    return split


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class BoundedCache(dict):
    """A memo of ``make(key)`` with at most ``limit`` entries: when full it starts again, which costs time and changes nothing."""

    def __init__(self, limit: int, make: Callable | None = None):
        super().__init__()
        self.limit, self.make = limit, make

    def __missing__(self, key):
        if self.make is None:
            raise KeyError(key)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
