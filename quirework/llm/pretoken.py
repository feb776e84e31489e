"""Pre-tokens of byte-level BPE: special strings first, then the public split pattern."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import regex

#: Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# White space as the Unicode property has it: without the separators U+001C to U+001F that Python's \s adds.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ANY = regex.compile(PATTERN.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
# The same classes written out for texts without code points above U+00FF; the standard library matches them faster.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\x0b\x0c\r \x85\xa0"
_NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


@functools.cache
def _new() -> regex.Pattern:
    """Code points that are letters or numbers in the regex module's tables and new to Python's; the tokenizers
    library's tables lie between the two, so it splits texts with these itself."""
    newer = regex.compile(r"[\p{L}\p{N}]")
    found = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and newer.match(chr(c))]
    return regex.compile("[" + "".join(f"\\U{c:08x}" for c in found) + "]" if found else r"(?!)")


@functools.cache
def _library():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def pieces(text: str) -> list[str]:
    """Pre-tokens of a text without special strings."""
    if text.isascii():
        return _NARROW.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _new().search(text):
            return [text[a:b] for _, (a, b) in _library().pre_tokenize_str(text)]
        return _ANY.findall(text)
    return _NARROW.findall(text)


class Splitter:
    """Cuts special strings out of texts, leftmost and longest first, as the tokenizers library does."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self._find = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(self, text: str) -> bool:
        return self._find is None or not self._find.search(text)

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """(text, -1) for ordinary parts and (string, id) for special ones."""
        at = 0
        for m in self._find.finditer(text) if self._find else ():
            if m.start() > at:
                yield text[at : m.start()], -1
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], -1
