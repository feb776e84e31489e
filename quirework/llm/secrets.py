"""Secret scans: Aho-Corasick keywords, anchored expressions at their hits, checksums inside tokens.

The automaton finds the fixed words with which each kind of secret begins;
a kind's expression is tried at such places only. Runs of hexadecimal digits
have no keyword: every run long enough covers one of the places 15, 31, 47 ...,
so only digits there are looked at. Base kinds (assign, access, hex) are
leftmost and non-overlapping per kind. Added kinds must pass a check: the CRC-32
of a repository token in its last six base-62 digits, the header of a JSON web
token, the base64 body of a private key.

Cases: null and empty texts have no spans; texts of any length are scanned
whole, in time that grows with their length whatever they hold; equal texts give equal spans; empty tables give empty results; other
columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, steps

ASSIGN, ACCESS, HEX = "assign", "access", "hex"
BASE = (ASSIGN, ACCESS, HEX)
ADDED = ("repo_token", "web_token", "private_key")
KINDS = (*BASE, *ADDED)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f]+")
_REPO = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
# Runs are possessive, and none holds the character that ends it or a begin line, so that no text is read again and again.
_WEB = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
_WEB_RUN = re.compile(r"[A-Za-z0-9_-]*+")
_KEY = re.compile(r"-----BEGIN ((?:[A-Z]++ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----")
_DIGITS = string.digits + string.ascii_uppercase + string.ascii_lowercase

#: Least characters of an assigned value, an access key, a run of hexadecimal digits.
LEAST = {ASSIGN: 12, ACCESS: 18, HEX: 16}
_WORDS = {"password": ASSIGN, "passwd": ASSIGN, "secret": ASSIGN, "token": ASSIGN, "api_key": ASSIGN, "apikey": ASSIGN, "akia": ACCESS, "ghp_": "repo_token", "gho_": "repo_token", "ghu_": "repo_token", "ghs_": "repo_token", "ghr_": "repo_token", "npm_": "repo_token", "eyj": "web_token", "-----begin ": "private_key"}
_LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in _WORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.rjust(width, "0")


def _repo_ok(m: re.Match) -> bool:
    return base62(zlib.crc32(m[1].encode()), 6) == m[2]


def _web_ok(m: re.Match) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, TypeError, RecursionError):  # nested too deep to be a header
        return False


def _key_ok(m: re.Match) -> bool:
    try:
        return len(base64.b64decode("".join(m[2].split()), validate=True)) > 0
    except (binascii.Error, ValueError):
        return False


_RULES = {
    ASSIGN: (_ASSIGN, lambda m: len(m[2]) >= LEAST[ASSIGN]),
    ACCESS: (_ACCESS, lambda m: len(m[0]) >= LEAST[ACCESS]),
    "repo_token": (_REPO, _repo_ok),
    "web_token": (_WEB, _web_ok),
    "private_key": (_KEY, _key_ok),
}


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    step = LEAST[HEX]
    end = 0
    for m in _HEX_RUN.finditer(text[step - 1 :: step]):
        for k in range(m.start(), m.end()):
            at = k * step + step - 1
            if at < end:
                continue
            start = at
            while start > end and text[start - 1] in "0123456789abcdef":
                start -= 1
            end = _HEX_RUN.match(text, at).end()
            if end - start >= step:
                yield start, end


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind as listed in KINDS."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lowered
        low = text.translate(_LOWER)
    spans = []
    free = dict.fromkeys(KINDS, 0)
    hits = [(end - size + 1, kind) for end, (kind, size) in _automaton().iter(low)]
    hits.sort()
    for start, kind in hits:
        if start < free[kind]:
            continue
        pattern, good = _RULES[kind]
        if m := pattern.match(text, start):
            free[kind] = m.end()
            if good(m):
                spans.append((kind, start, m.end()))
        elif kind == "web_token":  # no later place of the same run has the dots that this one lacks
            free[kind] = _WEB_RUN.match(text, start).end()
    spans += [(HEX, a, b) for a, b in _hex_runs(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = [scan(t) for t in batch.column("text").to_pylist()]
            if not digests:
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])
                continue
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            cols = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            cols += [pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base]), pa.array([joined(s) for s in found])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end)); map-only."""
    return only(docs, id_col, text_col).mapInArrow(_scan(False), f"doc_id {dict(docs.dtypes)[id_col]}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans as text): find_secrets, reduced where it is made."""
    return only(docs, id_col, text_col).mapInArrow(_scan(True), f"doc_id {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
