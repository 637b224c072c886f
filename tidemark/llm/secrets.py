"""Secret scan: keyword prefilter, anchored expressions near the hits, then the checksum inside the token.

One Aho-Corasick automaton finds every keyword of a text in one pass. An expression runs only at the places where its
keyword was hit, and a candidate whose format carries a checksum counts only if the checksum holds. Long hex strings have
no keyword, so they are found by one linear expression of their own.

Base kinds, leftmost and without overlap within a kind: `assign` (a keyword, a separator and a value of 8 characters or
more), `access` (16 characters or more from AKIA on) and `hex` (32 hex digits or more). Added kinds: `checked` (tokens
with a CRC-32 in base 62 at their end), `jwt` (header that decodes to JSON) and `pem` (a private key block).

Positions are code points, the end is exclusive, and an `assign` span runs from the keyword to the end of the value.

Cases: a null or empty text has no spans and the digest of the empty string; a null id is carried; repeated rows give
repeated rows; an empty table gives an empty result; other columns are not read. Whole texts are scanned, in time linear
in their length: no run of characters is tried again from a later hit inside it.
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
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "checked", "jwt", "pem")
BASE = KINDS[:3]

#: Keywords of each kind (in lower case) and the expression that is tried at a hit.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
ANCHORED = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
                         , re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "checked": re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"),
}
#: What a failed try rules out for later hits: a run of a web token's first part ends where it ends, wherever it begins.
RULED_OUT = {"jwt": re.compile(r"eyJ[A-Za-z0-9_-]*+")}
HEX = re.compile(r"[0-9a-f]{32,}")
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def checksum_holds(body: str, check: str) -> bool:
    """Whether `check` is the CRC-32 of `body` in base 62, padded to six digits."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def header_decodes(part: str) -> bool:
    """Whether the first part of a web token is a JSON object that names an algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError, TypeError, RecursionError):
        return False


ACCEPT = {
    "assign": lambda m: len(m[1]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "checked": lambda m: checksum_holds(m[1], m[2]),
    "jwt": lambda m: header_decodes(m[1]),
    "pem": lambda m: True,
}


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """All spans of a text as (start, kind, end), in order."""
    folded = text.lower()
    if len(folded) != len(text):  # a letter whose lower case is longer: positions would move
        folded = text.translate(_LOWER)
    starts: dict[str, list[int]] = {}
    for last, (kind, length) in automaton().iter(folded):
        starts.setdefault(kind, []).append(last - length + 1)
    spans = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    for kind, places in starts.items():
        free, match, accept, failed = 0, ANCHORED[kind].match, ACCEPT[kind], RULED_OUT.get(kind)
        for start in sorted(places):
            if start < free:
                continue
            m = match(text, start)
            if m and accept(m):
                spans.append((start, kind, m.end()))
            elif failed:
                m = failed.match(text, start)
            if m:  # a failing match also takes its characters, or those that it rules out
                free = m.end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def _row(text: str | None) -> tuple[int, int, int, str, str]:
    spans = find_secrets(text) if text else []
    written = [(kind, f"{kind}:{start}:{end}") for start, kind, end in spans]
    counts = [sum(kind == k for k, _ in written) for kind in BASE]
    base = ",".join(s for k, s in written if k in BASE)
    return *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in written)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = [_row(text.as_py()) for text in batch["text"]]
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch["id"], *found], ["id", *columns])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    ).withColumnRenamed("id", id_col)
