"""Secret scan with multipart credential linking.

Strong parts are credentials by their form alone: an assignment to a secret
name (``assign``), an access key (``access``), a long hexadecimal run (``hex``).
Weak parts prove nothing alone: an identifier assignment (``key_id``), a bare
mixed token (``bare``), a URL (``endpoint``). Weak parts are reported only where
complementary parts meet inside one scope, found by an interval join: the scope
of a part reaches ``SCOPE_CHARS`` code points to both sides of it and ends at a
blank line.

* An identifier needs a secret in its scope, a bare token an identifier; if
  both are weak, an endpoint has to be in the same scope too.
* An endpoint needs an identifier and a secret in its scope.

All parts of a link lie in one text, so the join runs inside the row, sorted
and by bisection: no shuffle, and no pairs are built, however many parts a
text holds.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "key_id", "bare", "endpoint")
BASE = 3
SCOPE_CHARS = 200
PLACEHOLDER = "[REDACTED]"

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
# End of the fixed values.

_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_HEX_MASK = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_HEX_RUN = b"1" * HEX_CHARS
_KEY_ID = re.compile(
    r"""(?:access|client|account|user|login|key)[_-]?(?:id|name)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""",
    re.IGNORECASE | re.ASCII,
)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.:-")
_LETTERS = frozenset(c for c in _SCHEME if c.isalpha())
_ADDRESS = re.compile(r"""[^\s"'<>]+""")
_BLANK = re.compile(r"\n[ \t]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the strong parts, leftmost and without
    overlap within a kind; a match that is too short is dropped, not regrown."""
    found = []
    if any(hint in text.lower() for hint in _ASSIGN_HINTS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_MASK):
        found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def endpoints(text: str) -> list[tuple[int, int]]:
    """Spans of URLs: a letter and scheme characters, ``://`` and an address. Looked
    for from each ``://`` backwards, so that a long run of letters is read once."""
    found, last, at = [], 0, text.find("://")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _SCHEME:
            start -= 1
        while start < at and text[start] not in _LETTERS:
            start += 1
        address = _ADDRESS.match(text, at + 3) if start < at else None
        if address:
            last = address.end()
            found.append((start, last))
        at = text.find("://", max(at + 1, last))
    return found


def _disjoint(spans, taken):
    """Spans that touch none of the sorted spans already taken."""
    ends = [t[1] for t in taken]
    out = []
    for s in spans:
        i = bisect_left(ends, s[0] + 1)
        if i == len(taken) or taken[i][0] >= s[1]:
            out.append(s)
    return out


def _weak_parts(text: str, base):
    merged = []
    for s in base:
        if merged and s[0] < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
        else:
            merged.append((s[0], s[1]))
    ends = _disjoint(endpoints(text), merged)
    taken = sorted(merged + ends)
    ids = _disjoint([m.span(1) for m in _KEY_ID.finditer(text)], taken)
    taken = sorted(taken + ids)
    mixed = [
        m.span()
        for m in _BARE.finditer(text)
        if any(c.isdigit() for c in m[0]) and any(c.isupper() for c in m[0]) and any(c.islower() for c in m[0])
    ]
    return ids, _disjoint(mixed, taken), ends


class _Intervals:
    """Spans without overlap, probed by scope."""

    def __init__(self, spans):
        self.spans = sorted(spans)
        self.ends = [s[1] for s in self.spans]

    def meets(self, scope: tuple[int, int]) -> bool:
        i = bisect_left(self.ends, scope[0] + 1)
        return i < len(self.spans) and self.spans[i][0] < scope[1]


def linked_spans(text: str, base) -> list[tuple[int, int, int]]:
    """The weak parts of a text that complementary parts confirm."""
    if not base and "://" not in text:
        return []  # every link holds a strong part or an endpoint
    ids, bare, ends = _weak_parts(text, base)
    if not ids and not bare and not ends:
        return []
    strong_id = _Intervals([s[:2] for s in base if s[2] == 1])
    weak_id, endpoint = _Intervals(ids), _Intervals(ends)
    # A hexadecimal run may lie inside an assignment: only the longer one counts.
    secrets, last = [], -1
    for s in sorted((s[:2] for s in base if s[2] != 1), key=lambda s: (s[0], -s[1])):
        if s[0] >= last:
            secrets.append(s)
            last = s[1]
    strong_secret, weak_secret = _Intervals(secrets), _Intervals(bare)
    blanks = [m.start() for m in _BLANK.finditer(text)]

    def scope(span):
        i = bisect_left(blanks, span[0])
        low = max(span[0] - SCOPE_CHARS, blanks[i - 1] if i else 0)
        return low, min(span[1] + SCOPE_CHARS, blanks[i] if i < len(blanks) else len(text))

    found = []
    for span in ids:
        s = scope(span)
        if strong_secret.meets(s) or (weak_secret.meets(s) and endpoint.meets(s)):
            found.append((*span, 3))
    for span in bare:
        s = scope(span)
        if strong_id.meets(s) or (weak_id.meets(s) and endpoint.meets(s)):
            found.append((*span, 4))
    for span in ends:
        s = scope(span)
        if (strong_id.meets(s) or weak_id.meets(s)) and (strong_secret.meets(s) or weak_secret.meets(s)):
            found.append((*span, 5))
    return found


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of one text by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked_spans(text, base), key=lambda s: (s[0], s[2]))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCAN = "spans string, base_spans string, n_assign long, n_access long, n_hex long, n_linked long"


def scan(text: Column) -> Column:
    """Struct of ``spans`` and ``base_spans`` (kind:start:end, joined by commas,
    in code points) and counts. A null or empty text has no spans."""

    @F.pandas_udf(SCAN)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            spans = scan_text(value)
            base = [s for s in spans if s[2] < BASE]
            counts = [sum(s[2] == k for s in base) for k in range(BASE)]
            rows.append((joined(spans), joined(base), *counts, len(spans) - len(base)))
        return pd.DataFrame(rows, columns=["spans", "base_spans", "n_assign", "n_access", "n_hex", "n_linked"])

    return scanned(text)


def redacted_text(text: str | None) -> str | None:
    spans = scan_text(text)
    if not spans:
        return text
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """Every document, with each reported span of its text replaced by a
    placeholder (overlapping spans by one) and ``n_chars``, if present, counted
    anew where the text changed. Null texts and all other columns stay."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(redacted_text, na_action="ignore")

    out = docs.withColumn("text", cleaned(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, ``base_sha256`` and ``spans``."""
    found = docs.select("doc_id", scan(F.col("text")).alias("found"))
    return found.select(
        "doc_id",
        "found.n_assign",
        "found.n_access",
        "found.n_hex",
        F.sha2("found.base_spans", 256).alias("base_sha256"),
        "found.spans",
        "found.n_linked",
    )


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
