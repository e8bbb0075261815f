"""Secret scan with multipart credential linking.

Base findings stand alone: assignments, access identifiers and long hexadecimal runs. Weak
candidates (identifier-like names, high-entropy strings, service endpoints) are reported only
when a complementary part co-occurs: an interval join pairs each weak part with the parts of the
other side (secrets with identities and endpoints) in its scope, a paragraph, or the whole text
where it has no blank line. With `reach`, the two must also lie at most so many code points apart.
The two parts of a pair share no character: an opaque string inside an identity, an endpoint or a
base finding is no part of its own, and no part stands between two others to connect them.

Documents are independent, so the scan is one Arrow pass with no shuffle; within a document the
join looks up sorted ends, so its time grows with n log n parts. Spans are offsets in code points
with an exclusive end.

Defined results: null or empty text gives no findings and the digest of the empty string; every
text is scanned whole, whatever its length; spans that begin at one place are listed by kind;
repeated rows each give a row; a null doc_id is carried along; an empty table gives an empty
result; other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tabulith.llm.common import id_text, lean

# The base kinds and their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
#: Any assignment holds one of these once A-Z is lowered.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# Weak parts, by role. They count only in company.
IDENTITY = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?|tenant)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]{4,})""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])", re.A)
IDENTITY_HINTS = (b"user", b"login", b"client", b"account", b"access", b"tenant")
ENDPOINT_HINTS = (b"://", b"host", b"endpoint", b"server")
SCOPE = re.compile(r"\n[\x20\t]*\n")
ROLES = {"assign": "secret", "hex": "secret", "access": "identity", "weak_identity": "identity", "weak_endpoint": "endpoint", "weak_secret": "secret"}


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def opaque(s: str) -> bool:
    """Random-looking: letters of both cases or digits mixed, with much entropy."""
    classes = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return classes == 3 and entropy(s) >= 3.7


def base_spans(text: str, low: bytes) -> list[tuple[int, int, str]]:
    found = []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def weak_spans(text: str, low: bytes) -> list[tuple[int, int, str]]:
    found = []
    if any(k in low for k in IDENTITY_HINTS):
        found += [(m.start(), m.end(), "weak_identity") for m in IDENTITY.finditer(text)]
    if any(k in low for k in ENDPOINT_HINTS):
        found += [(m.start(), m.end(), "weak_endpoint") for m in ENDPOINT.finditer(text)]
    return found


class Parts:
    """Spans of one side, to look up whether one lies near a place."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = sorted(s for s, _ in spans)
        self.ends = sorted(e for _, e in spans)

    def near(self, start: int, end: int, low: int, high: int) -> bool:
        """Whether a span lies within low..high, wholly before start or wholly after end."""
        k = bisect_left(self.starts, end)
        if k < len(self.starts) and self.starts[k] <= high:
            return True
        k = bisect_right(self.ends, start)
        return k > 0 and self.ends[k - 1] >= low


def covered(spans: list[tuple[int, int]]):
    """A function that tells whether a span meets any of `spans`."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def meets(s: int, e: int) -> bool:
        k = bisect_left(starts, e) - 1
        return k >= 0 and ends[k] > s

    return meets


def linked(text: str, low: bytes, base: list[tuple[int, int, str]], reach: int | None) -> list[tuple[int, int, str]]:
    """Weak spans that an interval join pairs with complementary parts."""
    weak = weak_spans(text, low)
    if not base and not weak:
        return []
    taken = covered([(s, e) for s, e, _ in base])
    weak = [w for w in weak if not taken(w[0], w[1])]
    if weak or any(ROLES[k] != "secret" for _, _, k in base):
        taken = covered([(s, e) for s, e, _ in [*base, *weak]])
        weak += [(m.start(), m.end(), "weak_secret") for m in OPAQUE.finditer(text) if opaque(m[0]) and not taken(m.start(), m.end())]
    if not weak:
        return []
    edges = [0, *(m.start() for m in SCOPE.finditer(text)), len(text) + 1]
    scopes: dict[int, dict[bool, list]] = {}
    for part in [*base, *weak]:
        at = bisect_right(edges, part[0]) - 1
        scopes.setdefault(at, {True: [], False: []})[ROLES[part[2]] == "secret"].append(part)
    out = []
    for sides in scopes.values():
        for secret in (True, False):
            found = [p for p in sides[secret] if p[2].startswith("weak")]
            if found and sides[not secret]:
                other = Parts([(s, e) for s, e, _ in sides[not secret]])
                out += [p for p in found if other.near(p[0], p[1], -1 if reach is None else p[0] - reach, len(text) if reach is None else p[1] + reach)]
    return out


def scan_text(text: str | None, reach: int | None = None) -> tuple[int, int, int, str, str]:
    text = text or ""
    low = text.encode("utf-8", "surrogatepass").lower()
    base = base_spans(text, low)
    say = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    listed = say(base)
    order = (*KINDS, "weak_identity", "weak_endpoint", "weak_secret")
    every = sorted({*base, *linked(text, low, base, reach)}, key=lambda x: (x[0], order.index(x[2])))
    count = [sum(k == kind for _, _, k in base) for kind in KINDS]
    return (*count, hashlib.sha256(listed.encode()).hexdigest(), say(every))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(documents: DataFrame, reach: int | None = None) -> DataFrame:
    """One row per document: counts of base kinds, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*(scan_text(t.as_py(), reach) for t in b.column(1)), strict=True)) or [[]] * 5
            cols = [b.column(0).cast(pa.int64()), *(pa.array(got[i], pa.int64()) for i in range(3)), *(pa.array(got[i], pa.string()) for i in (3, 4))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_text(documents).mapInArrow(lean(run), SCHEMA)
