"""Secret scans: fixed patterns, and strings that a token vocabulary compresses badly.

Ordinary words are few tokens of a byte-pair vocabulary; random strings fall apart into short
ones. A run of `[A-Za-z0-9+/_=-]` of 12 characters or more is a candidate. It is reported as kind
`random` when it has few characters per token, unless it is a known digest (a hexadecimal run of a
digest's length, or `algorithm-base64` as integrity attributes have it) or an identifier (UUID,
hardware address, ISO time, or words and short numbers whose words have many characters per
token). Short runs and runs of letters alone, which words may be, must have fewer. Base spans stay
whatever they look like, and a random span inside a base span is not reported again.

Cases: a null or empty text has no span. Offsets are code points, end exclusive. Ties in start
are ordered assign, access, hex, random. Very long texts and runs are scanned whole, in time in
proportion to their length. Rows are independent, so repeated rows, null ids and other columns,
whatever their names, make no difference; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
LONG = 20
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_IDENTIFIER = re.compile(
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
    r"|(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}"
    r"|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+"
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]{2,6}(?:[+-][0-9]{2,4}|Z)?"
    r"|[0-9+/_=-]+"
)
#: Words and short numbers, joined by marks; one number may follow a word at once.
_WORDED = re.compile(r"(?:[A-Za-z]++[-_/+=]++)*+[A-Za-z]*+[-_/+=]*+(?:[0-9]{1,8}+(?:[-_/+=]++(?:[A-Za-z]++|[0-9]{1,8}+))*+[-_/+=]*+)?")
_WORD = re.compile(r"[A-Za-z]{3,}")
#: Fewer letters in words than these don't tell an identifier from a random string.
LETTERS = 8
#: Characters per token at or under which a candidate is random: a long one with digits; a long one
#: of letters; a short one with digits or of both cases; a short one of letters of one case.
MOST_RATIO, MOST_LETTERS, MOST_SHORT, MOST_WORD = 2.2, 2.0, 1.8, 1.5

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tiktoken encoding of a rank file, read once in a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def is_known(run: str) -> bool:
    """Whether a run is a digest of a common length or an identifier rather than a secret."""
    return (len(run) in DIGEST_LENGTHS and bool(_DIGEST.fullmatch(run))) or bool(_IDENTIFIER.fullmatch(run))


def bound(run: str, most_ratio: float = MOST_RATIO) -> float:
    """Characters per token at or under which a run is random."""
    digits = any(c.isdigit() for c in run)
    if len(run) >= LONG:
        return most_ratio if digits else min(most_ratio, MOST_LETTERS)
    two_cases = run[1:].upper() != run[1:] != run[1:].lower()
    return min(most_ratio, MOST_SHORT if digits or two_cases else MOST_WORD)


def is_random(run: str, efficient, most_ratio: float = MOST_RATIO) -> bool:
    """Whether a vocabulary compresses a run badly, and its words too if it looks like an identifier."""
    most = bound(run, most_ratio)
    if is_known(run) or efficient(run) > most:
        return False
    if not _WORDED.fullmatch(run):
        return True
    found = _WORD.findall(run)
    letters = sum(map(len, found))
    return letters >= LETTERS and letters <= most * sum(len(w) / efficient(w) for w in found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS) or not text.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def random_spans(text: str, efficient, base: list[tuple[int, int, int]], most_ratio: float) -> list[tuple[int, int, int]]:
    """Candidates outside base spans that the vocabulary compresses badly; base is ordered by start."""
    found = []
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        before = bisect_right(starts, a)
        if before and b <= reach[before - 1]:
            continue
        if is_random(m[0], efficient, most_ratio):
            found.append((a, 3, b))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(vocabulary: str, most_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)

        @lru_cache(maxsize=4096)
        def efficient(run: str) -> float:
            return len(run) / len(encoding.encode_ordinary(run))

        for batch in batches:
            rows = []
            for text in batch.column("text"):
                whole = text.as_py() or ""
                base = base_spans(whole)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                spans = sorted(base + random_spans(whole, efficient, base, most_ratio))
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    return run


def scan_secrets(docs: DataFrame, vocabulary: str, most_ratio: float = MOST_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row. No shuffle.

    vocabulary: path of a tiktoken rank file that every executor can open.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(vocabulary, most_ratio), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
