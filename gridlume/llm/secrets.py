"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import LOWER, _edges, slices

#: Kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a longest run of 24 or more
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Bytes of which one is in any keyword match.
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes, from the narrowest, with the entropy in bits a character that a window must exceed; None: never a secret.
CLASSES = (
    (re.compile(r"[0-9]+\Z"), None),
    (re.compile(r"[0-9a-fA-F]+\Z"), 3.0),
    (re.compile(r"[a-z]+\Z|[A-Z]+\Z|[A-Za-z]?[a-z]*\Z"), None),
    (re.compile(r"[A-Za-z0-9]+\Z"), 3.7),
    (re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 3.9),
)
#: Candidates that match one of these as a whole are no secrets.
ALLOWED = (
    r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}",  # UUIDs
    r"([A-Za-z]+[-_/])+[A-Za-z]+[-_/]?",  # words joined by dashes, underlines or slashes
    r"([A-Za-z]+|[0-9]+)([-_/]([A-Za-z]+|[0-9]+))*",  # dated paths, slugs
    r"[-_=+/]+",  # rules
    r".*(?i:example|sample|placeholder|changeme|dummy).*",
)


def _members(pattern: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern)] = True
    return table


_HEX_BYTES = _members(b"0123456789abcdef")
_WORD_BYTES = _members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def _long_runs(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, least: int) -> np.ndarray:
    """Starts of the runs of at least ``least`` members, within rows."""
    starts, ends = _edges(data, offsets, ~members)
    return starts[ends - starts >= least]


def _finds(data: bytes, word: bytes) -> Iterator[int]:
    at = data.find(word)
    while at >= 0:
        yield at
        at = data.find(word, at + 1)


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows can hold a span at all, from the bytes of a slice."""
    raw, low = data.tobytes(), LOWER[data].tobytes()
    places = [_long_runs(data, offsets, _HEX_BYTES, HEX_LEAST), _long_runs(data, offsets, _WORD_BYTES, WINDOW)]
    places += [np.fromiter(_finds(low, w), np.int64) for w in KEYWORDS] + [np.fromiter(_finds(raw, b"AKIA"), np.int64)]
    return np.unique(np.searchsorted(offsets, np.concatenate(places), "right") - 1)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def dense_windows(word: str, window: int, floor: float) -> list[tuple[int, int]]:
    """Unions of the windows whose Shannon entropy is over ``floor`` bits a character, by incremental counts."""
    counts: dict[str, int] = {}
    log = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]  # a count passes the window by one before the oldest goes
    total, most, out = 0.0, window * (math.log2(window) - floor), []
    for k, c in enumerate(word):
        n = counts.get(c, 0)
        total += log[n + 1] - log[n]
        counts[c] = n + 1
        if k >= window:
            gone = word[k - window]
            n = counts[gone]
            total += log[n - 1] - log[n]
            counts[gone] = n - 1
        if k >= window - 1 and total < most:
            start = k - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((start, k + 1))
    return out


def entropy_spans(text: str, allowed: re.Pattern, window: int = WINDOW) -> list[tuple[int, str, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        floor = next(f for kind, f in CLASSES if kind.match(m[0]))
        if floor is not None and not allowed.fullmatch(m[0]):
            found += [(m.start() + a, "entropy", m.start() + b) for a, b in dense_windows(m[0], window, floor)]
    return found


def spans_of(text: str, allowed: re.Pattern) -> list[dict]:
    """All spans by start, then kind; an entropy span within a base span is left out."""
    base = base_spans(text)
    more = [s for s in entropy_spans(text, allowed) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
    ordered = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return [{"kind": kind, "start": a, "end": b} for a, kind, b in ordered]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """All columns and ``spans``, an array of (kind, start, end) in code points, the end exclusive.

    Whole texts are scanned; a null or empty text has no spans. A column named ``spans`` is
    replaced; others, repeated rows and null ids stay as they are.
    """
    docs = docs.drop("spans")
    place, names = docs.columns.index(text_col), [*docs.columns, "spans"]
    rule = "|".join(f"(?:{a})" for a in allowed) or r"(?!)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile(rule)
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, data, offsets in slices(batch.column(place)):
                for k in suspects(data, offsets).tolist():
                    out[row + k] = spans_of(data[offsets[k] : offsets[k + 1]].tobytes().decode(), allow)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _SPANS)], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redacted(text: str, spans: list[dict], mark: str) -> str:
    """The text with each union of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s in spans:
        if s["end"] > at:
            if s["start"] >= at:
                out += [text[at : s["start"]], mark]
            at = s["end"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The same columns with each union of overlapping spans replaced by ``mark``; null stays null, and texts without a span are passed on untouched."""
    place = docs.columns.index(text_col)
    rule = "|".join(f"(?:{a})" for a in allowed) or r"(?!)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile(rule)
        for batch in batches:
            column, texts = batch.column(place), {}
            for row, data, offsets in slices(column):
                for k in suspects(data, offsets).tolist():
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    if spans := spans_of(text, allow):
                        texts[row + k] = redacted(text, spans, mark)
            if texts:
                chosen = np.zeros(batch.num_rows, bool)
                chosen[list(texts)] = True
                column = pc.replace_with_mask(column, pa.array(chosen), pa.array([texts[k] for k in sorted(texts)], column.type))
            yield batch.set_column(place, batch.schema.field(place), column)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def digest(spans: str = "spans") -> dict:
    """Columns that sum up spans: counts, the base spans' SHA-256 and all spans as text."""
    text = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return {f"n_{k}": count(k) for k in KINDS[:3]} | {"base_sha256": F.sha2(text(base), 256), "spans": text(F.col(spans))}
