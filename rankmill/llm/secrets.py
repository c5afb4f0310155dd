"""Secrets in log lines: fixed patterns, and windows of high Shannon entropy per character class.

Candidates are runs of one class of characters. What the allow-list knows is taken
out of them, part by part: the rest of a run stays a candidate. A window slides over
each, its entropy kept by incremental counts; windows over the class's threshold are
united into spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.words import bounds, code_points, pieces

#: fixed values of the contract
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
DIGITS, UPPER, LOWER = b"0123456789", bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
#: class of characters -> its characters and the bits per character that a window needs
CLASSES = {
    "hex": (DIGITS + b"abcdefABCDEF", 3.2),
    "base64": (DIGITS + UPPER + LOWER + b"+/_=-", 3.8),
}
#: what looks random and is no secret; a match takes out the parts of the run that it touches
ALLOWED = (
    rb"(?i)example|sample|dummy|placeholder|xxxx|0123456789|123456789|abcdefgh|qwerty",
    rb"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",  # UUID
    rb"^[0-9TZ_:+-]+$",  # times and numbers
    # checksums that say so, no longer than they are
    rb"(?i)^md5[-_=]([0-9a-f]{32}|[0-9a-z+/_-]{1,22}={0,2})",
    rb"(?i)^sha1[-_=]([0-9a-f]{40}|[0-9a-z+/_-]{1,27}=?)",
    rb"(?i)^sha256[-_=]([0-9a-f]{64}|[0-9a-z+/_-]{1,43}=?)",
    rb"(?i)^sha384[-_=]([0-9a-f]{96}|[0-9a-z+/_-]{1,64})",
    rb"(?i)^sha512[-_=]([0-9a-f]{128}|[0-9a-z+/_-]{1,86}={0,2})",
)
SEPARATORS = b"-_=/+"
#: a part of a path: words and numbers, which random characters don't form
NAME = rb"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[0-9]*|[A-Z]+[0-9]*|[0-9]+"
PLAIN = re.compile(rb"(?:(?:%s)?[-_=+])*(?:%s)?" % (NAME, NAME))
PATH_SLASHES, LEAST_NAME = 3, 4


def _table(values: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


HEX = _table(DIGITS + b"abcdef")
CAPITAL = _table(DIGITS + UPPER)
CLASS_TABLES = {name: _table(values) for name, (values, _) in CLASSES.items()}


def high_windows(text: bytes, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """United windows of `text` whose entropy reaches the threshold and that mix letters with digits.

    sum(c * log2 c) over the counts changes by one term for the character that
    leaves and one for the character that enters.
    """
    share = [0.0] + [c * log2(c) for c in range(1, window + 2)]
    counts, total, digits, spans = [0] * 256, 0.0, 0, []
    for i, char in enumerate(text):
        total += share[counts[char] + 1] - share[counts[char]]
        counts[char] += 1
        digits += 0x30 <= char <= 0x39
        if i >= window:
            gone = text[i - window]
            total += share[counts[gone] - 1] - share[counts[gone]]
            counts[gone] -= 1
            digits -= 0x30 <= gone <= 0x39
        if i >= window - 1 and 2 <= digits < window and log2(window) - total / window >= threshold - 1e-9:
            start = i + 1 - window
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def path_ends(run: bytes) -> tuple[int, int]:
    """What is left of a run with several slashes without the names of a path on both sides; nothing of a plain path.

    Shorter names than LEAST_NAME are only left out with the whole path, as random runs have some.
    """
    if run.count(b"/") < PATH_SLASHES:
        return 0, len(run)
    parts = run.split(b"/")
    plain = [PLAIN.fullmatch(p) is not None for p in parts]
    if all(plain):
        return 0, 0
    named = [ok and (not p or len(p) >= LEAST_NAME) for p, ok in zip(parts, plain)]
    first, last = named.index(False), len(named) - named[::-1].index(False)
    start = sum(len(p) + 1 for p in parts[:first])
    return start, len(run) - sum(len(p) + 1 for p in parts[last:])


def candidate_parts(run: bytes, allowed: list[re.Pattern]) -> Iterator[tuple[int, int]]:
    """The pieces of a run that neither a path nor the allow-list takes out."""
    low, high = path_ends(run)
    known = []
    for pattern in allowed:
        a = b = 0
        for m in pattern.finditer(run):
            if a <= m.start() and m.end() <= b:
                continue  # in the part that the one before has taken out
            a, b = m.span()
            while a > 0 and run[a - 1] not in SEPARATORS:
                a -= 1
            while b < len(run) and run[b] not in SEPARATORS:
                b += 1
            known.append((a, b))
    for a, b in sorted(known):
        if low < min(a, high):
            yield low, min(a, high)
        low = max(low, b)
    if low < high:
        yield low, high


class _Covered:
    """Spans, sorted once: whether one of them holds another span is a look-up."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.furthest = list(accumulate((e for _, _, e in spans), max))

    def hold(self, start: int, end: int) -> bool:
        n = bisect_right(self.starts, start)
        return n > 0 and self.furthest[n - 1] >= end


class Scanner:
    def __init__(self, allowed: tuple[bytes, ...] = ALLOWED, classes: dict[str, tuple[bytes, float]] = CLASSES):
        self.allowed = [re.compile(p) for p in allowed]
        self.classes = classes

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, kind, end) in code points, sorted; the kind by its number in KINDS."""
        raw, n = data.tobytes(), len(offsets) - 1
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

        def runs(table: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
            starts, ends, _ = bounds(data, offsets, table)
            long = ends - starts >= least
            texts = np.searchsorted(offsets, starts[long], side="right") - 1
            return zip(starts[long].tolist(), ends[long].tolist(), texts.tolist())

        marks = np.concatenate([[0], np.cumsum((data == 0x3A) | (data == 0x3D))])[offsets]
        for text in np.flatnonzero(np.diff(marks)).tolist():  # the pattern needs one of : =
            at = int(offsets[text])
            for m in ASSIGN.finditer(raw, at, int(offsets[text + 1])):
                if m.end(2) - m.start(2) >= ASSIGN_CHARS:
                    found[text].append((m.start(), 0, m.end()))
        for a, b, text in runs(CAPITAL, ACCESS_CHARS):
            start = raw.find(b"AKIA", a, b)
            if start >= 0 and b - start >= ACCESS_CHARS:
                found[text].append((start, 1, b))
        for a, b, text in runs(HEX, HEX_CHARS):
            found[text].append((a, 2, b))
        fixed = [_Covered(x) for x in found]
        for name, (_, threshold) in self.classes.items():
            for a, b, text in runs(CLASS_TABLES[name], WINDOW):
                run = raw[a:b]
                if run.isalpha():
                    continue
                for low, high in candidate_parts(run, self.allowed):
                    for x, y in high_windows(run[low:high], threshold) if high - low >= WINDOW else ():
                        x, y = a + low + x, a + low + y
                        if not fixed[text].hold(x, y):
                            found[text].append((x, 3, y))
        points = code_points(data)
        for text, spans in enumerate(found):
            zero = points[offsets[text]]
            found[text] = sorted({(int(points[s] - zero), k, int(points[e] - zero)) for s, k, e in spans})
        return found


def secret_spans(lines: DataFrame) -> DataFrame:
    """Finds secrets in log lines.

    lines: `line_no` (integer), `line`; other columns are not read. Returns per
    row line_no and spans: kind, start, end (code points, end exclusive), sorted
    by start, then kind as listed in KINDS. `assign`, `access` and `hex` are the
    fixed patterns; `entropy` are windows beyond them, those inside a span of a
    fixed pattern left out. Null and empty lines have no spans, repeated rows
    stay, an empty table gives an empty result. Row by row: nothing is shuffled,
    memory is bounded by the longest line.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("line_no", pa.int64()), ("spans", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1)):
                spans = [
                    [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found] for found in scanner.scan(data, offsets)
                ]
                columns = [batch.column(0).slice(first, len(spans)), pa.array(spans, type=kind)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = lines.select(F.col("line_no").cast("long").alias("line_no"), F.col("line").cast("string").alias("line"))
    return rows.mapInArrow(run, "line_no long, spans array<struct<kind: string, start: long, end: long>>")


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
