"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Patterns (assignments, access keys, hex digests) give base spans. The method adds `entropy` spans: a
candidate is a run of one character class (hex digits, or base64 letters); a window slides over it, and
the Shannon entropy of the characters in the window is kept by incremental counts, one character in and
one out. Windows at or over the class's threshold are merged to spans. An allow-list suppresses what is
random by nature but no secret: UUIDs, dashed dates and versions, letters only, digits only, names and paths of
parts that are letters (with a number of up to two digits after them) or short numbers, runs of few distinct
characters, and whatever lies inside a base span. Parts that mix letters and digits are not let pass.

Rows: null and empty texts have no spans; texts of any length are scanned whole, in linear time; repeated
rows are each reported; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import sliced, table

KINDS = ("assign", "access", "hex", "entropy")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 and more among all maximal runs

WINDOW = 20
#: Bits per character from which a window of a class is random: hex has at most 4, base64 at most log2(20) in such a window.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.0), ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7))
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]+"),
    re.compile(r"[0-9]+"),
    re.compile(r"[A-Za-z]+(?:[-_/=+]+[A-Za-z]+)*[-_/=+]*[0-9]{0,4}"),
    re.compile(r"[0-9]{1,4}(?:[-/_][0-9]{1,4})+"),
    re.compile(r"[-_=+/]*(?:(?:[A-Za-z]{1,24}[0-9]{0,2}|[0-9]{1,4})[-_=+/]+)+(?:[A-Za-z]{1,24}[0-9]{0,2}|[0-9]{1,4})?"),
)
_PLOGP = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def entropy_spans(text: str, start: int, end: int, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of text[start:end] whose entropy is at least the threshold; counts change by one character in and out."""
    counts: dict[str, int] = {}
    plogp = _PLOGP if window == WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    total, most, spans = 0.0, window * (math.log2(window) - threshold) + 1e-9, []
    for i in range(start, end):
        n = counts.get(text[i], 0)
        total += plogp[n + 1] - plogp[n] if n < window else 0.0
        counts[text[i]] = n + 1
        if i - start >= window:
            out = text[i - window]
            n = counts[out]
            total -= plogp[n] - plogp[n - 1] if n <= window else 0.0
            counts[out] = n - 1
        if i - start >= window - 1 and total <= most:  # entropy = log2(window) - total / window
            a = i - window + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((a, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; leftmost, not overlapping within a kind, failing matches dropped after the match."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def find_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    base, more, last = base_spans(text), set(), -1
    for _, pattern, threshold in CLASSES:
        for m in pattern.finditer(text):
            if not any(a.fullmatch(text, m.start(), m.end()) for a in ALLOW):
                more.update(entropy_spans(text, m.start(), m.end(), threshold))
    spans = []
    for s, e in sorted(more, key=lambda x: (x[0], -x[1])):  # a span inside another one of the method, or inside a base span, says nothing new
        if e > last and not any(b[0] <= s and e <= b[2] for b in base):
            spans.append((s, 3, e))
            last = e
    return base, sorted(base + spans)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of struct(kind, start, end) in code points."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [find_spans(t) for t in b.column(1).to_pylist()]
            columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[i]] for f in found], pa.list_(span)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))
