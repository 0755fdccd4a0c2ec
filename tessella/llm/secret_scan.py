"""Secret scans by multipart credential linking.

Strong findings stand alone: assignments to a secret-like name, access keys,
long hexadecimal runs.  Weak candidates (identifiers, opaque values, endpoints)
are intervals of the text, joined in order of place: a weak candidate is reported
only if a complementary part stands in its scope, an identifier, endpoint or
access key beside an opaque value, an opaque value, assignment or hexadecimal run
beside an identifier or endpoint.  The scope of a candidate goes `scope_chars` to both sides,
over its own line and the lines right before and after it; so an empty line ends it.

Spans are in code points, the end exclusive.  Null text counts as empty: no
spans, the digest of nothing.  Repeated rows each get their own answer; spans
with one start keep the order of the kinds; an empty table gives no rows; a very
long text is searched whole, in memory in proportion to itself; of other columns
nothing is read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import _common as C

# The base kinds, in their order, then the method's own.
KINDS = ("assign", "access", "hex", "ident", "value", "endpoint")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_IDENT = re.compile(r"""(?:client_id|user(?:name)?|login|account|access_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"(?:https?|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@/-]{4,}", re.ASCII)
_VALUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Places (start, end, kind) of the base kinds, each leftmost and not overlapping its own kind."""
    out: list[tuple[int, int, str]] = []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if any(x in low for x in _NAMES):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


def _opaque(value: str) -> bool:
    """Mixed enough to be a key and not a word, number or path."""
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value) and len(set(value)) >= 10


def weak_candidates(text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(1), "ident") for m in _IDENT.finditer(text)]
        out += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)] if "://" in text else []
    if out or any(kind == "access" for _, _, kind in strong):  # an opaque value alone is never reported
        out += [(*m.span(), "value") for m in _VALUE.finditer(text) if _opaque(m[0])]
    return out


#: Which kinds make a weak candidate of each kind reportable.
PARTNERS = {"value": ("ident", "endpoint", "access"), "ident": ("value", "assign", "hex"), "endpoint": ("value", "assign", "hex")}


def linked(text: str, strong: list[tuple[int, int, str]], scope_chars: int = 2000) -> list[tuple[int, int, str]]:
    """The weak candidates that have a complementary part in their scope."""
    weak = sorted(weak_candidates(text, strong))
    if not weak:
        return []
    ends = [m.start() for m in re.finditer("\n", text)]
    held: dict[str, list[tuple[int, int]]] = {}
    for start, end, kind in sorted([*weak, *strong]):
        held.setdefault(kind, []).append((start, end))

    def near(a: tuple[int, int], b: tuple[int, int]) -> bool:
        a, b = sorted((a, b))
        return b[0] - a[1] <= scope_chars and bisect_right(ends, b[0]) - bisect_right(ends, a[0]) <= 1

    def has_partner(span: tuple[int, int], kind: str) -> bool:
        for other in PARTNERS[kind]:
            # spans of one kind do not overlap: the neighbours on both sides are the nearest
            parts = held.get(other, [])
            i = bisect_right(parts, span)
            if any(near(span, p) for p in parts[max(0, i - 1) : i + 1]):
                return True
        return False

    taken = sorted((s, e) for s, e, _ in strong)
    out = []
    for start, end, kind in weak:
        i = bisect_right(taken, (end, -1))
        if has_partner((start, end), kind) and not (kind == "value" and i and taken[i - 1][1] > start):
            out.append((start, end, kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    out, at, last = [], 0, -1
    for start, end, _ in sorted(spans):
        if start >= last:
            out += [text[at:start], mark]
        last = max(last, end)
        at = last
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, scope_chars: int = 2000) -> DataFrame:
    """docs: doc_id, text.  A row for each: counts, base spans, all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), C.column_texts(b, "text")):
                base = base_spans(text)
                kinds = [k for _, _, k in base]
                rows.append((doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), joined(base), joined(base + linked(text, base, scope_chars))))
            names = [c.split()[0] for c in schema.split(", ")]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, scope_chars: int = 2000) -> DataFrame:
    """The documents with every reported span replaced; n_chars follows the new text."""
    clean = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else redacted(t, (b := base_spans(t)) + linked(t, b, scope_chars))), "string")
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(C.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
