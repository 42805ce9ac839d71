"""Secret scanning with weak candidates that count only beside their complement."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from locusframe.llm.common import slices

# The base grammar, and the least length of each match.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
PLACE = {k: i for i, k in enumerate(KINDS)}

# The weak candidates.
WEAK_ID = re.compile(r"""\b(?:(?i:client_?id|access_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})|((?:ASIA|AIDA|AROA)[A-Z0-9]{12,}))""", re.ASCII)
WEAK_ID_HINTS = ("client", "access", "account", "user", "login", "ASIA", "AIDA", "AROA")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/=_-])", re.ASCII)
ENDPOINT = re.compile(r"""\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", re.ASCII)


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _strong_mix(value: str) -> bool:
    """A random-looking value: upper case, lower case and digits, over 3.5 bits a character."""
    return any(map(str.isdigit, value)) and any(map(str.islower, value)) and any(map(str.isupper, value)) and _entropy(value) > 3.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind as (start, end, kind)."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak identifiers, secrets and endpoints that no base span overlaps."""
    parts = []
    low = text.lower()
    if any(w in low or w in text for w in WEAK_ID_HINTS):
        for m in WEAK_ID.finditer(text):
            parts.append((*m.span(1 if m[1] else 2), "linked_id"))
    if "://" in text:
        parts += [(*m.span(), "linked_endpoint") for m in ENDPOINT.finditer(text)]
    ends = [(s, e) for s, e, _ in parts]
    for m in WEAK_SECRET.finditer(text):
        if _strong_mix(m[0]) and not any(s < m.end() and m.start() < e for s, e in ends):
            parts.append((*m.span(), "linked_secret"))
    if not base or not parts:
        return parts
    taken = sorted((s, e) for s, e, _ in base)
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate(np.array([e for _, e in taken]))
    kept = []
    for s, e, kind in parts:
        at = int(np.searchsorted(starts, e, "left")) - 1
        if at < 0 or reach[at] <= s:
            kept.append((s, e, kind))
    return kept


#: A blank line; the line break that ends it may begin the next one.
BLANK = re.compile(r"\n[\x20\t\x0B-\x0D]*(?=\n)")


def _scopes(text: str, parts: np.ndarray, scope: int) -> np.ndarray:
    """The paragraph of each (start, end), between blank lines, widened by ``scope`` on both sides."""
    blank = np.array([m.span() for m in BLANK.finditer(text)], dtype=np.int64).reshape(-1, 2)
    first = np.concatenate([[0], blank[:, 1] + 1])
    last = np.concatenate([blank[:, 0], [len(text)]])
    starts = first[np.searchsorted(blank[:, 1], parts[:, 0], "right")]
    ends = last[np.searchsorted(blank[:, 0], parts[:, 1], "left")]
    return np.stack([starts - scope, ends + scope], axis=1)


def _touches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each interval of ``a``, whether an interval of ``b`` meets it.

    Sorted starts and running furthest ends answer each row by one binary
    search, so a text with very many parts costs no pairs.
    """
    if not len(a) or not len(b):
        return np.zeros(len(a), dtype=bool)
    b = b[np.argsort(b[:, 0], kind="stable")]
    reach = np.maximum.accumulate(b[:, 1])
    at = np.searchsorted(b[:, 0], a[:, 1], "right") - 1
    return (at >= 0) & (reach[np.maximum(at, 0)] >= a[:, 0])


def linked(text: str, base: list[tuple[int, int, str]], scope: int) -> list[tuple[int, int, str]]:
    """Weak parts that share a scope with their complement.

    The scope of a part is its paragraph (between blank lines, the whole text
    where there are none) widened by ``scope`` characters on both sides; two
    parts share one if either lies, wholly or partly, in that of the other. An
    identifier needs a secret; a secret needs an identifier or an endpoint; an
    endpoint needs a secret. Base spans complete weak parts: ``access`` is an
    identifier, ``assign`` and ``hex`` are secrets.
    """
    weak = weak_parts(text, base)
    if not weak:
        return []
    role = {"access": "id", "assign": "secret", "hex": "secret", "linked_id": "id", "linked_secret": "secret", "linked_endpoint": "endpoint"}
    of = {r: np.array([(s, e) for s, e, k in (*base, *weak) if role[k] == r], dtype=np.int64).reshape(-1, 2) for r in ("id", "secret", "endpoint")}
    scopes = {r: _scopes(text, x, scope) for r, x in of.items()}
    out = []
    for kind, complements in (("linked_id", ("secret",)), ("linked_secret", ("id", "endpoint")), ("linked_endpoint", ("secret",))):
        own = [p for p in weak if p[2] == kind]
        a = np.array([(s, e) for s, e, _ in own], dtype=np.int64).reshape(-1, 2)
        around, hit = _scopes(text, a, scope), np.zeros(len(own), dtype=bool)
        for c in complements:
            hit |= _touches(around, of[c]) | _touches(a, scopes[c])
        out += [p for p, yes in zip(own, hit, strict=True) if yes]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], PLACE[x[2]], x[1])))


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """``docs`` with ``secret_spans``, an array of (kind, start, end), in code points, end exclusive.

    Base kinds are always reported; weak kinds only where complementary parts
    share a paragraph widened by ``scope`` characters (see ``linked``). Texts are
    scanned whole, with no shuffle; parts of one text are joined by interval
    with sorted search.

    Null and empty texts have no spans. Repeated rows are scanned one by one; an
    empty table gives no rows; a column named ``secret_spans`` is replaced.
    """
    docs = docs.drop("secret_spans")
    names = docs.columns
    schema = StructType(docs.schema.fields + StructType.fromDDL("secret_spans array<struct<kind:string,start:bigint,end:bigint>>").fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 512):
                found = []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    spans = base + linked(text, base, scope)
                    spans.sort(key=lambda x: (x[0], PLACE[x[2]], x[1]))
                    found.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(found, kind)], names=[*names, "secret_spans"])

    return docs.mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, scope: int = 200, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each reported secret replaced by ``mark``; all columns and rows stay.

    Endpoints stay as they are; overlapping spans become one mark. ``n_chars``,
    where present, is set to the new length. Texts without secrets are unchanged.
    """
    names = docs.columns

    def mask(batches):
        for batch in batches:
            for part in slices(batch, 512):
                texts = []
                for text in part.column("text").to_pylist():
                    if text:
                        base = base_spans(text)
                        spans = sorted(x[:2] for x in (*base, *linked(text, base, scope)) if x[2] != "linked_endpoint")
                        if spans:
                            out, at = [], 0
                            for s, e in spans:
                                if s >= at:
                                    out += [text[at:s], mark]
                                at = max(at, e)
                            text = "".join(out) + text[at:]
                    texts.append(text)
                arrays = dict(zip(names, part.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
                if "n_chars" in arrays and pa.types.is_integer(arrays["n_chars"].type):
                    arrays["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, arrays["n_chars"].to_pylist(), strict=True)], arrays["n_chars"].type)
                yield pa.RecordBatch.from_arrays([arrays[c] for c in names], names=names)

    return docs.mapInArrow(mask, docs.schema)


def secret_digest(docs: DataFrame, scope: int = 200) -> DataFrame:
    """The contract's columns per document, taken from the spans of ``scan_secrets``."""
    found = scan_secrets(docs.select("doc_id", "text"), scope).select("doc_id", "secret_spans")

    def digest(batches):
        for batch in batches:
            ids, n, sha, spans = [], {"assign": [], "access": [], "hex": []}, [], []
            for rows in batch.column("secret_spans").to_pylist():
                got = [(r["start"], r["end"], r["kind"]) for r in rows]
                base = [x for x in got if x[2] in n]
                for k, v in n.items():
                    v.append(sum(x[2] == k for x in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(got))
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(v, pa.int64()) for v in n.values()), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return found.mapInArrow(digest, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
