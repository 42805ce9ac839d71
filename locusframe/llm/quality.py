"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from locusframe.llm.common import WORDS, slices

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Document:
    """One text with its features, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._known: dict[str, object] = {}

    def __getattr__(self, name: str):
        made = FEATURES.get(name)
        if made is None or "_known" not in self.__dict__:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = made(self)
        return self._known[name]


def _repeat_words(doc: Document) -> int:
    """Words that lie in a window of eight words which the text holds twice or more."""
    words = doc.words
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    if len(number) > n - (WINDOW - 1):
        return 0
    size = 1
    while size < WINDOW:  # ranks of 2, 4, then 8 words: equal ranks are equal words, with no hashing
        pair = ids[:-size] * np.int64(n + 1) + ids[size:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    change = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change)[:n] > 0).sum())


def _dup_lines(doc: Document) -> int:
    seen: set[str] = set()
    count = 0
    for line in doc.text.split("\n"):
        if WORDS.search(line):
            count += line in seen
            seen.add(line)
    return count


FEATURES: dict[str, Callable[[Document], object]] = {
    "words": lambda d: WORDS.findall(d.text),
    "n_words": lambda d: len(d.words),
    "word_chars": lambda d: sum(map(len, d.words)),
    "n_symbols": lambda d: sum(map(d.text.count, SYMBOLS)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": lambda d: sum(1 for x in d.text.split("\n") if WORDS.search(x)),
    "n_digits": lambda d: sum(map(d.text.count, "0123456789")),
    "n_upper": lambda d: sum(map(str.isupper, d.text)),
}


@dataclass(frozen=True)
class Rule:
    """A named rule; ``rejects`` is pure, so the order of rules cannot change a verdict."""

    name: str
    rejects: Callable[[Document], bool]


#: Integer arithmetic throughout, so that SQL gives the same verdicts.
BASE_RULES = (
    Rule("few_words", lambda d: d.n_words < 20),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 30 * d.n_words),
)
METHOD_RULES = (
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("symbols", lambda d: 5 * d.n_symbols > d.n_words),
    Rule("repeated_lines", lambda d: 5 * d.n_dup_lines > 3 * max(1, d.n_lines)),
    Rule("digits", lambda d: 2 * d.n_digits > d.word_chars),
    Rule("capitals", lambda d: 2 * d.n_upper > d.word_chars),
)
PRODUCTION_RULES = BASE_RULES + METHOD_RULES


def cascade_order(docs: DataFrame, rules: Iterable[Rule], sample_rows: int = 2000, seed: int = 7) -> list[dict]:
    """Rules with cost and selectivity measured on a sample, best rejection per cost first.

    The sample has about ``sample_rows`` rows, twice as many at most; it steers
    only the order, never a verdict. Each rule is timed on a fresh document, so
    its cost holds the features that it needs.
    """
    rules = list(rules)
    share = min(1.0, sample_rows / max(1, docs.count()))
    texts = [r[0] for r in docs.select("text").sample(share, seed).limit(2 * sample_rows).collect()]
    found = []
    for place, rule in enumerate(rules):
        began = time.perf_counter()
        rejected = sum(rule.rejects(Document(t)) for t in texts)
        cost = (time.perf_counter() - began) / max(1, len(texts))
        share = rejected / max(1, len(texts))
        found.append({"rule": rule, "place": place, "cost": cost, "selectivity": share, "rank": share / max(cost, 1e-9)})
    return sorted(found, key=lambda x: (-x["rank"], x["cost"], x["place"]))


def quality_cascade(
    docs: DataFrame,
    rules: Iterable[Rule] = PRODUCTION_RULES,
    features: bool = False,
    sample_rows: int = 2000,
) -> DataFrame:
    """``docs`` with ``base_failed``, ``kept`` and ``rejected_by``, and the base features if asked for.

    A document meets the rules in the measured order and stops at the first that
    rejects it; ``rejected_by`` names that rule. With ``features`` the base
    counts are filled for every row, rejected or not.

    Null and empty texts have no words and fail ``few_words``. Ties and repeated
    rows are judged one by one; an empty table gives no rows; columns of ``docs``
    with the names of the new ones are replaced.
    """
    rules = tuple(rules)
    ordered = tuple(x["rule"] for x in cascade_order(docs, rules, sample_rows))
    new = ["base_failed", "kept", "rejected_by", *(BASE_COUNTS if features else ())]
    docs = docs.drop(*new)
    types = {"base_failed": "boolean", "kept": "boolean", "rejected_by": "string"}
    schema = StructType(docs.schema.fields + StructType.fromDDL(", ".join(f"{c} {types.get(c, 'bigint')}" for c in new)).fields)
    names = docs.columns

    def judge(batches):
        for batch in batches:
            for part in slices(batch, 512):
                base, kept, why = [], [], []
                counts: dict[str, list[int]] = {f: [] for f in new[3:]}
                for text in part.column("text").to_pylist():
                    doc = Document(text)
                    failed = next((r.name for r in ordered if r.rejects(doc)), None)
                    base.append(any(r.rejects(doc) for r in BASE_RULES))
                    kept.append(failed is None and not base[-1])
                    why.append(failed)
                    for f, values in counts.items():
                        values.append(getattr(doc, f))
                arrays = [part.column(c) for c in names] + [pa.array(base, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(why, pa.string())]
                arrays += [pa.array(v, pa.int64()) for v in counts.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=names + new)

    return docs.mapInArrow(judge, schema)
