"""Literals that a regular expression cannot match without."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

# Escapes that stand for one class or boundary; any other letter or digit may open a longer form.
PLAIN_ESCAPES = "sSdDwWbBAzZ"


def required_literal(pattern: str) -> str | None:
    """The longest text that every match holds, or None where none is certain.

    Only characters outside groups and classes count, and none that a
    quantifier makes optional.  Alternatives at the top, ``(?`` forms, nested
    classes and longer escapes give None.
    """
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "\\":
            c = pattern[i : i + 1]
            i += 1
            if c == "" or (c.isalnum() and c not in PLAIN_ESCAPES):
                return None
            if not c.isalnum() and not depth:
                run += c
                continue
        elif c == "[":
            end = pattern.find("]", i)
            inside = pattern[i:end]
            if end < 0 or inside in ("", "^") or "[" in inside or "\\" in inside:
                return None
            i = end + 1
        elif c == "(":
            if pattern[i : i + 1] == "?":
                return None
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|":
            if not depth:
                return None
        elif c in "*?{":
            run = run[:-1]
            if c == "{":
                i = pattern.find("}", i) + 1
                if not i:
                    return None
        elif c not in ".^$+" and not depth:
            run += c
            continue
        runs.append(run)
        run = ""
    return max([*runs, run], key=len) or None


def candidates(patterns: list[tuple[int, str]], column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``candidates``: the numbers of the patterns whose literal the text holds, or that have none."""
    literals: dict[str, list[int]] = {}
    always: list[int] = []
    for number, pattern in patterns:
        literal = required_literal(pattern)
        if literal is None:
            always.append(number)
        else:
            literals.setdefault(literal, []).append(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for literal, numbers in literals.items():
            finder.add_word(literal, numbers)
        if literals:
            finder.make_automaton()
        for batch in batches:
            lists = []
            for text in batch.column(column).to_pylist():
                hit = set(always)
                if literals:
                    for _, numbers in finder.iter(text):
                        hit.update(numbers)
                lists.append(sorted(hit))
            named = [*batch.schema.names, "candidates"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=named)

    return run
