"""Newick text helpers, used inside Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[(),]|[^(),;]+")

NODE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("node", T.IntegerType()),
            T.StructField("parent", T.IntegerType()),
            T.StructField("name", T.StringType()),
            T.StructField("branch_length", T.DoubleType()),
            T.StructField("depth", T.DoubleType()),
            T.StructField("level", T.IntegerType()),
            T.StructField("is_leaf", T.BooleanType()),
        ]
    )
)


def node_rows(text: str) -> list[dict]:
    """Nodes of one tree in preorder; the root is node 0 without a parent.

    ``depth`` is the summed branch length from the root and ``level`` the
    number of edges.  Depths are filled in after the labels, which follow the
    children in the text.
    """
    rows = [_node(0, None)]
    open_nodes = [0]
    current = 0
    for token in TOKEN.findall(text.strip()):
        if token == "(":
            rows[current]["is_leaf"] = False
            open_nodes.append(current)
            current = _add_child(rows, current)
        elif token == ",":
            current = _add_child(rows, open_nodes[-1])
        elif token == ")":
            current = open_nodes.pop()
        else:
            name, _, length = token.partition(":")
            rows[current]["name"] = name or None
            rows[current]["branch_length"] = _number(length.split(":")[0])
    for row in rows[1:]:
        above = rows[row["parent"]]
        row["depth"] = above["depth"] + row["branch_length"]
        row["level"] = above["level"] + 1
    return rows


def _node(node: int, parent: int | None) -> dict:
    return {
        "node": node, "parent": parent, "name": None, "branch_length": 0.0,
        "depth": 0.0, "level": 0, "is_leaf": True,
    }


def _add_child(rows: list[dict], parent: int) -> int:
    rows.append(_node(len(rows), parent))
    return len(rows) - 1


def _number(text: str) -> float:
    try:
        return float(text) if text else 0.0
    except ValueError:
        return 0.0


def canonical(topology: str) -> str:
    """The topology with the subtrees of every node in byte order."""
    levels: list[list[str]] = [[]]
    for token in TOKEN.findall(topology.strip()):
        if token == "(":
            levels.append([])
        elif token == ")":
            inner = sorted(levels.pop(), key=lambda part: part.encode())
            levels[-1].append("(" + ",".join(inner) + ")")
        elif token != ",":
            levels[-1].append(token.strip())
    return levels[0][0] if levels[0] else ""


@F.pandas_udf(NODE_TYPE)
def parse_nodes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: node_rows(t) if t is not None else None)


@F.pandas_udf(T.StringType())
def canonical_topology(topologies: pd.Series) -> pd.Series:
    return topologies.map(canonical, na_action="ignore")
