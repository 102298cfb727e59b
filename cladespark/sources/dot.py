"""DOT graphs: node and edge statements, of which identifiers and labels are used."""

from __future__ import annotations

import re

from cladespark.errors import ParseError
from cladespark.operators.topology import IllegalNetwork, Topology

_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|(->|--|[{}\[\];,=])|([A-Za-z0-9_.\x80-\U0010ffff-]+?)(?=->|--|[\s{}\[\];,=]|$)|(\s+|//[^\n]*|#[^\n]*|/\*.*?\*/)', re.S)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"dot: unreadable at character {at}")
        if m[1] is not None:
            out.append(("name", re.sub(r"\\(.)", r"\1", m[1])))
        elif m[2]:
            out.append(("sign", m[2]))
        elif m[3]:
            out.append(("name", m[3]))
        at = m.end()
    return out


def parse_dot(text: str) -> Topology:
    tokens = _tokens(text)
    start = next((i for i, t in enumerate(tokens) if t == ("sign", "{")), None)
    if start is None or not any(t[0] == "name" and t[1].lower() in ("graph", "digraph") for t in tokens[:start]):
        raise ParseError("dot: no graph")
    edges: list[tuple[str, str]] = []
    labels: dict[str, str] = {}
    nodes: dict[str, None] = {}
    i, depth = start, 0
    statement: list[str] = []

    def close() -> None:
        if statement and statement[0].lower() not in ("graph", "node", "edge", "subgraph"):
            nodes.update(dict.fromkeys(statement))
            edges.extend(zip(statement, statement[1:], strict=False))
        statement.clear()

    while i < len(tokens):
        kind, value = tokens[i]
        if kind == "sign" and value in "{}":
            close()
            depth += 1 if value == "{" else -1
            if not depth:
                break
        elif kind == "sign" and value in (";", ","):
            close()
        elif kind == "sign" and value == "[":
            owner = statement[0] if len(statement) == 1 else None
            while tokens[i] != ("sign", "]"):
                if owner and tokens[i][1].lower() == "label" and tokens[i + 1] == ("sign", "="):
                    labels[owner] = tokens[i + 2][1]
                i += 1
                if i >= len(tokens):
                    raise ParseError("dot: attributes are not closed")
            close()
        elif kind == "sign" and value == "=":
            statement.clear()
            i += 1
        elif kind == "name":
            if statement and tokens[i - 1][0] == "name":
                close()
            statement.append(value)
        i += 1
    if depth:
        raise ParseError("dot: a brace is not closed")
    number = {n: k for k, n in enumerate(nodes)}
    linked = {x for e in edges for x in e}
    topology = Topology.of(((number[a], number[b]) for a, b in dict.fromkeys(edges)), {number[n]: labels.get(n, n) for n in nodes}, (number[n] for n in nodes if n not in linked))
    try:
        topology.postorder()
    except IllegalNetwork as e:
        raise ParseError(f"dot: {e}") from None
    return topology
