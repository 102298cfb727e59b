"""Newick, extended Newick (a repeated label or #-tag is one node) and forests in angle brackets."""

from __future__ import annotations

from cladespark.errors import ParseError
from cladespark.operators.topology import IllegalNetwork, Topology

_STOPS = set("()[]{}<>,;:'")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> None:
        while self.at < len(self.text):
            if self.text[self.at].isspace():
                self.at += 1
            elif self.text[self.at] == "[":
                depth = 0
                while self.at < len(self.text):
                    depth += {"[": 1, "]": -1}.get(self.text[self.at], 0)
                    self.at += 1
                    if not depth:
                        break
                else:
                    self.fail("a comment is not closed")
            else:
                return

    def fail(self, why: str):
        raise ParseError(f"newick: {why} at character {self.at}")

    def peek(self) -> str:
        self.skip()
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self, c: str) -> None:
        if self.peek() != c:
            self.fail(f"{c!r} is expected, not {self.peek()!r}")
        self.at += 1

    def label(self) -> str | None:
        if self.peek() == "'":
            self.at += 1
            out = []
            while True:
                end = self.text.find("'", self.at)
                if end < 0:
                    self.fail("a quoted label is not closed")
                out.append(self.text[self.at : end])
                self.at = end + 1
                if self.text[self.at : self.at + 1] != "'":
                    break
                out.append("'")
                self.at += 1
            name = "".join(out).strip()
            if not name:
                self.fail("an empty label")
            return name
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in _STOPS and not self.text[self.at].isspace():
            self.at += 1
        return self.text[start : self.at] or None

    def length(self) -> float | None:
        if self.peek() != ":":
            return None
        self.at += 1
        self.skip()
        start = self.at
        while self.at < len(self.text) and (self.text[self.at].isdigit() or self.text[self.at] in "+-.eE"):
            self.at += 1
        try:
            return float(self.text[start : self.at])
        except ValueError:
            self.fail("a branch length is expected")


def _tree(reader: _Reader) -> Topology:
    edges: list[tuple[int, int, float | None]] = []
    labels: dict[int, str] = {}
    by_label: dict[str, int] = {}
    count = 0
    # An explicit stack, as caterpillar trees nest as deep as they have taxa.
    stack: list[list[tuple[int, float | None]]] = []
    done: tuple[int, float | None] | None = None

    def finish(below: list[tuple[int, float | None]] | None) -> tuple[int, float | None]:
        nonlocal count
        name = reader.label()
        tag = name.rpartition("#")[2] if name and "#" in name else None
        plain = name.partition("#")[0] if tag is not None else name
        key = f"#{tag}" if tag is not None else name
        node = by_label.get(key) if key else None
        if node is None:
            node, count = count, count + 1
            if key:
                by_label[key] = node
        if plain:
            labels[node] = plain
        if not below and not name:
            reader.fail("a leaf without a label")
        edges.extend((node, c, size) for c, size in below or [])
        return node, reader.length()

    while done is None:
        if reader.peek() == "(":
            reader.at += 1
            stack.append([])
            continue
        item = finish(None)
        while True:
            if not stack:
                done = item
                break
            stack[-1].append(item)
            c = reader.peek()
            reader.at += 1
            if c == ",":
                break
            if c != ")":
                reader.at -= 1
                reader.fail("',' or ')' is expected")
            item = finish(stack.pop())
    seen: dict[tuple[int, int], float | None] = {}
    for p, c, size in edges:
        seen.setdefault((p, c), size)
    topology = Topology.of(((p, c, s) for (p, c), s in seen.items()), labels, () if seen else (done[0],))
    try:
        topology.postorder()
    except IllegalNetwork as e:
        raise ParseError(f"newick: {e}") from None
    return topology


def parse_newick(text: str) -> list[Topology]:
    """All trees and networks of a text; a forest's members are each one."""
    reader, out = _Reader(text), []
    while reader.peek():
        if reader.peek() == "<":
            reader.at += 1
            members = []
            while reader.peek() != ">":
                members.append(_tree(reader))
                if reader.peek() == ";":
                    reader.at += 1
            reader.at += 1
            if not members:
                reader.fail("an empty forest")
            out += members
        else:
            out.append(_tree(reader))
            reader.take(";")
    if not out:
        raise ParseError("newick: nothing there")
    return out
