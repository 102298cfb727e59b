"""Vertex-edge-root files: a set of vertices, one of edges with optional lengths, and one of roots."""

from __future__ import annotations

import re

from cladespark.errors import ParseError
from cladespark.operators.topology import IllegalNetwork, Topology

_SET = re.compile(r"(?:(\w+)\s*=\s*)?\{([^{}]*)\}")
_EDGE = re.compile(r"\(\s*([^,()\s]+)\s*,\s*([^,()\s]+)\s*\)\s*(?::\s*([0-9.eE+-]+))?")


def parse_ver(text: str) -> Topology:
    """Sets may be labelled V(ertexSet), E(dgeSet), R(ootSet); unlabelled ones of vertices come before that of roots."""
    sets: dict[str, str] = {}
    for name, body in _SET.findall(text):
        kind = {"v": "vertices", "e": "edges", "r": "roots"}.get(name[:1].lower()) if name else ("edges" if "(" in body else "vertices" if "vertices" not in sets else "roots")
        if kind is None:
            raise ParseError(f"ver: a set named {name}")
        if kind in sets:
            raise ParseError(f"ver: two sets of {kind}")
        sets[kind] = body
    if set(sets) != {"vertices", "edges", "roots"}:
        raise ParseError("ver: sets of vertices, edges and roots are expected")
    names = lambda body: [x.strip() for x in body.split(",") if x.strip()]
    edges = [(a, b, float(x) if x else None) for a, b, x in _EDGE.findall(sets["edges"])]
    vertices, roots = names(sets["vertices"]), names(sets["roots"])
    if not {x for e in edges for x in e[:2]} & set(roots) <= set(vertices) and not set(roots) <= set(vertices):
        vertices, roots = roots, vertices
    # Unlabelled sets: the smaller one that lies in the other is that of the roots.
    if not set(roots) <= set(vertices) and set(vertices) <= set(roots):
        vertices, roots = roots, vertices
    known = set(vertices)
    if len(known) < len(vertices):
        raise ParseError("ver: a vertex that repeats")
    strange = {x for e in edges for x in e[:2]} - known
    if strange or not set(roots) <= known:
        raise ParseError(f"ver: not among the vertices: {', '.join(sorted(strange | (set(roots) - known)))}")
    below = {c for _, c, _ in edges}
    if bad := sorted(set(roots) & below):
        raise ParseError(f"ver: roots with edges into them: {', '.join(bad)}")
    if any(a == b for a, b, _ in edges) or len({e[:2] for e in edges}) < len(edges):
        raise ParseError("ver: an edge to itself or one that repeats")
    number = {v: i for i, v in enumerate(vertices)}
    linked = {x for e in edges for x in e[:2]}
    topology = Topology.of(((number[a], number[b], x) for a, b, x in edges), {i: v for v, i in number.items()}, (number[v] for v in vertices if v not in linked))
    try:
        topology.postorder()
    except IllegalNetwork as e:
        raise ParseError(f"ver: {e}") from None
    return topology
