"""Cost matrix files: a line of symbols, then (n + 1) x (n + 1) numbers, the gap last."""

from __future__ import annotations

from cladespark.errors import ParseError
from cladespark.functions.alphabets import Alphabet
from cladespark.operators.tcm import Tcm


def parse_tcm(text: str) -> tuple[Alphabet, Tcm]:
    lines = [line.split() for line in text.splitlines() if line.strip()]
    if len(lines) < 2:
        raise ParseError("tcm: an alphabet and a matrix are expected")
    symbols, rows = lines[0], lines[1:]
    twice = sorted({s for s in symbols if symbols.count(s) > 1})
    if twice:
        raise ParseError(f"tcm: symbols that repeat: {' '.join(twice)}")
    if "-" in symbols:
        raise ParseError("tcm: the gap is implied and not to be listed")
    n = len(symbols) + 1
    values = [x for row in rows for x in row]
    if len(values) != n * n:
        raise ParseError(f"tcm: {n} x {n} values are expected, {len(values)} are there")
    try:
        tcm = Tcm.from_list(values)
    except ValueError as e:
        raise ParseError(f"tcm: {e}") from None
    alphabet = Alphabet.of(symbols, ordered=True)
    order = alphabet.sorted_order()
    return Alphabet(tuple(alphabet.symbols[i] for i in order)), tcm.permuted(order)
