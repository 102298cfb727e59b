"""Nexus files: TAXA, CHARACTERS / DATA / UNALIGNED, TREES and ASSUMPTIONS blocks; others are skipped."""

from __future__ import annotations

import re

from cladespark.errors import ParseError
from cladespark.functions import alphabets
from cladespark.functions.alphabets import Alphabet
from cladespark.operators.tcm import Tcm
from cladespark.operators.topology import Topology
from cladespark.sources.newick import parse_newick
from cladespark.sources.normalized import Character, Source

# Symbols of each data type.
SYMBOLS = {"standard": "01", "dna": "ACGT", "nucleotide": "ACGT", "rna": "ACGU", "protein": "ACDEFGHIKLMNPQRSTVWY"}


def _blocks(text: str) -> list[tuple[str, list[str]]]:
    text = re.sub(r"\[[^\[\]]*\]", " ", text)
    out = []
    for m in re.finditer(r"begin\s+(\w+)\s*;(.*?)\bend(?:block)?\s*;", text, re.S | re.I):
        out.append((m[1].lower(), [c.strip() for c in m[2].split(";") if c.strip()]))
    return out


def _options(command: str) -> dict[str, str]:
    """name=value pairs; a name alone is 'yes'. Values may be quoted."""
    found = re.findall(r"([A-Za-z]\w*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|\S+))?", command)
    return {k.lower(): (v.strip("\"'") if v else "yes") for k, v in found[1:]}


def _words(text: str) -> list[str]:
    return [a or b for a, b in re.findall(r"'([^']*)'|(\S+)", text)]


def _yes(options: dict[str, str], name: str) -> bool:
    return options.get(name, "no").lower() == "yes"


class _Format:
    def __init__(self, options: dict[str, str]):
        self.kind = options.get("datatype", "standard").lower()
        if self.kind == "continuous":
            raise ParseError("nexus: continuous data are not supported")
        if self.kind not in SYMBOLS:
            raise ParseError(f"nexus: unknown data type {self.kind}")
        extra = options.get("symbols", "").replace(" ", "")
        self.case = _yes(options, "respectcase")
        self.symbols = "".join(dict.fromkeys(extra if self.kind == "standard" and extra else SYMBOLS[self.kind] + extra))
        self.missing, self.gap = options.get("missing", "?"), options.get("gap", "-")
        self.match = options.get("matchchar")
        self.tokens, self.transpose = _yes(options, "tokens"), _yes(options, "transpose")
        self.interleave, self.labels = _yes(options, "interleave"), options.get("nolabels", "no").lower() != "yes"
        self.equate = dict(re.findall(r"(\S)\s*=\s*(\([^()]*\)|\{[^{}]*\}|\S)", options.get("equate", "")))
        if bad := [k for k in self.equate if k in (self.missing, self.gap, self.match) or k in self.symbols]:
            raise ParseError(f"nexus: equated symbols are in use: {' '.join(bad)}")
        self.codes = alphabets.iupac({"protein": "amino_acid", "rna": "rna"}.get(self.kind, "dna")) if self.kind != "standard" else {}

    def cells(self, text: str) -> list[str]:
        pattern = r"\([^()]*\)|\{[^{}]*\}|" + (r"[^\s(){}]+" if self.tokens else r"[^\s(){}]")
        return re.findall(pattern, text)

    def symbols_of(self, cell: str, above: str | None, depth: int = 0) -> tuple[str, ...] | None:
        if depth > 8:
            raise ParseError("nexus: equated symbols go in a circle")
        if self.match and cell == self.match:
            if above is None:
                raise ParseError("nexus: a matching symbol in the first row")
            return self.symbols_of(above, None, depth + 1)
        if cell[0] in "({":
            parts = [self.symbols_of(c, above, depth + 1) for c in self.cells(cell[1:-1])]
            return None if None in parts else tuple(dict.fromkeys(s for p in parts for s in p))
        if cell == self.missing:
            return None
        if cell == self.gap:
            return (alphabets.GAP,)
        if cell in self.equate:
            return self.symbols_of(self.equate[cell], above, depth + 1)
        if self.codes:
            code = self.codes.get(cell.upper() if not self.case else cell)
            if code is None:
                raise ParseError(f"nexus: {cell} is not in the {self.kind} alphabet")
            return code
        for s in (cell, cell if self.case else cell.upper(), cell if self.case else cell.lower()):
            if self.tokens or s in self.symbols:
                return (s,)
        raise ParseError(f"nexus: {cell} is not among the symbols {self.symbols}")


def _matrix(body: str, form: _Format, taxa: list[str], n_chars: int | None, aligned: bool) -> dict[str, list[str]]:
    lines = [line for line in body.split("\n") if line.strip()]
    rows: dict[str, list[str]] = {}
    if not form.labels:
        cells = [form.cells(line) for line in lines]
        if not taxa:
            raise ParseError("nexus: no labels and no taxa block")
        for k, c in enumerate(cells):
            rows.setdefault(taxa[k % len(taxa) if form.interleave else min(k, len(taxa) - 1)], []).extend(c)
        return rows
    if form.interleave or not aligned or len(lines) >= len(taxa):
        last = None
        for line in lines:
            m = re.match(r"\s*(?:'([^']*)'|(\S+))\s*(.*)", line, re.S)
            name, rest = m[1] or m[2], m[3]
            known = taxa and name not in taxa and name not in rows
            if known and last is not None and aligned and n_chars and len(rows[last]) < n_chars:
                rows[last] += form.cells(line)
                continue
            last = name
            rows.setdefault(name, []).extend(form.cells(rest))
        return rows
    raise ParseError("nexus: fewer rows than taxa")


def _set(text: str, n: int) -> list[int]:
    """Character numbers (from 0) of a set such as 1 3-5 7-. or all."""
    out: list[int] = []
    for word in re.findall(r"\d+\s*-\s*(?:\d+|\.)(?:\s*\\\s*\d+)?|\d+|all", text, re.I):
        if word.lower() == "all":
            out += range(n)
        elif "-" in word:
            m = re.match(r"(\d+)\s*-\s*(\d+|\.)(?:\s*\\\s*(\d+))?", word)
            out += range(int(m[1]) - 1, n if m[2] == "." else int(m[2]), int(m[3] or 1))
        else:
            out.append(int(word) - 1)
    if any(not 0 <= i < n for i in out):
        raise ParseError(f"nexus: characters out of range in {text}")
    return out


def parse_nexus(text: str, path: str = "") -> Source:
    if not text.lstrip().lower().startswith("#nexus"):
        raise ParseError("nexus: #NEXUS is expected first")
    source, translated = Source(path), {}
    n_taxa = None
    assumptions: list[str] = []
    for name, commands in _blocks(text):
        head = {c.split(None, 1)[0].lower(): c for c in commands}
        if name == "taxa":
            n_taxa = int(_options(head.get("dimensions", "dimensions")).get("ntax", 0)) or None
            source.taxa += _words(head["taxlabels"].split(None, 1)[1]) if "taxlabels" in head else []
            if n_taxa and len(source.taxa) != n_taxa:
                raise ParseError(f"nexus: {n_taxa} taxa are expected, {len(source.taxa)} are there")
            if len(set(source.taxa)) < len(source.taxa):
                raise ParseError("nexus: a taxon that repeats")
        elif name in ("characters", "data", "unaligned"):
            _characters(name, head, source)
        elif name == "trees":
            for c in commands:
                word = c.split(None, 1)
                if word[0].lower() == "translate":
                    for pair in word[1].split(","):
                        key, value = _words(pair)
                        translated[key] = value
                elif word[0].lower() in ("tree", "utree"):
                    for t in parse_newick(c.partition("=")[2].strip() + ";"):
                        source.forests.append(Topology(t.children, {n: translated.get(x, x) for n, x in t.labels.items()}, t.lengths, t.lone))
        elif name in ("assumptions", "sets"):
            assumptions += commands
    _assume(assumptions, source)
    if not source.characters and not source.forests:
        raise ParseError("nexus: neither characters nor trees")
    return source


def _characters(name: str, head: dict[str, str], source: Source) -> None:
    form = _Format(_options(head.get("format", "format")))
    dims = _options(head.get("dimensions", "dimensions"))
    n_chars = int(dims.get("nchar", 0)) or None
    if "matrix" not in head:
        raise ParseError(f"nexus: {name} has no matrix")
    aligned = name != "unaligned"
    rows = _matrix(head["matrix"].split(None, 1)[1], form, source.taxa, n_chars, aligned)
    if form.transpose:
        columns = list(rows.values())
        rows = {t: [c[i] for c in columns] for i, t in enumerate(source.taxa)}
    if source.taxa and (strange := set(rows) - set(source.taxa)):
        raise ParseError(f"nexus: not among the taxa: {', '.join(sorted(strange))}")
    if not source.taxa:
        source.taxa += list(rows)
    first = next(iter(rows.values()))
    if aligned and (wrong := [f"{t} has {len(r)}" for t, r in rows.items() if len(r) != (n_chars or len(first))]):
        raise ParseError(f"nexus: {n_chars or len(first)} characters are expected; {', '.join(wrong)}")
    gone = set(_set(head["eliminate"].split(None, 1)[1], n_chars or len(first))) if "eliminate" in head else set()
    labels = _words(head["charlabels"].split(None, 1)[1]) if "charlabels" in head else []
    alphabet = Alphabet((*form.symbols, alphabets.GAP))
    if not aligned:
        sites = {t: [form.symbols_of(c, None) or tuple(alphabet.symbols) for c in r] or None for t, r in rows.items()}
        source.characters.append(Character(f"{name}", "dynamic", sites, alphabet))
        return
    for i in range(len(first)):
        if i in gone:
            continue
        values = {t: form.symbols_of(r[i], first[i]) for t, r in rows.items()}
        source.characters.append(Character(labels[i] if i < len(labels) else str(i), "discrete", values, alphabet, aligned=True))


def _assume(commands: list[str], source: Source) -> None:
    """Weights, order types, cost matrices and excluded characters."""
    n = len(source.characters)
    steps: dict[str, Tcm] = {}
    for c in commands:
        word, _, rest = c.partition(" ")
        body = rest.partition("=")[2]
        if word.lower() == "usertype":
            title = re.match(r"\s*\*?\s*(\S+?)(?:\s*\(|\s*=|\s)", rest + " ")[1]
            cells = [x for x in body.split()]
            if not cells or not cells[0].isdigit():
                continue
            size = int(cells[0])
            values = cells[1:]
            if len(values) == size * size + size:
                values = values[size:]
            if len(values) != size * size:
                raise ParseError(f"nexus: {title} is no {size} x {size} matrix")
            steps[title.lower()] = Tcm.from_list(["0" if v == "." else v for v in values])
        elif word.lower() == "wtset":
            for weight, where in re.findall(r"([0-9.]+)\s*:\s*([^,]+)", body):
                for i in _set(where, n):
                    source.characters[i].weight = float(weight)
        elif word.lower() == "typeset":
            for kind, where in re.findall(r"(\w+)\s*:\s*([^,]+)", body):
                for i in _set(where, n):
                    source.characters[i].ordered = kind.lower() == "ord"
                    source.characters[i].tcm = steps.get(kind.lower(), source.characters[i].tcm)
        elif word.lower() == "exset":
            for i in _set(body, n):
                source.characters[i].ignored = True
