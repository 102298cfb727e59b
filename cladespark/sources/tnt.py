"""TNT and Hennig files: xread, ccode, cnames, cost, nstates, tread; other commands are skipped."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from cladespark.errors import ParseError
from cladespark.functions import alphabets
from cladespark.functions.alphabets import Alphabet
from cladespark.operators.tcm import Tcm
from cladespark.operators.topology import Topology
from cladespark.sources.normalized import Character, Source

_NUMERIC = re.compile(r"\[([^\]]*)\]|([0-9A-Za-z?-])")
_RANGE = re.compile(r"^(\d+)?(\.)?(\d+)?$")


@dataclass
class State:
    """Settings of a character by ccode."""

    additive: bool = False
    active: bool = True
    sankoff: bool = False
    weight: int = 1
    steps: int = 0


@dataclass
class _File:
    taxa: list[str] = field(default_factory=list)
    rows: dict[str, list[tuple[str, list]]] = field(default_factory=dict)
    n_chars: int | None = None
    settings: list[State] = field(default_factory=list)
    names: dict[int, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    costs: dict[int, list[tuple[int, int, float, bool]]] = field(default_factory=dict)
    states: str = "num"
    trees: list[str] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)


def _commands(text: str) -> list[tuple[str, str]]:
    """Names and bodies; a body runs to the semicolon that ends it, quoted comments aside."""
    out, at = [], 0
    while True:
        m = re.compile(r"\s*([A-Za-z]+)").match(text, at)
        if not m:
            if text[at:].strip(" \t\r\n;"):
                raise ParseError(f"tnt: unreadable at character {at}")
            return out
        name, at = m[1].lower(), m.end()
        end, quoted = at, False
        while end < len(text) and (quoted or text[end] != ";"):
            quoted ^= text[end] == "'"
            end += 1
        if name == "cnames" or name.startswith("cn"):
            stop = re.compile(r";\s*;").search(text, at)
            end = stop.end() - 1 if stop else end
        if end >= len(text) and name not in ("proc", "procedure"):
            raise ParseError(f"tnt: {name} is not closed")
        out.append((name, text[at:end]))
        at = end + 1


def _of(name: str, full: str, least: int) -> bool:
    return full.startswith(name) and len(name) >= least


def _range(text: str, n: int) -> range:
    m = _RANGE.match(text)
    if not m:
        raise ParseError(f"tnt: {text} is no range of characters")
    if m[2]:
        first, last = int(m[1] or 0), int(m[3]) if m[3] else n - 1
    else:
        first = last = int(m[1])
    if last >= n or first > last:
        raise ParseError(f"tnt: characters {text} are out of range")
    return range(first, last + 1)


def _group(body: str, table: dict[str, tuple[str, ...]] | None) -> list[tuple[str, ...] | None]:
    out: list[tuple[str, ...] | None] = []
    for m in _NUMERIC.finditer(body):
        symbols = tuple(m[1].replace(" ", "")) if m[1] is not None else (m[2],)
        if "?" in symbols or symbols == ("-",) and table is None:
            out.append(None)
        elif table is not None:
            out.append(tuple(dict.fromkeys(s for c in symbols for s in table.get(c.upper(), table.get(c, (c,))))))
        else:
            out.append(symbols)
    return out


def _continuous(body: str) -> list[tuple[float, float] | None]:
    out: list[tuple[float, float] | None] = []
    for word in body.split():
        if word == "?":
            out.append(None)
            continue
        lo, _, hi = word.partition("-") if not word.startswith("-") else (word, "", "")
        try:
            out.append((float(lo), float(hi or lo)))
        except ValueError:
            raise ParseError(f"tnt: {word} is no number") from None
    return out


def _xread(body: str, file: _File) -> None:
    body = re.sub(r"'[^']*'", " ", body, count=1)
    m = re.match(r"\s*(\d+)\s+(\d+)", body)
    if not m:
        raise ParseError("tnt: xread has no dimensions")
    n_chars, n_taxa = int(m[1]), int(m[2])
    kind = "continuous" if file.states == "cont" else file.states if file.states in ("dna", "prot") else "num"
    for line in _lines(body[m.end() :], kind):
        if line.lstrip().startswith("&"):
            tags = re.findall(r"[a-z]+", line.lower())
            kind = next((k for t, k in (("cont", "continuous"), ("dna", "dna"), ("prot", "prot"), ("num", "num")) if any(x.startswith(t) for x in tags)), "num")
            continue
        taxon, _, values = line.strip().partition(" ") if " " in line.strip() else line.strip().partition("\t")
        taxon = taxon.strip()
        table = {"dna": alphabets.iupac("dna"), "prot": alphabets.iupac("amino_acid")}.get(kind)
        got = _continuous(values) if kind == "continuous" else _group(values, table)
        parts = file.rows.setdefault(taxon, [])
        if parts and parts[-1][0] == kind:
            parts[-1] = (kind, parts[-1][1] + got)
        else:
            parts.append((kind, got))
        if taxon not in file.taxa:
            file.taxa.append(taxon)
    wrong = [f"{t} has {n}" for t in file.taxa if (n := sum(len(v) for _, v in file.rows[t])) != n_chars]
    if wrong:
        raise ParseError(f"tnt: {n_chars} characters are expected; {', '.join(wrong)}")
    if len(file.taxa) != n_taxa:
        raise ParseError(f"tnt: {n_taxa} taxa are expected, {len(file.taxa)} are there")
    file.taxa.sort()  # numbers in trees count the names in order, whatever the order of the rows
    file.n_chars = n_chars
    file.settings = [State(additive=kind == "continuous") for kind, v in file.rows[file.taxa[0]] for _ in v]


def _lines(body: str, kind: str) -> list[str]:
    """Rows of a matrix; a line that starts with a blank, or has no second word, goes on with the row before it."""
    out: list[str] = []
    for line in body.split("\n"):
        if not line.strip():
            continue
        alone = len(line.split()) == 1 and not line.lstrip().startswith("&")
        if out and (alone and not out[-1].lstrip().startswith("&")):
            out[-1] += " " + line.strip()
        else:
            out.append(line)
    return out


def _ccode(body: str, file: _File) -> None:
    change: dict = {}
    for word in re.findall(r"[-+\[\]()]|/\d*|=\d*|[0-9.]+", body):
        if word in "+-":
            change = (change if change.get("_open") else {"_open": True}) | {"additive": word == "+", "sankoff": False}
        elif word in "[]":
            change = (change if change.get("_open") else {"_open": True}) | {"active": word == "["}
        elif word in "()":
            change = (change if change.get("_open") else {"_open": True}) | {"sankoff": word == "("}
        elif word[0] in "/=":
            key = "weight" if word[0] == "/" else "steps"
            change = (change if change.get("_open") else {"_open": True}) | {key: int(word[1:] or (1 if word[0] == "/" else 0))}
        else:
            values = {k: v for k, v in change.items() if k != "_open"}
            for i in _range(word, file.n_chars or 0):
                file.settings[i] = replace(file.settings[i], **values)
            change.pop("_open", None)


def _cnames(body: str, file: _File) -> None:
    for entry in body.split(";"):
        words = entry.split()
        if not words or words[0] in ("+", "-", "=") or not words[0].startswith("{"):
            continue
        number = words[0].lstrip("{")
        if not number:
            number, words = words[1], words[1:]
        if not number.isdigit() or len(words) < 2:
            raise ParseError(f"tnt: unreadable character name {entry.strip()}")
        file.names[int(number)] = (words[1], tuple(words[2:]))


def _cost(body: str, file: _File) -> None:
    for target, rest in re.findall(r"([0-9.]+)\s*=\s*((?:[^=]*?))(?=(?:[0-9.]+\s*=)|$)", body, re.S):
        rules = [(x, y, float(v), sign == "/") for x, sign, y, v in re.findall(r"([0-9A-Za-z])\s*([>/])\s*([0-9A-Za-z])\s+([0-9.]+)", rest)]
        for i in _range(target, file.n_chars or 0):
            file.costs.setdefault(i, []).extend(rules)
            file.settings[i] = replace(file.settings[i], sankoff=True)


def _tread(body: str, taxa: list[str]) -> list[Topology]:
    body = re.sub(r"'[^']*'", " ", body).strip()
    out = []
    for tree in body.split("*"):
        words = re.findall(r"[()]|[^\s()]+", tree)
        if not words:
            continue
        stack: list[list] = [[]]
        for w in words:
            if w == "(":
                stack.append([])
            elif w == ")":
                if len(stack) < 2:
                    raise ParseError("tnt: a parenthesis too many")
                done = stack.pop()
                stack[-1].append(tuple(done) if len(done) > 1 else done[0])
            else:
                stack[-1].append(_leaf(w, taxa))
        if len(stack) != 1 or len(stack[0]) != 1:
            raise ParseError("tnt: a tree that is not closed")
        out.append(Topology.nested(stack[0][0]))
    return out


def _leaf(word: str, taxa: list[str]) -> str:
    """By number, name, or a name's beginning that ends in dots and is the only such one."""
    if not taxa or word in taxa:
        return word
    if word.isdigit():
        if int(word) >= len(taxa):
            raise ParseError(f"tnt: there is no taxon {word}")
        return taxa[int(word)]
    if word.endswith("..."):
        found = [t for t in taxa if t.startswith(word.rstrip("."))]
        if len(found) == 1:
            return found[0]
        raise ParseError(f"tnt: {len(found)} taxa begin with {word.rstrip('.')}")
    raise ParseError(f"tnt: there is no taxon {word}")


def parse_tnt(text: str, path: str = "") -> Source:
    """One xread with its settings and trees, or trees alone. Include commands and unknown ones are skipped."""
    file = _File()
    for name, body in _commands(text):
        if _of(name, "xread", 2):
            if file.n_chars is not None:
                raise ParseError("tnt: two matrices")
            _xread(body, file)
        elif _of(name, "ccode", 2):
            file.pending.append(body)
        elif _of(name, "nstates", 2):
            file.states = {"c": "cont", "d": "dna", "p": "prot"}.get((body.split() or ["num"])[0].lower()[:1], "num")
        elif _of(name, "tread", 2):
            file.trees.append(body)
        elif _of(name, "cnames", 2) and file.n_chars is not None:
            _cnames(body, file)
        elif _of(name, "costs", 3) and file.n_chars is not None:
            _cost(body, file)
    if file.n_chars is None and not file.trees:
        raise ParseError("tnt: neither a matrix nor trees")
    if file.n_chars is not None:
        for body in file.pending:
            _ccode(body, file)
    forests = [t for body in file.trees for t in _tread(body, file.taxa)]
    return Source(path, file.taxa, _characters(file), forests)


def _characters(file: _File) -> list[Character]:
    if not file.n_chars:
        return []
    columns = {t: [(k, v) for k, part in file.rows[t] for v in part] for t in file.taxa}
    out = []
    for i in range(file.n_chars):
        kind = columns[file.taxa[0]][i][0]
        values = {t: columns[t][i][1] for t in file.taxa}
        state = file.settings[i]
        name, states = file.names.get(i, (str(i), ()))
        common = {"name": name, "weight": float(state.weight), "ignored": not state.active, "aligned": True}
        if kind == "continuous":
            out.append(Character(kind="continuous", values=values, ordered=True, **common))
            continue
        seen = {s for v in values.values() for s in v or ()}
        preset = {"dna": alphabets.DNA_SYMBOLS, "prot": alphabets.AMINO_ACID_SYMBOLS}.get(kind)
        # States are steps apart by their value, so the symbols up to the largest one are all there.
        last = max((alphabets.DISCRETE_SYMBOLS.index(s) for s in seen if s in alphabets.DISCRETE_SYMBOLS), default=0)
        symbols = preset or alphabets.DISCRETE_SYMBOLS[: last + 1]
        alphabet = Alphabet((*symbols, alphabets.GAP), states) if preset else Alphabet(tuple(symbols), states)
        tcm = None
        if state.sankoff and i in file.costs:
            table = [[0.0 if a == b else 1.0 for b in alphabet.symbols] for a in alphabet.symbols]
            for x, y, cost, both in file.costs[i]:
                if x in alphabet.symbols and y in alphabet.symbols:
                    table[alphabet.index(x)][alphabet.index(y)] = cost
                    if both:
                        table[alphabet.index(y)][alphabet.index(x)] = cost
            tcm = Tcm.of(table) if len(table) > 1 else None
        out.append(Character(kind="discrete", values=values, alphabet=alphabet, tcm=tcm, ordered=state.additive, **common))
    return out
