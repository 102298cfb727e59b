"""The command language: names with bracketed arguments, in any order, with defaults.

    read("a.fasta", prealigned:("b.fas"))  build(3, network, cluster:(upgma, group:2))  report(data, ("out", overwrite))

** starts a comment to the end of a line; (* and *) enclose one, and nest.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from cladespark.errors import ParseError


@dataclass(frozen=True)
class Named:
    """name:value."""

    name: str
    value: object


@dataclass(frozen=True)
class Word:
    """A keyword."""

    text: str


@dataclass(frozen=True)
class Seconds:
    value: int


@dataclass(frozen=True)
class FileSpec:
    """Files and how to read them: kind is None, dna, amino_acid, annotated, chromosome, genome or custom."""

    paths: tuple[str, ...]
    kind: str | None = None
    prealigned: bool = False
    tcm: str | None = None


@dataclass(frozen=True)
class Read:
    files: tuple[FileSpec, ...]


@dataclass(frozen=True)
class Build:
    trajectories: int = 1
    kind: str = "tree"
    linkage: str = "no-cluster"
    groups: int | None = 1
    cut: float = 0.7


@dataclass(frozen=True)
class Report:
    format: str
    path: str | None = None
    mode: str = "move"


@dataclass(frozen=True)
class Save:
    path: str = ".session.save"


@dataclass(frozen=True)
class Load:
    path: str = ".session.save"


@dataclass(frozen=True)
class Echo:
    text: str


@dataclass(frozen=True)
class Version:
    short: bool = False


# Names that arguments go by.
FILE_KINDS = {
    **dict.fromkeys(("amino_acid", "amino_acids", "aminoacid", "aminoacids", "protein", "proteins"), "amino_acid"),
    **dict.fromkeys(("nucleotide", "nucleotides"), "dna"),
    "annotated": "annotated",
    **dict.fromkeys(("chromosome", "chromosomes", "chromosomal"), "chromosome"),
    **dict.fromkeys(("genome", "genomes", "genomic", "genomics"), "genome"),
}
LINKAGES = ("no-cluster", "single", "complete", "upgma", "weighted", "ward", "k-medians")
FORMATS = {"data": "data", "dot": "dot", "graphviz": "dot", "distance": "distance", "implied-alignment": "implied-alignment", "metadata": "metadata", "cross-references": "metadata", "xml": "xml"}
MODES = ("overwrite", "move", "append")
_NUMBER = re.compile(r"[+-]?\s*(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)")
_TIME = re.compile(r"(\d+):(\d\d):(\d\d)")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
LARGEST_INT = 2**63 - 1


class _Tokens:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> None:
        while self.at < len(self.text):
            if self.text[self.at].isspace():
                self.at += 1
            elif self.text.startswith("**", self.at):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif self.text.startswith("(*", self.at):
                depth = 0
                while True:
                    if self.text.startswith("(*", self.at):
                        depth, self.at = depth + 1, self.at + 2
                    elif self.text.startswith("*)", self.at):
                        depth, self.at = depth - 1, self.at + 2
                        if not depth:
                            break
                    elif self.at >= len(self.text):
                        self.fail("a comment is not closed")
                    else:
                        self.at += 1
            else:
                return

    def fail(self, why: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise ParseError(f"script: {why} in line {line} at character {self.at}")

    def peek(self) -> str:
        self.skip()
        return self.text[self.at : self.at + 1]

    def take(self, c: str) -> None:
        if self.peek() != c:
            self.fail(f"{c!r} is expected, not {self.peek()!r}")
        self.at += 1

    def string(self) -> str:
        self.take('"')
        out = []
        escapes = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "(": "(", ")": ")", "0": "\0"}
        while True:
            c = self.text[self.at : self.at + 1]
            if not c:
                self.fail("a text is not closed")
            self.at += 1
            if c == '"':
                return "".join(out)
            if c == "\\":
                c = escapes.get(self.text[self.at : self.at + 1], "")
                if not c:
                    self.fail("an unknown escape")
                self.at += 1
            out.append(c)

    def value(self) -> object:
        c = self.peek()
        if c == '"':
            return self.string()
        if c == "(":
            return self.arguments()
        if m := _TIME.match(self.text, self.at):
            self.at = m.end()
            return Seconds(int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3]))
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            number = float(m[0].replace(" ", ""))
            if "." not in m[0] and number.is_integer():
                return max(-LARGEST_INT - 1, min(LARGEST_INT, int(number)))
            return number
        if m := _NAME.match(self.text, self.at):
            self.at = m.end()
            if self.peek() == ":":
                self.at += 1
                return Named(m[0].lower(), self.value())
            return {"true": True, "false": False}.get(m[0].lower(), Word(m[0].lower()))
        self.fail("an argument is expected")

    def arguments(self) -> tuple:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.value())
            if self.peek() == ",":
                self.at += 1
                if self.peek() == ")":
                    self.fail("an argument is expected")
            elif self.peek() != ")":
                self.fail("',' or ')' is expected")
        self.at += 1
        return tuple(out)


def _paths(value: object) -> tuple[str, ...]:
    items = value if isinstance(value, tuple) else (value,)
    if not items or not all(isinstance(x, str) for x in items):
        raise ParseError("script: paths are texts")
    return items


def _file(value: object) -> FileSpec:
    if isinstance(value, str):
        return FileSpec((value,))
    if isinstance(value, tuple) and len(value) == 1:
        return _file(value[0])
    if not isinstance(value, Named):
        raise ParseError("script: read takes paths and kinds of paths")
    if value.name in FILE_KINDS:
        return FileSpec(_paths(value.value), FILE_KINDS[value.name])
    if value.name == "prealigned":
        return replace(_file(value.value), prealigned=True)
    if value.name in ("set_tcm", "custom_alphabet"):
        items = value.value if isinstance(value.value, tuple) else (value.value,)
        tcm = [x for x in items if isinstance(x, Named) and x.name == "tcm"]
        rest = [x for x in items if x not in tcm]
        if len(tcm) != 1 or not rest or not isinstance(tcm[0].value, str):
            raise ParseError(f"script: {value.name} takes files and one tcm")
        if value.name == "set_tcm":
            if len(rest) != 1:
                raise ParseError("script: set_tcm takes one file argument")
            return replace(_file(rest[0]), tcm=tcm[0].value)
        flat = tuple(p for x in rest for p in _paths(x))
        return FileSpec(flat, "custom", tcm=tcm[0].value)
    raise ParseError(f"script: read knows no {value.name}")


def _pick(args: list, test, default):
    """The first argument that passes, taken out of the list: arguments come in any order."""
    for i, a in enumerate(args):
        if test(a):
            return args.pop(i)
    return default


def _word(args: list, allowed: Sequence[str], default: str) -> str:
    found = _pick(args, lambda a: isinstance(a, Word) and a.text in allowed, None)
    return found.text if found else default


def _is_int(a) -> bool:
    return isinstance(a, int) and not isinstance(a, bool)


def _build(args: list) -> Build:
    n = _pick(args, _is_int, 1)
    kind = _word(args, ("tree", "network", "forest"), "tree")
    cluster = _pick(args, lambda a: isinstance(a, Named) and a.name == "cluster", None)
    if cluster is None:
        return Build(n, kind)
    inner = list(cluster.value if isinstance(cluster.value, tuple) else (cluster.value,))
    linkage = _pick(inner, lambda a: isinstance(a, str) and a.strip() in LINKAGES, None)
    linkage = linkage.strip() if linkage else _word(inner, LINKAGES, "no-cluster")
    group = _pick(inner, lambda a: isinstance(a, Named) and a.name == "group" and _is_int(a.value), None)
    cut = _pick(inner, lambda a: isinstance(a, Named) and a.name == "cut" and isinstance(a.value, (int, float)), None)
    if inner:
        raise ParseError(f"script: cluster knows no {inner[0]}")
    return Build(n, kind, linkage, group.value if group else None, float(cut.value) if cut else 0.7)


def _report(args: list) -> Report:
    chosen = _pick(args, lambda a: isinstance(a, Word) and a.text in FORMATS, None)
    if chosen is None:
        raise ParseError("script: report needs a format")
    target = _pick(args, lambda a: isinstance(a, (str, tuple)) or a == Word("stdout"), None)
    if target is None or isinstance(target, Word):
        return Report(FORMATS[chosen.text])
    if isinstance(target, str):
        return Report(FORMATS[chosen.text], target)
    items = list(target)
    path = _pick(items, lambda a: isinstance(a, str), None)
    if path is None:
        raise ParseError("script: report needs a path")
    mode = _word(items, MODES, "move")
    if items:
        raise ParseError(f"script: report knows no {items[0]}")
    return Report(FORMATS[chosen.text], path, mode)


def _command(name: str, given: tuple):
    args = list(given)
    if name == "read":
        if not args:
            raise ParseError("script: read needs a file")
        return Read(tuple(_file(a) for a in args))
    if name == "build":
        out = _build(args)
    elif name == "report":
        out = _report(args)
    elif name in ("save", "load"):
        _word(args, ("binary",), "")
        path = _pick(args, lambda a: isinstance(a, str), ".session.save")
        out = (Save if name == "save" else Load)(path)
    elif name == "echo":
        text = _pick(args, lambda a: isinstance(a, str), None)
        if text is None:
            raise ParseError("script: echo needs a text")
        _word(args, ("info", "warn"), "")
        out = Echo(text)
    elif name == "version":
        out = Version(_word(args, ("short", "full"), "full") == "short")
    else:
        raise ParseError(f"script: there is no command {name}")
    if args:
        raise ParseError(f"script: {name} knows no argument {args[0]}")
    return out


def parse_script(text: str) -> list:
    """Commands of a script, at least one."""
    tokens, out = _Tokens(text), []
    while tokens.peek():
        m = _NAME.match(tokens.text, tokens.at)
        if not m:
            tokens.fail("a command is expected")
        tokens.at = m.end()
        out.append(_command(m[0].lower(), tokens.arguments() if tokens.peek() == "(" else ()))
    if not out:
        raise ParseError("script: nothing there")
    return out


def optimize(commands: list) -> list:
    """Adjacent reads become one, so that their files are unified together."""
    out: list = []
    for c in commands:
        if isinstance(c, Read) and out and isinstance(out[-1], Read):
            out[-1] = Read(out[-1].files + c.files)
        else:
            out.append(c)
    return out


@dataclass
class Plan:
    commands: list = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Plan:
        return cls(optimize(parse_script(text)))
