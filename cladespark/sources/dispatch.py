"""Choice of a parser: the one that the extension suggests first, then all others."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import PurePosixPath

from cladespark.errors import ParseError
from cladespark.functions import alphabets
from cladespark.functions.alphabets import Alphabet
from cladespark.operators.tcm import Tcm
from cladespark.sources.dot import parse_dot
from cladespark.sources.fasta import parse_fasta, parse_fastc
from cladespark.sources.newick import parse_newick
from cladespark.sources.nexus import parse_nexus
from cladespark.sources.normalized import Character, Source
from cladespark.sources.tnt import parse_tnt
from cladespark.sources.ver import parse_ver

_PRESETS = {"dna": alphabets.DNA, "rna": alphabets.RNA, "amino_acid": alphabets.AMINO_ACID}


def from_fasta(text: str, path: str, kind: str | None = None) -> Source:
    """Sequences of nucleotides, unless another kind is asked for; each partition is a character."""
    kind, taxa = parse_fasta(text, kind)
    alphabet = _PRESETS[kind]
    n = len(next(iter(taxa.values())))
    chars = [Character(f"{PurePosixPath(path).name}:{i}", "dynamic", {t: p[i] for t, p in taxa.items()}, alphabet) for i in range(n)]
    return Source(path, list(taxa), chars)


def from_fastc(text: str, path: str) -> Source:
    taxa = parse_fastc(text)
    alphabet = Alphabet.of(s for sites in taxa.values() for site in sites for s in site)
    return Source(path, list(taxa), [Character(f"{PurePosixPath(path).name}:0", "dynamic", taxa, alphabet)])


#: Name, extensions, parser.
FORMATS: list[tuple[str, tuple[str, ...], Callable[[str, str], Source]]] = [
    ("fasta", ("fas", "fasta", "fa", "fna", "faa"), lambda t, p: from_fasta(t, p)),
    ("fastc", ("fastc",), from_fastc),
    ("newick", ("tre", "tree", "new", "newick", "enew", "enewick"), lambda t, p: Source(p, forests=parse_newick(t))),
    ("nexus", ("nex", "nexus"), parse_nexus),
    ("tnt", ("tnt", "ss", "hen", "hennig"), parse_tnt),
    ("ver", ("ver",), lambda t, p: Source(p, forests=[parse_ver(t)])),
    ("dot", ("dot", "gv"), lambda t, p: Source(p, forests=[parse_dot(t)])),
]
#: Formats in which a text is not taken for another one by chance come first when all are tried.
_TRIED = ("nexus", "tnt", "dot", "ver", "fasta", "fastc", "newick")


def parse(text: str, path: str = "") -> Source:
    """The preferred parser's result or error; else that of the first parser that reads the text, else the preferred or last error."""
    extension = PurePosixPath(path).suffix.lstrip(".").lower()
    by_name = {n: f for n, _, f in FORMATS}
    preferred = next((n for n, exts, _ in FORMATS if extension in exts), None)
    errors: dict[str, ParseError] = {}
    for name in dict.fromkeys([*([preferred] if preferred else []), *_TRIED]):
        try:
            return by_name[name](text, path)
        except ParseError as e:
            errors[name] = e
        except (ValueError, KeyError, IndexError) as e:
            errors[name] = ParseError(f"{name}: {e}")
    chosen = errors[preferred] if preferred else max(errors.values(), key=_reach)
    raise ParseError(*[f"{path}: {m}" for m in chosen.messages])


def _reach(error: ParseError) -> int:
    """How far a parser came, by the place its message names."""
    places = re.findall(r"at character (\d+)", " ".join(error.messages))
    return int(places[-1]) if places else 0


def without_gaps(source: Source) -> Source:
    """Unaligned sequences lose their gap sites; what is left empty is missing."""
    for c in source.characters:
        if c.kind == "dynamic" and not c.aligned:
            c.values = {t: ([s for s in v if tuple(s) != (alphabets.GAP,)] or None) if v is not None else None for t, v in c.values.items()}
    return source


def expand_aligned(source: Source) -> Source:
    """Each sequence becomes as many discrete characters as it has sites; lengths have to agree."""
    out = []
    for c in source.characters:
        if c.kind != "dynamic":
            out.append(c)
            continue
        lengths: dict[int, int] = {}
        for v in c.values.values():
            if v is not None:
                lengths[len(v)] = lengths.get(len(v), 0) + 1
        if len(lengths) > 1:
            listed = ", ".join(f"{n} taxa of length {k}" for k, n in sorted(lengths.items(), key=lambda x: -x[1]))
            raise ParseError(f"{source.path}: prealigned sequences of unequal lengths: {listed}")
        full = tuple(c.alphabet.symbols)
        for i in range(next(iter(lengths), 0)):
            column = {t: None if v is None or set(v[i]) == set(full) else tuple(v[i]) for t, v in c.values.items()}
            out.append(Character(f"{c.name}:{i}", "discrete", column, c.alphabet, c.tcm, c.weight, aligned=True, tcm_source=c.tcm_source))
    source.characters = out
    return source


def set_tcm(source: Source, alphabet: Alphabet, tcm: Tcm, path: str) -> Source:
    """The matrix goes to every discrete or dynamic character, with its alphabet; its scale goes into the weight."""
    factor, rest = tcm.factor()
    for c in source.characters:
        if c.kind == "continuous":
            continue
        if strange := {s for v in c.values.values() if v for site in (v if c.kind == "dynamic" else [v]) for s in site} - set(alphabet.symbols) - {alphabets.MISSING}:
            raise ParseError(f"{source.path}: not in the alphabet of {path}: {' '.join(sorted(strange))}")
        c.alphabet, c.tcm, c.tcm_source = alphabet, Tcm(rest.cost), path
        c.weight *= float(tcm.scale) * factor
    return source
