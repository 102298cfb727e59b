"""What every parser of character data ends in: characters of one source, their taxa, and its graphs."""

from __future__ import annotations

from dataclasses import dataclass, field

from cladespark.functions.alphabets import Alphabet
from cladespark.operators.tcm import Tcm
from cladespark.operators.topology import Topology


@dataclass
class Character:
    """One column. kind: continuous, discrete or dynamic. Values by taxon; None or absence is missing.

    continuous: (lo, hi); discrete: symbols; dynamic: a list of sites, each the symbols of an ambiguity group.
    """

    name: str
    kind: str
    values: dict[str, object]
    alphabet: Alphabet | None = None
    tcm: Tcm | None = None
    weight: float = 1.0
    ordered: bool = False
    ignored: bool = False
    aligned: bool = False
    tcm_source: str | None = None


@dataclass
class Source:
    """One file, that is one block."""

    path: str
    taxa: list[str] = field(default_factory=list)
    characters: list[Character] = field(default_factory=list)
    forests: list[Topology] = field(default_factory=list)
