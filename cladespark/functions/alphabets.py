"""Alphabets and ambiguity codes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

GAP, MISSING = "-", "?"

# The preset alphabets.
DNA_SYMBOLS = ("A", "C", "G", "T")
RNA_SYMBOLS = ("A", "C", "G", "U")
AMINO_ACID_SYMBOLS = ("A", "C", "D", "E", "F", "G", "H", "I", "K", "L", "M", "N", "P", "Q", "R", "S", "T", "V", "W", "Y")
DISCRETE_SYMBOLS = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", *"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

# IUPAC nucleotide codes. A lower-case letter is the same set and the gap.
IUPAC_DNA = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT", "-": "-", "?": "ACGT-"}
# IUPAC amino acid codes that stand for more than one.
IUPAC_AMINO_ACID = {"B": "DN", "Z": "EQ", "J": "IL", "X": "ACDEFGHIKLMNPQRSTVWY", "-": "-", "?": "ACDEFGHIKLMNPQRSTVWY-"}


def iupac(kind: str) -> dict[str, tuple[str, ...]]:
    """Character -> its symbols, for kind dna, rna or amino_acid."""
    if kind == "amino_acid":
        return {c: (c,) for c in AMINO_ACID_SYMBOLS} | {k: tuple(v) for k, v in IUPAC_AMINO_ACID.items()}
    table = {k: tuple(v) for k, v in IUPAC_DNA.items()}
    table |= {k.lower(): (*v, GAP) for k, v in table.items() if k.isalpha()}
    if kind == "rna":
        turn = lambda s: "U" if s == "T" else "u" if s == "t" else s
        table = {turn(k): tuple(map(turn, v)) for k, v in table.items()}
    elif kind != "dna":
        raise ValueError(f"no ambiguity codes for {kind}")
    return table


@dataclass(frozen=True)
class Alphabet:
    """Ordered symbols, each once; the gap comes last and the missing sign is none of them."""

    symbols: tuple[str, ...]
    names: tuple[str, ...] = ()

    @classmethod
    def of(cls, symbols: Iterable[str], ordered: bool = False) -> Alphabet:
        seen = [s for s in dict.fromkeys(symbols) if s not in (GAP, MISSING)]
        return cls((*(seen if ordered else sorted(seen)), GAP))

    def __len__(self) -> int:
        return len(self.symbols)

    @property
    def full(self) -> int:
        return (1 << len(self.symbols)) - 1

    @property
    def gap(self) -> int:
        return 1 << (len(self.symbols) - 1)

    def index(self, symbol: str) -> int:
        try:
            return self.symbols.index(symbol)
        except ValueError:
            raise KeyError(f"{symbol!r} is not in the alphabet") from None

    def encode(self, group: Iterable[str] | None) -> int:
        """Mask of an ambiguity group; a missing one is every symbol."""
        if group is None:
            return self.full
        group = list(group)
        if MISSING in group:
            return self.full
        return sum(1 << i for i in {self.index(s) for s in group})

    def decode(self, mask: int) -> tuple[str, ...]:
        return tuple(s for i, s in enumerate(self.symbols) if mask >> i & 1)

    def sorted_order(self) -> list[int]:
        """Places of the symbols in sorted order, gap last: the permutation that a cost matrix follows."""
        return [*sorted(range(len(self.symbols) - 1), key=self.symbols.__getitem__), len(self.symbols) - 1]


DNA, RNA = Alphabet.of(DNA_SYMBOLS), Alphabet.of(RNA_SYMBOLS)
AMINO_ACID, DISCRETE = Alphabet.of(AMINO_ACID_SYMBOLS), Alphabet.of(DISCRETE_SYMBOLS, ordered=True)
