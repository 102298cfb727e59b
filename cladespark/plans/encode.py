"""Parsed sources as DataFrames: observations, characters, cost matrices."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cladespark.errors import UnifyError
from cladespark.functions import masks
from cladespark.operators.score import CHARACTERS, OBS
from cladespark.operators.tcm import Tcm, default_tcm
from cladespark.operators.topology import Topology
from cladespark.operators.unify import validate
from cladespark.sources.normalized import Character, Source


@dataclass
class State:
    """What a script works on: characters (None if there are only graphs), graphs."""

    obs: DataFrame | None = None
    characters: DataFrame | None = None
    tcms: dict[int, Tcm] = field(default_factory=dict)
    graphs: list[Topology] = field(default_factory=list)
    costs: list[dict] = field(default_factory=list)
    taxa: list[str] = field(default_factory=list)
    metadata: list[tuple] = field(default_factory=list)


def bin_of(c: Character) -> tuple[str, Tcm | None]:
    """Kind of kernel: by the structure of the cost matrix, the discrete metric without one."""
    if c.kind == "continuous":
        return "continuous", None
    if c.kind == "dynamic":
        return "dynamic", c.tcm or default_tcm(len(c.alphabet))
    if c.tcm is not None:
        kind = c.tcm.bin()
        return kind, c.tcm if kind in ("metric", "nonMetric") else None
    return ("additive" if c.ordered else "nonAdditive"), None


def _row(taxon: str, i: int, kind: str, c: Character, value) -> tuple:
    if value is None:
        return taxon, i, None, None, None, None
    if kind == "continuous":
        return taxon, i, None, float(value[0]), float(value[1]), None
    if kind == "dynamic":
        return taxon, i, None, None, None, masks.packed([c.alphabet.encode(site) for site in value], len(c.alphabet))
    mask = c.alphabet.encode(value)
    # A set of a wide alphabet stands in the sequence, as it takes several numbers.
    wide = masks.is_wide(len(c.alphabet))
    held, seq = (None, masks.packed([mask], len(c.alphabet))) if wide else (mask, None)
    if kind == "additive":
        return taxon, i, held, float((mask & -mask).bit_length() - 1), float(mask.bit_length() - 1), seq
    return taxon, i, held, None, None, seq


def unify(spark: SparkSession, sources: list[Source]) -> State:
    """Blocks, one for each file with characters, merged by taxon; graphs checked against the taxa.

    Graphs alone are a topological result; characters alone get a forest of
    single leaves. A taxon that a file lacks is missing there. Inactive
    characters are scored like others.
    """
    data = [s for s in sources if s.characters]
    forests = [(s.path, t) for s in sources for t in s.forests]
    taxa = list(dict.fromkeys(t for s in data for t in s.taxa))
    if not data and not forests:
        raise UnifyError("no input data")
    validate(taxa, [(path, t.leaf_labels()) for path, t in forests])
    if not data:
        return State(graphs=[t for _, t in forests], taxa=[])
    obs, chars, tcms, index = [], [], {}, {}
    number = 0
    metadata = []
    for block, s in enumerate(data):
        for c in s.characters:
            kind, tcm = bin_of(c)
            tcm_id = None
            if tcm is not None:
                tcm_id = index.setdefault(tcm.cost, len(index))
                tcms[tcm_id] = tcm
            symbols = list(c.alphabet.symbols) if c.alphabet else []
            chars.append((number, block, c.name, kind, float(c.weight), symbols, tcm_id, s.path))
            metadata.append((c.name, s.path, kind, c.tcm_source or "n/a"))
            obs += [_row(t, number, kind, c, c.values.get(t)) for t in taxa]
            number += 1
    graphs = [t for _, t in forests] or [Topology({}, dict(enumerate(taxa)), {}, tuple(range(len(taxa))))]
    return State(spark.createDataFrame(obs, OBS), spark.createDataFrame(chars, CHARACTERS), tcms, graphs, [], taxa, metadata)
