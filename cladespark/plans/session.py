"""The session: runs scripts over a state of DataFrames and graphs."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from cladespark.errors import ComputeError, InputError, OutputError, ParseError, PhaseError, raise_all
from cladespark.operators import distance, search
from cladespark.operators.score import CHARACTERS, OBS, score_pruned
from cladespark.operators.tcm import Tcm
from cladespark.operators.topology import EDGES, NODES, Topology
from cladespark.plans import script
from cladespark.plans.encode import State, unify
from cladespark.sinks import report
from cladespark.sources import dispatch, paths
from cladespark.sources.newick import parse_newick
from cladespark.sources.normalized import Source
from cladespark.sources.tcm_file import parse_tcm

VERSION = "0.1.0"
LOG = logging.getLogger("cladespark")


class Session:
    """Commands as methods, and `run` for scripts. `say` gets what goes to the standard output.

    With `autosave` the state is saved to that folder after each read and
    build, so an interrupted script can go on from a load.
    """

    def __init__(self, spark: SparkSession, say: Callable[[str], None] = print, seed: int = 0, autosave: str | None = None):
        self.spark, self.say, self.seed, self.autosave = spark, say, seed, autosave
        self.state: State | None = None

    def run(self, text: str) -> State | None:
        """All commands in order; the first that touches data is a read or a load."""
        plan = script.Plan.of(text)
        steps = {script.Read: self.read, script.Build: self.build, script.Report: self.report, script.Save: self.save, script.Load: self.load}
        for command in plan.commands:
            if isinstance(command, script.Echo):
                self.say(command.text)
            elif isinstance(command, script.Version):
                self.say(VERSION if command.short else f"cladespark version {VERSION}")
            else:
                if self.state is None and not isinstance(command, (script.Read, script.Load)):
                    raise ComputeError("a script begins with read or load")
                steps[type(command)](command)
                LOG.info("%s", command)
                if self.autosave and isinstance(command, (script.Read, script.Build)):
                    self.save(script.Save(self.autosave))
        return self.state

    def main(self, text: str) -> int:
        """Run a script and return its exit code."""
        try:
            self.run(text)
        except PhaseError as e:
            for m in e.messages:
                self.say(f"error: {m}")
            return e.exit_code
        return 0

    def read(self, command: script.Read) -> State:
        """Parse all files, gathering the errors of each phase; unify, score, prune unused network edges. Replaces the state."""
        sources: list[Source] = []
        errors: list[PhaseError] = []
        for spec in command.files:
            for path in self._resolved(spec, errors):
                try:
                    sources.append(self._parsed(path, spec))
                except PhaseError as e:
                    errors.append(e)
        raise_all(errors)
        self.state = unify(self.spark, sources)
        self._rescore()
        return self.state

    def _resolved(self, spec: script.FileSpec, errors: list[PhaseError]) -> list[str]:
        if spec.kind in ("annotated", "chromosome", "genome"):
            errors.append(ParseError(f"{spec.kind} files are not implemented"))
            return []
        out = []
        for p in spec.paths:
            try:
                out += paths.resolve(self.spark, p)
            except InputError as e:
                errors.append(e)
        return out

    def _parsed(self, path: str, spec: script.FileSpec) -> Source:
        text = paths.read_text(self.spark, path)
        if spec.kind in ("dna", "amino_acid"):
            try:
                source = dispatch.from_fasta(text, path, "amino_acid" if spec.kind == "amino_acid" else None)
            except ParseError as e:
                raise ParseError(*[f"{path}: {m}" for m in e.messages]) from None
        elif spec.kind == "custom":
            source = dispatch.from_fastc(text, path)
        else:
            source = dispatch.parse(text, path)
        if spec.tcm:
            at = paths.resolve_one(self.spark, spec.tcm)
            alphabet, tcm = parse_tcm(paths.read_text(self.spark, at))
            try:
                source = dispatch.set_tcm(source, alphabet, tcm, at)
            except ParseError:
                if spec.kind != "custom":
                    raise
                # Symbols of one letter each may also be written without blanks.
                source = dispatch.set_tcm(dispatch.from_fasta(text, path, None), alphabet, tcm, at)
        return dispatch.expand_aligned(source) if spec.prealigned else dispatch.without_gaps(source)

    def _rescore(self) -> None:
        s = self.state
        if s.obs is None:
            s.costs = []
            return
        scored = [score_pruned(s.obs, s.characters, g, s.tcms) for g in s.graphs]
        s.graphs, s.costs = [g for g, _ in scored], [c for _, c in scored]

    def build(self, command: script.Build) -> State:
        """Trees or networks for each trajectory; with clusters, one tree put together from theirs."""
        s = self.state
        if s is None or s.obs is None:
            raise ComputeError("nothing is built without characters")
        if command.linkage == "k-medians":
            raise ComputeError("k-medians is not yet implemented")
        clustered = command.linkage != "no-cluster" and command.groups != 1
        if clustered:
            matrix = distance.as_matrix(distance.all_pairs(s.obs, s.characters, s.tcms), s.taxa)
            graphs = [search.cluster_build(s.obs, s.characters, matrix, s.taxa, s.tcms, command.linkage, command.groups, command.cut)]
            if command.kind == "network":
                held = search.Matrix(search._packed(s.obs, s.characters), s.tcms)
                graphs = [search.greedy_network(held, g)[0] for g in graphs]
        elif command.groups is not None and command.groups < 1:
            raise ComputeError("at least one cluster")
        else:
            # Trees that are there already are what a network grows from; single leaves are no trees.
            starts = s.graphs if command.kind == "network" and all(len(g.roots) == 1 and g.children for g in s.graphs) else None
            rows = search.build(s.obs, s.characters, s.tcms, command.trajectories, command.kind, self.seed, starts=starts).orderBy("trajectory").collect()
            graphs = [parse_newick(r.newick)[0] for r in rows]
        self.state = replace(s, graphs=graphs)
        self._rescore()
        return self.state

    def report(self, command: script.Report) -> None:
        for path, text in self._report_texts(command):
            if path is None:
                self.say(text)
            else:
                report.write(self.spark, path, text, command.mode)

    def _report_texts(self, command: script.Report) -> list[tuple[str | None, str]]:
        s = self.state
        if command.format == "data":
            return [(command.path, report.data(s.graphs, s.costs))]
        if command.format == "dot":
            return [(command.path, report.dot(s.graphs))]
        if command.format == "xml":
            return [(command.path, report.xml(s.graphs, s.costs))]
        if s.obs is None:
            raise OutputError(f"no {command.format} in a topological solution")
        if command.format == "metadata":
            return [(command.path, report.metadata_csv(s.metadata))]
        if command.format == "distance":
            return [(command.path, report.distance_csv(s.obs, s.characters, s.tcms, s.taxa))]
        found = report.implied_alignments(s.obs, s.characters, s.tcms, s.graphs[0])
        if not found:
            raise OutputError("no dynamic characters, no implied alignments")
        if len(found) == 1:
            return [(command.path, next(iter(found.values())))]
        # Several characters go to files of their own names, whatever the target.
        return [(f"{name.replace('/', '_').replace(':', '_')}.fasta", text) for name, text in found.items()]

    def save(self, command: script.Save) -> None:
        """A folder of Parquet tables: observations, characters, nodes, edges, and one row of the rest."""
        s, root = self.state, command.path
        try:
            if s.obs is not None:
                s.obs.write.mode("overwrite").parquet(f"{root}/obs")
                s.characters.write.mode("overwrite").parquet(f"{root}/characters")
            nodes = [(i, n, g.labels.get(n)) for i, g in enumerate(s.graphs) for n in g.nodes]
            edges = [(i, p, c, g.lengths.get((p, c))) for i, g in enumerate(s.graphs) for p, c in g.edges]
            self.spark.createDataFrame(nodes, NODES).write.mode("overwrite").parquet(f"{root}/nodes")
            self.spark.createDataFrame(edges, EDGES).write.mode("overwrite").parquet(f"{root}/edges")
            rest = {"tcms": {k: t.cost for k, t in s.tcms.items()}, "taxa": s.taxa, "metadata": s.metadata, "graphs": len(s.graphs), "characters": s.obs is not None}
            self.spark.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{root}/state")
        except Exception as e:
            raise OutputError(f"{root}: cannot be written: {str(e).splitlines()[0]}") from None

    def load(self, command: script.Load) -> State:
        root = command.path
        read = lambda name: self.spark.read.parquet(f"{root}/{name}")
        try:
            rest = json.loads(read("state").first().value)
            nodes, edges = read("nodes"), read("edges")
        except Exception as e:
            raise InputError(f"{root}: cannot be read: {str(e).splitlines()[0]}") from None
        graphs = [Topology.from_frames(nodes, edges, i) for i in range(rest["graphs"])]
        frames: tuple[DataFrame | None, DataFrame | None] = (None, None)
        if rest["characters"]:
            frames = self.spark.read.schema(OBS).parquet(f"{root}/obs"), self.spark.read.schema(CHARACTERS).parquet(f"{root}/characters")
        tcms = {int(k): Tcm(tuple(map(tuple, v))) for k, v in rest["tcms"].items()}
        self.state = State(*frames, tcms, graphs, [], rest["taxa"], [tuple(m) for m in rest["metadata"]])
        self._rescore()
        return self.state


__all__ = ["Session", "VERSION"]
