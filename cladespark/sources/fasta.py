"""FASTA and FASTC: labelled sequences, one character a symbol or symbols between blanks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.errors import ParseError
from cladespark.functions import alphabets

_LABEL = re.compile(r"^>\s*(.*?)\s*$")
#: Characters that a sequence of each kind may hold, besides blanks.
ALLOWED = {
    "dna": set("ACGTMRWSYKVHDBNacgtmrwsykvhdbn-?.#"),
    "rna": set("ACGUMRWSYKVHDBNacgumrwsykvhdbn-?.#"),
    "amino_acid": set("ABCDEFGHIJKLMNPQRSTUVWXYZabcdefghijklmnpqrstuvwxyz-?.*#"),
}


def _records(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    for line in text.splitlines():
        if m := _LABEL.match(line):
            name = m[1].partition(";")[0].strip() if ";" in m[1] else m[1]
            if not name:
                raise ParseError("fasta: an empty label")
            out.append((name, []))
        elif line.strip():
            if not out:
                raise ParseError("fasta: a sequence before the first label")
            out[-1][1].append(line.strip())
    if not out:
        raise ParseError("fasta: nothing there")
    names = [n for n, _ in out]
    twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
    if twice:
        raise ParseError(f"fasta: labels that repeat: {', '.join(twice)}")
    return [(n, "\n".join(s)) for n, s in out]


def guess_kind(sequences: list[str]) -> str:
    """dna, else rna, else amino_acid: the first whose characters are enough."""
    used = {c for s in sequences for c in s if not c.isspace()}
    for kind, allowed in ALLOWED.items():
        if used <= allowed:
            return kind
    raise ParseError(f"fasta: characters of no alphabet: {''.join(sorted(used - ALLOWED['amino_acid']))}")


def parse_fasta(text: str, kind: str | None = None) -> tuple[str, dict[str, list[list[tuple[str, ...]]]]]:
    """(kind, taxon -> partitions -> sites -> symbols). A # ends a partition; all taxa have equally many."""
    records = [(n, "".join(s.split())) for n, s in _records(text)]
    if any(not s for _, s in records):
        raise ParseError("fasta: a label without a sequence")
    kind = kind or guess_kind([s for _, s in records])
    wrong = {c for _, s in records for c in s} - ALLOWED[kind]
    if wrong:
        raise ParseError(f"fasta: not in the {kind} alphabet: {''.join(sorted(wrong))}")
    codes = alphabets.iupac(kind)
    table = codes | {".": codes["-"]} | ({"n": codes["?"], "N": codes["N"]} if kind != "amino_acid" else {})

    def sites(s: str) -> list[tuple[str, ...]]:
        if kind == "amino_acid":
            s = s.upper().replace("U", "C")
        return [table.get(c) or table[c.upper()] for c in s.replace("*", "-")]

    out = {n: [sites(p) for p in s.split("#")] for n, s in records}
    if len({len(p) for p in out.values()}) > 1:
        raise ParseError("fasta: taxa with different numbers of partitions")
    return kind, out


def parse_fastc(text: str) -> dict[str, list[tuple[str, ...]]]:
    """taxon -> sites; a site is a symbol or an ambiguity group in brackets."""
    out = {}
    for name, body in _records(text):
        if body.count("[") != body.count("]"):
            raise ParseError(f"fastc: brackets of {name} do not match")
        sites = [tuple(dict.fromkeys(m[1].split())) if m[1] is not None else (m[2],) for m in re.finditer(r"\[([^\[\]]*)\]|([^\s\[\]]+)", body)]
        if not sites or any(not s for s in sites):
            raise ParseError(f"fastc: {name} has an empty site or none")
        out[name] = sites
    return out


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(source, taxon, sequence) of any number of files, parsed in the JVM."""
    texts = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    return fasta_rows(texts, "value", ["source"])


def fasta_rows(texts: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep..., taxon, sequence): records split by column expressions alone."""
    record = F.explode(F.filter(F.split(F.regexp_replace(column, r"\r\n?", "\n"), r"(?:^|\n)>"), lambda x: F.trim(x) != "")).alias("record")
    rows = texts.select(*keep, record)
    label = F.trim(F.split_part("record", F.lit("\n"), F.lit(1)))
    body = F.regexp_replace(F.regexp_extract("record", r"(?s)^[^\n]*\n(.*)$", 1), r"\s+", "")
    return rows.select(*keep, label.alias("taxon"), body.alias("sequence"))
