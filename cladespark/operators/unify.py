"""Unification of inputs by taxon: merge, padding, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.errors import UnifyError, raise_all


def outer_merge(blocks: list[DataFrame]) -> DataFrame:
    """Blocks(taxon, values...) with different value columns, merged by taxon; what a block lacks is null."""
    return reduce(lambda a, b: a.join(b, "taxon", "full"), blocks)


def pad(obs: DataFrame, characters: DataFrame) -> DataFrame:
    """A row for each taxon and character; missing ones are null. Taxa are few beside characters, so they are the side that is repeated."""
    taxa = obs.select("taxon").distinct()
    grid = characters.select("char_id").crossJoin(taxa)
    return grid.join(obs, ["taxon", "char_id"], "left")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the one of the latest source."""
    row = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(row, order).alias("r")).select(*keys, "r.*").select(*rows.columns)


def missing_taxa(taxa: DataFrame, leaves: DataFrame) -> DataFrame:
    """Taxa of the data that the graph lacks."""
    return taxa.select("taxon").distinct().join(leaves.select("taxon"), "taxon", "left_anti")


def extra_taxa(taxa: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaves of the graph without data."""
    return leaves.select("taxon").distinct().join(taxa.select("taxon"), "taxon", "left_anti")


def duplicate_taxa(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("taxon").agg(F.count("*").alias("n")).filter("n > 1").select("taxon")


def attach(leaves: DataFrame, obs: DataFrame) -> DataFrame:
    """Leaves with their characters; a leaf without a row keeps nulls, which stand for missing."""
    return leaves.join(obs, "taxon", "left")


def validate(taxa: list[str], forests: list[tuple[str, list[str]]]) -> None:
    """Raise the unification errors of all forests (source, leaf labels) together."""
    found = []
    known = set(taxa)
    if not taxa and not forests:
        raise UnifyError("no input data")
    for source, labels in forests:
        seen = set(labels)
        for what, names in (("duplicate", {x for x in labels if labels.count(x) > 1} if len(seen) < len(labels) else set()), ("extra", seen - known if known else set()), ("missing", known - seen if known else set())):
            if names:
                found.append(UnifyError(f"{source}: {what} taxa: {', '.join(sorted(names))}"))
    raise_all(found)
