"""Pairwise distances of taxa: weighted costs of their characters, summed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.functions import intervals, masks
from cladespark.operators.alignment import Aligner
from cladespark.operators.score import UNKNOWN, _dealt, observed_sets
from cladespark.operators.tcm import Tcm, default_tcm


def discrete_pairs(obs: DataFrame, characters: DataFrame, cost: Column | None = None) -> DataFrame:
    """(i, j, distance) of obs(taxon, char_id, mask) for all ordered pairs that share a character.

    Rows of one character meet in a join on the character, are summed by pair
    before the shuffle, and only half the pairs are computed. A pair's distance
    to itself is 0. `cost` is an expression of columns a and b (masks).
    """
    step = cost if cost is not None else F.when(F.col("a").bitwiseAND(F.col("b")) != 0, 0).otherwise(1)
    weights = characters.select("char_id", "weight")
    left = obs.select("char_id", F.col("taxon").alias("i"), F.col("mask").alias("a"))
    right = obs.select("char_id", F.col("taxon").alias("j"), F.col("mask").alias("b"))
    return _mirrored(left.join(right, "char_id").filter("i < j").join(weights, "char_id").groupBy("i", "j").agg(F.sum(step * F.col("weight")).alias("distance")), obs)


def interval_pairs(obs: DataFrame, characters: DataFrame) -> DataFrame:
    """The same of obs(taxon, char_id, lo, hi): the gap between two ranges."""
    weights = characters.select("char_id", "weight")
    side = lambda name, to: obs.select("char_id", F.col("taxon").alias(to), intervals.interval(F.col("lo"), F.col("hi")).alias(name))
    joined = side("a", "i").join(side("b", "j"), "char_id").filter("i < j").join(weights, "char_id")
    return _mirrored(joined.groupBy("i", "j").agg(F.sum(intervals.merge(F.col("a"), F.col("b"))[1] * F.col("weight")).alias("distance")), obs)


def _mirrored(half: DataFrame, obs: DataFrame) -> DataFrame:
    own = obs.select(F.col("taxon").alias("i"), F.col("taxon").alias("j"), F.lit(0.0).alias("distance")).distinct()
    half = half.withColumn("distance", F.col("distance").cast("double"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance")).unionByName(own)


def all_pairs(obs: DataFrame, characters: DataFrame, tcms: dict[int, Tcm] | None = None) -> DataFrame:
    """(i, j, distance) over characters of every kind, in numpy for each group of characters, summed by pair."""
    tcms = tcms or {}
    weights = characters.select("char_id", F.col("weight").alias("w"))

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        taxa = np.sort(rows.taxon.unique())
        place, total, met = {t: k for k, t in enumerate(taxa)}, np.zeros((len(taxa), len(taxa))), np.zeros((len(taxa), len(taxa)), bool)
        for (kind, tcm_id, symbols), part in rows.groupby(["bin", pd.to_numeric(rows.tcm_id).fillna(-1).astype(int), "symbols"]):
            chars, column = np.unique(part.char_id, return_inverse=True)
            row, weight = part.taxon.map(place).to_numpy(int), np.zeros(len(chars))
            weight[column] = part.w
            there = np.zeros((len(taxa), len(chars)), bool)
            there[row, column] = True
            cost = _costs(kind, part, row, column, there.shape, tcms.get(tcm_id) or default_tcm(int(symbols)), int(symbols))
            for x in range(len(taxa) - 1):
                both = there[x] & there[x + 1 :]
                met[x, x + 1 :] |= both.any(1)
                total[x, x + 1 :] += (np.where(both, cost(x), 0) * weight).sum(1)
        i, j = np.nonzero(met)
        return pd.DataFrame({"i": taxa[i], "j": taxa[j], "distance": total[i, j]})

    dealt = _dealt(obs, characters, obs.select("taxon").distinct().count()).join(weights, "char_id").groupBy("chunk").applyInPandas(each, "i string, j string, distance double")
    return _mirrored(dealt.groupBy("i", "j").agg(F.sum("distance").alias("distance")), obs)


def _costs(kind: str, part: pd.DataFrame, row: np.ndarray, column: np.ndarray, shape: tuple[int, int], tcm: Tcm, symbols: int) -> Callable[[int], np.ndarray]:
    """Costs of the characters of a taxon against those of the taxa after it: (taxa after it, characters). Missing ones cost 0."""
    if kind in ("continuous", "additive"):
        lo, hi = np.full(shape, np.nan), np.full(shape, np.nan)
        lo[row, column], hi[row, column] = part.lo, part.hi
        return lambda x: np.nan_to_num(np.maximum(0, np.maximum(lo[x], lo[x + 1 :]) - np.minimum(hi[x], hi[x + 1 :])), nan=0.0)
    aligner = Aligner(tcm)
    if kind == "dynamic":
        held = np.empty(shape, object)
        for r, c, seq in zip(row, column, part.seq, strict=True):
            held[r, c] = masks.unpacked(seq, symbols)

        def aligned(x: int) -> np.ndarray:
            out = np.zeros((shape[0] - x - 1, shape[1]), np.int64)
            at = [(r, c) for r in range(len(out)) for c in range(shape[1]) if held[x, c] is not None and held[x + 1 + r, c] is not None]
            if at:
                r, c = np.array(at).T
                out[r, c] = aligner.costs(held[x, c], held[x + 1 + r, c])
            return out

        return aligned
    sets = np.full(shape, UNKNOWN, object if masks.is_wide(symbols) else np.int64)
    sets[row, column] = observed_sets(part, part.symbols.to_numpy(int))

    def discrete(x: int) -> np.ndarray:
        a, b = np.broadcast_arrays(sets[x], sets[x + 1 :])
        known = (a >= 0) & (b >= 0)
        if kind == "nonAdditive":
            return known & ((a & b) == 0)
        if aligner.table is not None:
            return np.where(known, aligner.table[1][np.where(known, a, 0), np.where(known, b, 0)], 0)
        return np.array([aligner.median(int(p), int(q))[1] if k else 0 for p, q, k in zip(a.ravel(), b.ravel(), known.ravel(), strict=True)], float).reshape(a.shape)

    return discrete


def as_matrix(pairs: DataFrame, taxa: list[str]):
    """Dense matrix in the order of the taxa; n x n values reach the driver, as the report needs them."""
    place = {t: k for k, t in enumerate(taxa)}
    out = np.zeros((len(taxa), len(taxa)))
    for r in pairs.toPandas().itertuples():
        if r.i in place and r.j in place:
            out[place[r.i], place[r.j]] = r.distance
    return out
