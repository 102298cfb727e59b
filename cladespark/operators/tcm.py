"""Cost matrices: scaling, factoring, structure, medians of sets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property, lru_cache
from math import gcd, lcm

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 2**32 - 1
#: Medians of all pairs of sets are tabulated for alphabets up to this size, and computed when asked for beyond it.
DENSE_SYMBOLS = 8
BIN_OF = {"NonAdditive": "nonAdditive", "Additive": "additive", "Metric": "metric", "UltraMetric": "metric", "Symmetric": "nonMetric", "NonSymmetric": "nonMetric"}


@dataclass(frozen=True)
class Tcm:
    """n x n integer costs; the costs of the input are these times `scale`."""

    cost: tuple[tuple[int, ...], ...]
    scale: Fraction = Fraction(1)

    @classmethod
    def of(cls, rows: Iterable[Iterable[int | float | str | Fraction]]) -> Tcm:
        exact = [[x if isinstance(x, Fraction) else Fraction(str(x)) for x in row] for row in rows]
        n = len(exact)
        if n < 2:
            raise ValueError("a cost matrix has two symbols at least")
        if any(len(row) != n for row in exact):
            raise ValueError("a cost matrix is square")
        if any(x < 0 for row in exact for x in row):
            raise ValueError("costs are not negative")
        common = lcm(*(x.denominator for row in exact for x in row))
        cost = tuple(tuple(int(x * common) for x in row) for row in exact)
        if max(map(max, cost)) > LARGEST:
            raise ValueError("a cost does not fit 32 bits")
        return cls(cost, Fraction(1, common))

    @classmethod
    def from_list(cls, values: Sequence) -> Tcm:
        n = round(len(values) ** 0.5)
        if n * n != len(values):
            raise ValueError("a cost matrix is square")
        return cls.of([values[i * n : (i + 1) * n] for i in range(n)])

    @classmethod
    def from_columns(cls, columns: Iterable[Sequence]) -> Tcm:
        return cls.of(zip(*columns, strict=True))

    @classmethod
    def generate(cls, n: int, f) -> Tcm:
        return cls.of([[f(i, j) for j in range(n)] for i in range(n)])

    @property
    def n(self) -> int:
        return len(self.cost)

    @cached_property
    def array(self) -> np.ndarray:
        return np.array(self.cost, np.int64)

    def factor(self) -> tuple[int, Tcm]:
        """Greatest common divisor of the entries, and the matrix without it. All zeros have the factor 0."""
        g = gcd(*(x for row in self.cost for x in row))
        return g, self if g in (0, 1) else Tcm(tuple(tuple(x // g for x in row) for row in self.cost), self.scale * g)

    def permuted(self, order: Sequence[int]) -> Tcm:
        return Tcm(tuple(tuple(self.cost[i][j] for j in order) for i in order), self.scale)

    def is_symmetric(self) -> bool:
        return all(self.cost[i][j] == self.cost[j][i] for i in range(self.n) for j in range(i))

    def _triangles_hold(self, join) -> bool:
        """cost(a, b) <= join(cost(a, c), cost(c, b)); for a < b < c only c is tried as the place between a and b."""
        m = self.array
        return all((m[:c, :c] <= join(m[:c, c, None], m[None, c, :c]))[np.triu_indices(c, 1)].all() for c in range(2, self.n))

    def _zero_diagonal_only(self) -> bool:
        return bool(((self.array == 0) == np.eye(self.n, dtype=bool)).all())

    def is_metric(self) -> bool:
        return self._zero_diagonal_only() and self._triangles_hold(np.add)

    def is_ultrametric(self) -> bool:
        return self._zero_diagonal_only() and self._triangles_hold(np.maximum)

    def is_additive(self) -> bool:
        return all(x == abs(i - j) for i, row in enumerate(self.cost) for j, x in enumerate(row))

    def is_non_additive(self) -> bool:
        return all(x == (i != j) for i, row in enumerate(self.cost) for j, x in enumerate(row))

    def structure(self) -> str:
        if not self.is_symmetric():
            return "NonSymmetric"
        if not self.is_metric():
            return "Symmetric"
        if self.is_additive():
            return "Additive"
        if not self.is_ultrametric():
            return "Metric"
        return "NonAdditive" if self.is_non_additive() else "UltraMetric"

    def diagnose(self) -> tuple[str, int, Tcm]:
        """Structure, factor taken out, and the matrix without it."""
        g, rest = self.factor()
        return rest.structure(), g, rest

    def bin(self) -> str:
        return BIN_OF[self.diagnose()[0]]

    def set_costs(self) -> np.ndarray:
        """For each set of at most DENSE_SYMBOLS symbols and each symbol i, the least cost from i into the set."""
        return _set_costs(self.cost)

    def median(self, *sets: int) -> tuple[int, int]:
        """Set of the symbols with the least sum of costs into the given sets, and that sum."""
        return _median(self.cost, sets)

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Median and cost of every pair of sets."""
        return _dense(self.cost)


@lru_cache(64)
def _set_costs(cost) -> np.ndarray:
    c, n = np.array(cost, np.int64), len(cost)
    out = np.full((1 << n, n), 1 << 40, np.int64)
    for mask in range(1, 1 << n):
        low = (mask & -mask).bit_length() - 1
        out[mask] = np.minimum(out[mask & (mask - 1)], c[:, low])
    return out


@lru_cache(1 << 20)
def _median(cost, sets: tuple[int, ...]) -> tuple[int, int]:
    members = [[j for j in range(len(cost)) if s >> j & 1] for s in sets]
    total = [sum(min(row[j] for j in m) for m in members) for row in cost]
    least = min(total)
    return sum(1 << i for i, x in enumerate(total) if x == least), least


@lru_cache(16)
def _dense(cost) -> tuple[np.ndarray, np.ndarray]:
    per = _set_costs(cost)
    n = len(cost)
    both = per[:, None, :] + per[None, :, :]
    least = both.min(2)
    median = ((both == least[:, :, None]) * (1 << np.arange(n))).sum(2)
    median[0, :], median[:, 0] = 0, 0
    return median, least


def default_tcm(n: int) -> Tcm:
    return Tcm.generate(n, lambda i, j: int(i != j))


def precedence(script: Tcm | None, in_file: Tcm | None, n: int) -> Tcm:
    """The script's matrix, else the file's, else 0/1."""
    return script or in_file or default_tcm(n)


def structure_frame(cells: DataFrame) -> DataFrame:
    """(tcm_id, structure) of cells(tcm_id, i, j, cost).

    Cells are dealt out once, by matrix, and one matrix, at most a few hundred symbols wide, is compared with itself in
    one task. Joins of cells with cells were broadcast through the driver where their number was guessed too low.
    Cells that come twice all count; comparisons with a cost that is null or missing do not.
    """
    i, j, cost = F.col("i"), F.col("j"), F.col("cost")
    side = lambda name, there: (F.min(F.when(there, cost)).alias(name), F.max(F.when(there, cost)).alias(f"{name}_most"), F.bool_or(F.when(there, cost.isNull())).alias(f"{name}_void"))
    flags = F.bool_and((cost == 0) == (i == j)).alias("zeros"), F.bool_and(cost == F.abs(i - j)).alias("additive"), F.bool_and(cost == F.when(i == j, 0).otherwise(1)).alias("discrete")
    low, high = F.when(i <= j, i).when(i > j, j).alias("low"), F.when(i <= j, j).when(i > j, i).alias("high")
    # Both costs of a pair of symbols; _void is null if there is no such cell, and on the diagonal both are the same cells.
    pairs = cells.dropna(subset="tcm_id").repartition("tcm_id").groupBy("tcm_id", low, high).agg(*flags, *side("up", i <= j), *side("down", i >= j))
    mirrored = F.col("up_void").isNotNull() & F.col("down_void").isNotNull()
    symmetric = F.when(mirrored, (F.col("up") == F.col("down_most")) & (F.col("up_most") == F.col("down")))
    above = F.collect_list(F.when(F.col("low") < F.col("high"), F.struct("low", "high", "up", "up_most", "up_void", "down", "down_void")))
    kept = [F.bool_and(x).alias(x) for x in ("zeros", "additive", "discrete")]
    joined = pairs.groupBy("tcm_id").agg(*kept, F.bool_and(symmetric).alias("symmetric"), F.bool_or(mirrored).alias("mirrored"), above.alias("above")).filter("mirrored")
    row = lambda a: F.map_from_entries(F.transform(F.filter("above", lambda p: p["low"] == a), lambda p: F.struct(p["high"], p)))
    lows = F.array_distinct(F.transform("above", lambda p: p["low"]))
    joined = joined.withColumn("rows", F.map_from_entries(F.transform(lows, lambda a: F.struct(a, row(a)))))

    def triangles_hold(join) -> Column:
        """cost(a, b) <= join(cost(a, c), cost(c, b)) for all a < b < c."""
        through = lambda c, x, y: F.when(x["up_void"].isNotNull() & y["down_void"].isNotNull(), join(x, y))
        least = lambda p: F.array_min(F.map_values(F.map_zip_with(F.try_element_at("rows", p["low"]), F.try_element_at("rows", p["high"]), through)))
        return F.forall("above", lambda p: F.coalesce(p["up_most"] <= least(p), F.lit(True)))

    # greatest() leaves out a null.
    greatest = lambda x, y: F.least(F.greatest(x["up"], y["down"]), F.when(x["up_void"], y["down"]), F.when(y["down_void"], x["up"]))
    metric, ultra = F.col("zeros") & triangles_hold(lambda x, y: x["up"] + y["down"]), F.col("zeros") & triangles_hold(greatest)
    structure = F.when(~F.col("symmetric"), "NonSymmetric").when(~metric, "Symmetric").when(F.col("additive"), "Additive").when(~ultra, "Metric").when(~F.col("discrete"), "UltraMetric").otherwise("NonAdditive")
    return joined.select("tcm_id", structure.alias("structure"))


def factor_frame(cells: DataFrame) -> DataFrame:
    """(tcm_id, factor): the greatest common divisor of each matrix; 0 of all zeros."""
    euclid = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))), lambda s: s["a"])
    # The different costs of a matrix, not its cells, are folded.
    costs = cells.select("tcm_id", F.col("cost").cast("long").alias("c")).distinct().groupBy("tcm_id").agg(F.array_sort(F.collect_set("c")).alias("all"))
    return costs.select("tcm_id", F.aggregate("all", F.lit(0).cast("long"), lambda a, b: euclid(a, b)).alias("factor"))


def bin_column(structure):
    out = F.lit(None).cast("string")
    for name, kind in BIN_OF.items():
        out = F.when(structure == name, kind).otherwise(out)
    return out
