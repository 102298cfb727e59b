"""Aggregations as DataFrame operations: arg-min with ties, occurrences, duplicates, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minima_by(df: DataFrame, keys: list[str], value: str, first: str | None = None) -> DataFrame:
    """Rows with the least value of their group: all of them, or the first by column `first`.

    The least value is aggregated before the shuffle and joined back, so no
    group is sorted; with few groups the join is a broadcast.
    """
    return _extreme(df, keys, value, first, F.min)


def maxima_by(df: DataFrame, keys: list[str], value: str, first: str | None = None) -> DataFrame:
    return _extreme(df, keys, value, first, F.max)


def _extreme(df: DataFrame, keys: list[str], value: str, first: str | None, extreme) -> DataFrame:
    if first is not None:
        row = F.struct(*[c for c in df.columns if c not in keys])
        order = F.struct(value, first) if extreme is F.min else F.struct(value, -F.col(first))
        pick = F.min_by if extreme is F.min else F.max_by
        return df.groupBy(*keys).agg(pick(row, order).alias("__row")).select(*keys, "__row.*").select(*df.columns)
    best = df.groupBy(*keys).agg(extreme(value).alias("__best"))
    if not keys:
        return df.crossJoin(F.broadcast(best)).filter(F.col(value) == F.col("__best")).drop("__best")  # one row
    renamed = best.select(*[F.col(k).alias(f"__{k}") for k in keys], "__best")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(renamed, [*same, F.col(value) == F.col("__best")], "left_semi")


def occurrences(df: DataFrame, column: str) -> DataFrame:
    """(value, count), most frequent first, equal counts by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")


def most_common(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equal ones."""
    counted = df.groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col("value"))).alias("x")).select(*keys, F.col("x.value").alias("value"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, in order."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("n > 1").select("value").orderBy("value")


def depends_on(df: DataFrame, key: str, value: str) -> Column:
    """Condition for an aggregate by `key`: one value for each key."""
    return F.countDistinct(value) == 1


def observed_alphabet(df: DataFrame, keys: list[str], symbols: str) -> DataFrame:
    """Sorted different symbols of each group, the gap last."""
    each = df.select(*keys, F.explode(symbols).alias("s")).filter(~F.col("s").isin("-", "?")).distinct()
    return each.groupBy(*keys).agg(F.concat(F.array_sort(F.collect_set("s")), F.array(F.lit("-"))).alias("alphabet"))


def leaf_union(df: DataFrame, keys: list[str], mask: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bit_or(mask).alias(mask))


def block_cost(costs: DataFrame) -> DataFrame:
    """(block_id, cost): sum of cost x weight of costs(block_id, bin, cost, weight)."""
    return costs.groupBy("block_id").agg(F.sum(F.col("cost") * F.col("weight")).alias("cost"))


def static_cost(costs: DataFrame) -> DataFrame:
    return costs.groupBy("block_id").agg(F.sum(F.when(F.col("bin") != "dynamic", F.col("cost") * F.col("weight")).otherwise(0)).alias("cost"))


def root_cost(costs: DataFrame, n_roots: int) -> DataFrame:
    """(block_id, cost): half the weight for each further root, times the average length of a dynamic character."""
    per = F.col("weight") / 2 * F.when(F.col("bin") == "dynamic", F.coalesce("length", F.lit(0))).otherwise(1)
    return costs.groupBy("block_id").agg((F.sum(per) * max(0, n_roots - 1)).alias("cost"))


def dag_cost(resolutions: DataFrame) -> DataFrame:
    """(dag_id, cost): for each root its cheapest resolution, summed over the roots."""
    return resolutions.groupBy("dag_id", "root").agg(F.min("cost").alias("c")).groupBy("dag_id").agg(F.sum("c").alias("cost"))


def average(df: DataFrame, keys: list[str], total: str, count: str) -> DataFrame:
    """Mean of (sum, count) pairs."""
    return df.groupBy(*keys).agg((F.sum(total) / F.sum(count)).alias("average"))
