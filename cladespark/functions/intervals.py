"""Closed intervals as structs (lo, hi): the algebra of additive and continuous characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def intersects(a: Column, b: Column) -> Column:
    return (b["lo"] <= a["hi"]) & (b["hi"] >= a["lo"])


def intersection(a: Column, b: Column) -> Column:
    return interval(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"]))


def hull(a: Column, b: Column) -> Column:
    return interval(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"]))


def closest_to(a: Column, b: Column) -> Column:
    """Value of a nearest to b, for intervals that do not meet."""
    return F.when(a["hi"] < b["lo"], a["hi"]).otherwise(a["lo"])


def smallest_closed(a: Column, b: Column) -> Column:
    """What lies between two intervals that do not meet, ends included."""
    return interval(F.least(a["hi"], b["hi"]), F.greatest(a["lo"], b["lo"]))


def largest_closed(a: Column, value: Column) -> Column:
    return interval(F.least(value, a["hi"]), F.greatest(value, a["lo"]))


def three_way(ancestor: Column, own: Column, below: Column) -> Column:
    mine, theirs = closest_to(own, ancestor), closest_to(below, ancestor)
    return interval(F.least(mine, theirs), F.greatest(mine, theirs))


def merge(a: Column, b: Column) -> tuple[Column, Column]:
    """State and added cost of a parent: the common part, else the gap between the two at its width."""
    gap = smallest_closed(a, b)
    return F.when(intersects(a, b), intersection(a, b)).otherwise(gap), F.when(intersects(a, b), F.lit(0)).otherwise(gap["hi"] - gap["lo"])


def finalize(ancestor: Column, own: Column, left: Column, right: Column) -> Column:
    """Final interval of an inner node from its parent's final one and the preliminary ones of itself and its children."""
    below, shared = hull(left, right), intersection(ancestor, own)
    chi = intersection(hull(below, own), ancestor)
    inherited = (shared["lo"] == ancestor["lo"]) & (shared["hi"] == ancestor["hi"])
    reached = F.when(intersects(chi, own), chi).otherwise(largest_closed(chi, closest_to(own, chi)))
    return F.when(inherited, ancestor).when(intersects(below, ancestor), reached).otherwise(three_way(ancestor, own, below))
