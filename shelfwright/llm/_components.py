"""Connected components over a table of links, by large and small stars.

Every round links each vertex to its smallest neighbour and rewires the rest;
minima are partial aggregates and the rewiring joins written tables, so a
vertex that a third of all links share is split by the adaptive skew-join
rule and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage, unstage

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v.  Large star: neighbours above u move to u's
    smallest neighbour (u itself included).  Small star: u and its neighbours
    below move to the smallest of them."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    moved = both.join(least, F.col("u") == F.col("k"))
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    out = out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # a large star has a row for each of its input's at most; a small star adds some
    result = stage(out if large else out.distinct(), "star")
    unstage(least)
    return result


def _mark(links: DataFrame) -> tuple:
    """Tells two sets of links apart."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(vertex, root) of every vertex of ``links`` (u, v: long); the root is
    the component's smallest vertex, which is a row too.  With ``rounds`` it
    stops early: roots then name groups of linked vertices, and a wide
    component may have several."""
    now = stage(links.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None if rounds else _mark(now)
    for _ in range(rounds or MAX_ROUNDS):
        wide = _star(now, large=True)
        stars = _star(wide, large=False)
        unstage(wide, now)
        now = stars
        if rounds is None:
            mark = _mark(now)
            if mark == before:  # stars already: nothing moved
                break
            before = mark
    else:
        if rounds is None:
            raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    # the fixed point has one row per vertex that is no root
    below = now.groupBy("u").agg(F.min("v").alias("v")) if rounds else now
    roots = now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_anti") if rounds else now.select("v").distinct()
    return below.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
        roots.select(F.col("v").alias("vertex"), F.col("v").alias("root")))
