"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, fitted


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node that it reaches, for each node of a link.

    Every round joins each node with the least of its neighbours, which aggregates before its
    shuffle and joins on node, so that a node with very many links is split as a skewed key is.
    Rounds go on until the links form stars, about the logarithm of the longest path; each is
    kept in the checkpoint folder, and tasks are as many as the links counted are worth. Links with
    a null end or from a node to itself tie nothing.
    """
    ends = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    now = cut(ends.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b"))).distinct())
    state = _state(fitted(now, 0))
    while state[0]:
        now, rows = fitted(now, state[0]), 2 * state[0]
        both = now.select(F.inline(F.array(_row(u="a", v="b"), _row(u="b", v="a"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = fitted(both.join(low, "u"), rows).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        tied, moved = _row(a="m", b="b"), _row(a="m", b="a")
        small = F.when(F.col("a") != F.col("m"), F.array(tied, moved)).otherwise(F.array(tied))
        now = cut(fitted(fitted(large.join(least, "b"), rows).select(F.inline(small)).distinct(), rows))
        before, state = state, _state(fitted(now, 0))
        if state == before:
            break
    now = fitted(now, state[0])
    leaves, roots = now.select(_row(node="b", component="a").alias("r")), now.select(_row(node="a", component="a").alias("r"))
    return fitted(cut(leaves.unionByName(fitted(roots.distinct(), state[0]))), 2 * state[0]).select("r.*")


def _row(**columns: str) -> Column:
    return F.struct(*(F.col(c).alias(name) for name, c in columns.items()))


def _state(links: DataFrame) -> tuple[int, int | None]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x
