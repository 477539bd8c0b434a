"""Groups of similar items from shared buckets: stars first, then only what they leave apart."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .runtime import cut, cut_fitted, fitted, release

Details = Callable[[DataFrame], DataFrame]
MayLink = Callable[[str, str], Column]
#: Members of a bucket that are compared in one task with as many others.
CHUNK = 2048
#: Members of a mixed bucket that all others are compared with in a round, the most rounds, and
#: the share of a round's pairs that must link for another.
CENTRES, ROUNDS, SHARE = 4, 4, 0.05
#: How many rows' work a pair is, with its details and its test.
PAIR = 8


def in_shared_buckets(items: DataFrame) -> DataFrame:
    """``items`` (key, id, ...) in buckets of two or more, with the bucket's ``size``.

    Sizes are counted before the shuffle and joined back, which splits very large buckets.
    """
    sizes = items.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return cut(items.join(sizes, "key"))


def groups(members: DataFrame, details: Details, near: MayLink, may_link: MayLink, traits: list[str]) -> DataFrame:
    """``node`` and ``component`` of items that link.

    ``members`` has key, id, size and ``traits``; ``may_link(x, y)`` rules out pairs by traits,
    whose columns are x.trait and y.trait; ``details`` gives ``id`` and more columns of some ids, from
    which ``near(x, y)`` tells whether two do link.
    A bucket's centre is the member whose buckets are the fullest, the likeliest original of a
    group of copies. First each item is paired with the fullest of its buckets' centres, then
    with those of the others that it is not connected to yet. Then, in buckets whose
    members are still in different components, a few other members serve as centres, new ones in
    each round while many of the pairs link: an item that links to part of a large component
    joins it by one of its pairs, not by all. Then all pairs across components are tested: those that
    have a partner by traits are found first, one row each, and only they get their details and
    are tested where they meet, each pair in the first bucket that both are in, so that no pair
    is written but those that link. Buckets meet in chunks of CHUNK members, so that one large
    bucket is the work of many tasks; the work still grows with the square of what shares a
    bucket and is not linked. ``id`` is a long. What has been counted is read in as many tasks as it is worth.
    """

    def confirm(pairs: DataFrame, n: int) -> tuple[DataFrame, int]:
        known = details(fitted(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * n))
        more = F.struct(*(c for c in known.columns if c != "id"))
        left, right = (known.select(F.col("id").alias(k), more.alias(v)) for k, v in (("a", "x"), ("b", "y")))
        met = fitted(fitted(pairs.join(left, "a"), PAIR * n).join(right, "b"), PAIR * n)
        return cut_fitted(met.where(near("x", "y")).select("a", "b"))

    spark, x = members.sparkSession, F.struct("id", *traits).alias("x")
    n = fitted(members, 0).count()
    members = fitted(members, n)
    busy = members.groupBy("id").agg(F.sum("size").alias("busy"))
    lead = fitted(members.join(busy, "id"), n).groupBy("key").agg(F.max(F.struct("busy", "id")).alias("l"))
    lead = fitted(lead, n).select("key", "l.busy", F.col("l.id").alias("lead"))
    # The centre's traits come with it through a join on its id.
    known = members.select("id", *traits).dropDuplicates(["id"])
    lead = fitted(lead.join(known.withColumnRenamed("id", "lead"), "lead"), n).select("key", "busy", F.struct(F.col("lead").alias("id"), *traits).alias("y"))
    star = fitted(members.select("key", x).join(lead, "key"), n).where((F.col("x.id") != F.col("y.id")) & may_link("x", "y"))
    star, n_star = cut_fitted(fitted(star.select(F.col("x.id").alias("id"), F.col("y.id").alias("centre"), "busy").distinct(), n))
    ends = [F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")]
    first = star.groupBy("id").agg(F.max(F.struct("busy", "centre")).getField("centre").alias("centre")).select(*ends)
    first, n_first = cut_fitted(fitted(fitted(first, n_star).distinct(), n_star))
    found = components(confirm(first, n_first)[0])
    release(spark)
    apart = fitted(star.join(found.select(F.col("node").alias("id"), F.col("component").alias("p")), "id", "left"), n_star)
    apart = fitted(apart.join(found.select(F.col("node").alias("centre"), F.col("component").alias("q")), "centre", "left"), n_star)
    apart = apart.where(F.coalesce("p", "id") != F.coalesce("q", "centre")).select(*ends).distinct()
    apart, n_apart = cut_fitted(fitted(apart.join(first, ["a", "b"], "left_anti"), n_star))
    if n_apart:
        found = _joined(found, *confirm(apart, n_apart))

    del star, first, apart
    left, n = _mixed(members, n, found, traits)
    release(spark)
    for number in range(ROUNDS):
        pairs = left.select("key", "part", x).join(_others(left, n, number, traits), "key")
        pairs = fitted(pairs, CENTRES * n).where((F.col("part") != F.col("other")) & may_link("x", "y"))
        pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        pairs, tested = cut_fitted(fitted(pairs, CENTRES * n))
        links, n_links = confirm(pairs, tested) if tested else (pairs, 0)
        found = _joined(found, links, n_links)
        few = n_links < SHARE * tested or not tested
        del pairs, links
        if few:
            break
        left, n = _mixed(left, n, found, traits)
        release(spark)

    left, n = _mixed(left, n, found, traits)
    left = left.withColumn("chunks", F.ceil(F.col("n_members") / CHUNK).cast("int"))
    release(spark)
    left = left.withColumn("at", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    each, item = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), F.struct("id", *traits)
    one = left.select("key", F.col("at").alias("i"), each.alias("j"), "part", item.alias("x"))
    other = left.select("key", each.alias("i"), F.col("at").alias("j"), F.col("part").alias("other"), item.alias("y"))
    at, apart = ["key", "i", "j"], (F.col("part") < F.col("other")) & may_link("x", "y")
    firsts, n_firsts = cut_fitted(_with_partner(one, other, at, apart))
    if not n_firsts:
        return found
    seconds, n_seconds = cut_fitted(_with_partner(other, firsts, at, apart))
    wanted = fitted(firsts.select("x.id").union(seconds.select("y.id")).distinct(), n_firsts + n_seconds)
    wanted, n_wanted = cut_fitted(wanted)
    buckets = fitted(members.join(wanted, "id", "left_semi").groupBy("id").agg(F.collect_list("key").alias("keys")), PAIR * n_wanted)
    known = fitted(details(wanted).join(buckets, "id"), PAIR * n_wanted)
    more = F.struct(*known.columns)
    sides = ((firsts, n_firsts, "x"), (seconds, n_seconds, "y"))
    firsts, seconds = (fitted(side.join(known.select(F.col("id").alias(f"{v}_id"), more.alias(f"{v}_more")), F.col(f"{v}.id") == F.col(f"{v}_id")), PAIR * m) for side, m, v in sides)
    here = firsts["key"] == F.array_min(F.array_intersect("x_more.keys", "y_more.keys"))
    linked = firsts.join(seconds, [firsts[c] == seconds[c] for c in at] + [apart & here & near("x_more", "y_more")])
    # Components are what is joined, so their pairs are enough, and few.
    return _joined(found, *cut_fitted(linked.select(F.col("part").alias("a"), F.col("other").alias("b")).distinct()))


def _mixed(members: DataFrame, n: int, found: DataFrame, traits: list[str]) -> tuple[DataFrame, int]:
    """The ``n`` ``members`` with their ``part``, in buckets (of ``n_members``) that hold several parts, and how many they are."""
    placed = fitted(members.select("key", "id", *traits).join(found.withColumnRenamed("node", "id"), "id", "left"), n)
    placed = placed.select("key", "id", *traits, F.coalesce("component", "id").alias("part"))
    several = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n_members")).where("low < high")
    several, _ = cut_fitted(fitted(several.select("key", "n_members"), n))
    return cut_fitted(fitted(placed.join(several, "key"), n))


def _others(left: DataFrame, n: int, number: int, traits: list[str]) -> DataFrame:
    """Up to CENTRES of a bucket's members (``n`` in all) ``y`` with their part ``other``: those nearest to random marks, new ones for each ``number``."""
    marks = [F.lit(random.Random(CENTRES * number + k).getrandbits(63)) for k in range(CENTRES)]
    nearest = left.groupBy("key").agg(*(F.min(F.col("id").bitwiseXOR(m)).alias(f"c{k}") for k, m in enumerate(marks)))
    ids = F.array_distinct(F.array(*(F.col(f"c{k}").bitwiseXOR(m) for k, m in enumerate(marks))))
    items = left.select("id", F.col("part").alias("other"), F.struct("id", *traits).alias("y")).dropDuplicates(["id"])
    return fitted(fitted(nearest, n).select("key", F.explode(ids).alias("id")).join(items, "id"), CENTRES * n).select("key", "other", "y")


def _with_partner(some: DataFrame, others: DataFrame, at: list[str], apart: Column) -> DataFrame:
    """Rows of ``some`` that meet one of ``others`` from which they are apart and that they may link to."""
    return some.join(others, [some[c] == others[c] for c in at] + [apart], "left_semi")


def _joined(found: DataFrame, more: DataFrame, n: int) -> DataFrame:
    """Components of what ``found`` has, and of ``n`` links (a, b)."""
    so_far = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
    return components(so_far.unionByName(more.select("a", "b"))) if n else found
