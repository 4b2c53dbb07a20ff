"""Groups of similar items from shared bucket keys: candidate pairs, verification, components.

DataFrame operations only.  Pairs within a bucket are never listed in full:

1. In each bucket the member with the most company leads; every other member is paired with
   the leader alone, and the pairs are verified exactly.
2. Verified links join items to components.  A bucket whose members lie in one component needs
   no further work.
3. The members of the other buckets get finer keys, of which two similar items share one, or
   keep their keys, where the leader, who has met all, is left out.  Under each of these keys the largest component is
   the home; only members outside it are paired with members of other components, if the pair fits, and
   verified.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.store import Store, fingerprint


def components(edges: DataFrame, store: Store) -> DataFrame:
    """``(node, root)`` for the undirected edges ``(a, b)``; the root is the smallest node.

    Alternating large-star and small-star steps: a round halves distances, needs only minima
    per node (combined before the shuffle), and is written, so no lineage grows.
    """
    state = store.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = fingerprint(state)
    while mark[0]:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = store.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        # Large star: larger neighbours hang on the smallest node around.
        large = store.put(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = store.put(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        # Small star: smaller neighbours and the node itself hang on the smallest of them.
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = store.put(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        store.drop(state, low, large, least)
        state, before, mark = following, mark, fingerprint(following)
        if mark == before:
            break
    leaves = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def link(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame] | None, fits: Column,
    store: Store, admissible: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, details: DataFrame | None = None,
) -> DataFrame:
    """``(node, root)`` for the items linked through common keys.

    ``members``: written table ``(key, id)``, both long.  ``verify`` takes pairs ``(a, b)`` and
    returns those that are similar.  ``refine`` takes ids and returns finer keys ``(key, id, ...)``; ``fits``
    tells from the further columns, those of the second item with ``x_`` before their names,
    whether two items under one key may be similar.  ``admissible`` may drop pairs that cannot be.
    Without ``refine`` items keep their keys, and ``details`` ``(id, ...)`` has the further columns; there ``fits`` tells all that
    ``admissible`` does, and may read ``key``.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = store.put(sizes, "sizes")
    shared = store.put(members.join(sizes, "key"), "shared")
    store.drop(sizes)
    company = store.put(shared.groupBy("id").agg(F.sum("n").alias("company")), "company")
    ranked = shared.join(company, "id")
    leaders = store.put(ranked.groupBy("key").agg(F.max_by("id", F.struct("company", -F.col("id"))).alias("leader")), "leaders")
    star = store.put(shared.join(leaders, "key").where("id <> leader"), "star")
    store.drop(company, leaders)

    rows = star.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    pairs = store.put(admissible(rows), "pairs")
    edges = store.put(verify(pairs), "links")
    roots = store.put(components(edges, store), "roots")

    if refine is not None:
        placed, home = _homes(shared.select("key", "id"), roots, store)
        open_ids = store.put(placed.join(home, "key", "left_semi").select("id").distinct(), "open")
        store.drop(shared, star, placed, home)
        shared = store.put(refine(open_ids), "refined")
        placed, home = _homes(shared, roots, store)
    else:
        # Everyone has met the leader.
        store.drop(shared)
        shared = store.put(star.where("n > 2").select("key", "id"), "others")
        store.drop(star)
        placed, home = _homes(shared, roots, store)
    open_ = placed.join(home, "key")
    open_ = store.put(open_ if details is None else open_.join(details, "id"), "mixed")
    store.drop(shared, placed, home)
    outside = store.put(open_.where("root <> home").select(*[F.col(c).alias(f"x_{c}") for c in open_.columns if c != "home"]), "outside")
    # Two members outside the home meet once.
    once = (F.col("root") == F.col("home")) | (F.col("id") < F.col("x_id"))
    met = open_.join(outside, (F.col("key") == F.col("x_key")) & (F.col("root") != F.col("x_root")) & once & fits)
    rest = met.withColumnRenamed("x_id", "x").select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
    rest = rest.join(pairs, ["a", "b"], "left_anti")
    rest = store.put(rest if refine is None else admissible(rest), "rest")
    store.drop(open_, outside)
    return components(edges.unionByName(verify(rest)), store)


def _homes(members: DataFrame, roots: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Members with their components, and for each key with several components the most frequent one."""
    kept = members.columns
    placed = members.join(roots, F.col("id") == F.col("node"), "left")
    placed = store.put(placed.select(*kept, F.coalesce("root", "id").alias("root")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("held"))
    home = parts.groupBy("key").agg(F.max_by("root", F.struct("held", -F.col("root"))).alias("home"), F.count("*").alias("parts"))
    return placed, store.put(home.where("parts > 1").select("key", "home"), "home")
