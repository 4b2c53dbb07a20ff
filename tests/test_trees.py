import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canvass.operators import grid, tree
from canvass.operators.evaluation import roc_auc
from canvass.operators.grid import Grid, best_candidate, fold_scores, rank_candidates


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows with a noisy rule over one numeric and two indicator features."""
    i = F.col("id")
    x = (i * 37 % 101).cast("double")
    a, b = (i % 2).cast("double"), (i % 3 == 0).cast("double")
    noise = F.pmod(F.xxhash64(i), F.lit(5)) == 0
    y = ((x > 50) & (a > 0)) | ((x <= 20) & (b > 0))
    return spark.range(600).select(
        "id", x.alias("x"), a.alias("a"), b.alias("b"), F.when(noise, ~y).otherwise(y).cast("int").alias("label"),
        (i % 3).cast("int").alias("fold"),
    ).cache()


def table(nodes):
    return sorted(
        (r["node"], r["depth"], r["feature"], r["threshold"], r["n"], round(r["p1"], 9), r["parent_n"]) for r in nodes.collect()
    )


def grown(rows, depth, split=2, leaf=1, criterion="gini"):
    forest = tree.grow_trees(rows, ["x"], ["a", "b"], [tree.TreeSetting(criterion, False, leaf)], max_depth=depth, min_split=split)
    return tree.node_table(forest)


def test_truncation_equals_refit(rows):
    deep = grown(rows, 5)
    assert table(tree.truncate(deep, max_depth=2)) == table(grown(rows, 2))
    assert table(tree.truncate(deep, min_split=150)) == table(grown(rows, 5, split=150))


def by_hand(data, depth=None, split=2, leaf=1, criterion="gini"):
    """The tree of (x values, label) rows by brute force, as leaf paths: (path of (column, threshold, side)) -> (n0, n1)."""
    values = [sorted({x[c] for x, _ in data if x[c] is not None}) for c in range(len(data[0][0]))]

    def size_impurity(rows):
        n = len(rows)
        ones = sum(y for _, y in rows)
        if criterion == "gini":
            return n - (ones**2 + (n - ones) ** 2) / n
        return -sum(k * math.log2(k / n) for k in (ones, n - ones) if k)

    def left(x, c, t):
        return x[c] is not None and x[c] <= t

    def grow(rows, path):
        ones, best = sum(y for _, y in rows), None
        if 0 < ones < len(rows) and len(rows) >= split and (depth is None or len(path) < depth):
            for c, known in enumerate(values):
                for v, following in zip(known, known[1:] + [math.inf]):
                    sides = [r for r in rows if left(r[0], c, v)], [r for r in rows if not left(r[0], c, v)]
                    if min(map(len, sides)) >= leaf:
                        cost = round(sum(map(size_impurity, sides)), 9)
                        if best is None or cost < best[0]:
                            middle = (v + following) / 2
                            best = cost, c, middle if v <= middle < following or following == math.inf else v, sides
        if best is None:
            return {path: (len(rows) - ones, ones)}
        _, c, t, sides = best
        return grow(sides[0], path + ((c, t, "l"),)) | grow(sides[1], path + ((c, t, "r"),))

    return grow(data, ())


def leaf_paths(nodes, names):
    by_node = {r["node"]: r for r in nodes.collect()}
    out, todo = {}, [(next(r for r in by_node.values() if r["depth"] == 0), ())]
    while todo:
        r, path = todo.pop()
        if r["feature"] is None:
            ones = round(r["p1"] * r["n"])
            out[path] = (r["n"] - ones, ones)
        else:
            at = (names.index(r["feature"]), r["threshold"])
            todo += [(by_node[r["left"]], path + ((*at, "l"),)), (by_node[r["right"]], path + ((*at, "r"),))]
    return out


@pytest.fixture(scope="module")
def fine(spark):
    """500 rows: a column without repeated values, one with infinities, one constant where it is not missing, a flag."""
    draw = random.Random(4)
    data = []
    for i in range(500):
        x = [round(draw.gauss(0, 1), 6), draw.choice([math.inf, -math.inf, 0.0, 1.0, 2.0]), draw.choice([None, 7.0]), float(draw.random() < 0.3)]
        signal = (x[0] > 0.2) + (x[1] > 1) + (x[2] is None) + x[3]
        data.append((x, int(signal + draw.random() > 1.9)))
    return data, spark.createDataFrame([(*x, y) for x, y in data], "a double, b double, c double, d double, label int").repartition(3).cache()


@pytest.mark.parametrize("criterion, limits", [("gini", {}), ("entropy", {"leaf": 4, "split": 12}), ("gini", {"depth": 3, "leaf": 30})])
@pytest.mark.parametrize("wide, derive", [(tree.WIDE_CELL, tree.DERIVE_CELL), (1, 20)])
def test_all_midpoints_against_brute_force(fine, monkeypatch, criterion, limits, wide, derive):
    """Also with totals digit by digit, and with larger siblings derived."""
    monkeypatch.setattr(tree, "WIDE_CELL", wide)
    monkeypatch.setattr(tree, "DERIVE_CELL", derive)
    data, frame = fine
    setting = tree.TreeSetting(criterion, False, limits.get("leaf", 1))
    forest = tree.grow_trees(frame, ["a", "b", "c"], ["d"], [setting], max_depth=limits.get("depth"), min_split=limits.get("split", 2))
    want = {tuple((c, 0.5 if c == 3 else t, s) for c, t, s in p): n for p, n in by_hand(data, criterion=criterion, **limits).items()}
    assert leaf_paths(tree.node_table(forest), ["a", "b", "c", "d"]) == want


@pytest.mark.parametrize("limit, batch", [(1 << 20, 1), (150, 60)])
def test_cells_grown_in_one_task_equal_levels(fine, monkeypatch, limit, batch):
    """Whole trees, or what is below small cells, in one task: the same nodes to the bit; whole trees need no level of their own."""
    frame = fine[1].withColumn("fold", F.pmod(F.xxhash64("a"), F.lit(2)).cast("int"))
    settings = [tree.TreeSetting("gini", True, 1), tree.TreeSetting("entropy", False, 4)]
    levels = []
    monkeypatch.setattr(tree, "_best_splits", lambda *a, real=tree._best_splits: levels.append(1) or real(*a))

    def paths():
        forest = tree.grow_trees(frame, ["a", "b", "c"], ["d"], settings, fold="fold", folds=2, max_depth=5)
        nodes = {(r["tree"], r["node"]): r.asDict() for r in forest.nodes.collect()}
        todo, out = [(r, "") for r in nodes.values() if r["depth"] == 0], {}
        while todo:
            r, path = todo.pop()
            out[r["tree"], path] = [r[c] for c in sorted(r) if c not in ("node", "left", "right")]
            todo += [(nodes[r["tree"], r[s]], path + s[0]) for s in ("left", "right") if r["feature"] is not None]
        assert len(out) == len(nodes)
        return out, forest.levels

    monkeypatch.setattr(tree, "LOCAL_CELL", 0)
    want, deep = paths(), len(levels)
    levels.clear()
    monkeypatch.setattr(tree, "LOCAL_CELL", limit)
    monkeypatch.setattr(tree, "PARTED_CELL", 100)
    monkeypatch.setattr(tree.subtrees, "BATCH_ROWS", batch)
    assert paths() == want
    assert len(levels) == 0 if limit > 500 else 0 < len(levels) < deep


@pytest.mark.parametrize("batch", [1 << 18, 3])
def test_trees_share_rows_until_they_split_differently(monkeypatch, batch):
    """All settings together split as each one alone, and take fewer rows in hand than these do."""
    subtrees, draw = tree.subtrees, np.random.default_rng(5)
    monkeypatch.setattr(subtrees, "BATCH_ROWS", batch)
    size, seen, best = 400, [], subtrees._best
    monkeypatch.setattr(subtrees, "_best", lambda *a: seen.append(len(a[5])) or best(*a))
    x = np.stack([draw.integers(0, 9, size), np.where(draw.random(size) < 0.1, np.nan, draw.random(size).round(2)), draw.integers(0, 3, size)], 1).astype(float)
    kind = (draw.random(size) < 0.2 + 0.06 * x[:, 0]) + 2 * (draw.random(size) < 0.1)
    n = [int((kind == k).sum()) for k in range(4)]
    fields = [pa.field(f, pa.int64()) for f in subtrees.FIELDS] + [pa.field(f, pa.float64()) for f in subtrees.WEIGHTS] + [pa.field("criterion", pa.string())]
    tops = [dict(zip(subtrees.FIELDS, (0, 1, 7, 0, 0, None, *n, leaf))) | {"w0": w, "w1": 1.0, "criterion": c} for c in ("gini", "entropy") for w in (1.0, 0.6) for leaf in (1, 2, 4, 8)]
    tops = [t | {"tree": i} for i, t in enumerate(tops)]

    def splits(tops):
        count = len(tops)
        table = pa.table({
            "cell": np.full(count + size, 7), "part": np.zeros(count + size, int), "top": pa.array(tops + [None] * size, pa.struct(fields)),
            "kind": pa.array([None] * count + kind.tolist(), pa.int32()), "x": pa.array([None] * count + x.tolist(), pa.list_(pa.float64()))})
        out = []
        for level in subtrees._splits_of(table, 2, 2, 60):
            out += zip(*(level[k].tolist() for k in ("tree", "node", "depth", "column", "value", "l_n0", "l_n1", "l_v0", "l_v1", "n0", "n1", "left", "right")))
        return sorted(map(str, out))

    together, rows = splits(tops), sum(seen)
    seen.clear()
    assert together == sorted(s for t in tops for s in splits([t])) and len(together) > 16 * 20
    assert rows < 0.7 * sum(seen)


def test_a_chain_beyond_64_levels(spark):
    """Every split takes one value off: a tree of 65 levels and more is searched and scored."""
    levels = 66
    data = spark.createDataFrame(
        [(1000 * i + k, float(i), i % 2) for i in range(levels + 1) for k in range(1 + 3 * (levels - i))], "id long, x double, label int").coalesce(1).cache()
    forest = grid.search(data, "id", ["x"], [], Grid((False,), ("gini",), (None,), (1,), (2,)), folds=2)[1]
    nodes = tree.node_table(forest)
    assert nodes.agg(F.max("depth")).first()[0] > 60
    walk = tree.score(data, nodes, keep=["id"], case_nodes=0).orderBy("id").collect()
    assert walk == tree.score(data, nodes, keep=["id"], walk_nodes=1).orderBy("id").collect()


def test_leaf_size(rows):
    nodes = grown(rows, 3, leaf=20)
    assert min(r["n"] for r in nodes.collect()) >= 20


def test_case_and_walk_agree_and_a_tie_is_class_zero(rows, spark):
    nodes = grown(rows, 4, criterion="entropy")
    a = tree.score(rows, nodes, keep=["id"]).orderBy("id").collect()
    b = tree.score(rows, nodes, keep=["id"], case_nodes=0).orderBy("id").collect()
    assert a == b == tree.score(rows, nodes, keep=["id"], walk_nodes=3).orderBy("id").collect()
    single = spark.createDataFrame([(1, 0, None, None, 2, 2.0, 0.5, None, None, None)], tree.NODE_TABLE)
    assert {r["prediction"] for r in tree.score(rows, single).collect()} == {0}


def test_fold_scores_equal_separate_fits(rows):
    grid = Grid(balanced=(False,), criterion=("gini",), max_depth=(2,), min_leaf=(5,), min_split=(2,))
    forest = tree.grow_trees(rows, ["x"], ["a", "b"], grid.settings(), fold="fold", folds=3, max_depth=2)
    scores = {(r["fold"], r["part"]): r["auc_roc"] for r in fold_scores(forest, grid).collect()}
    assert len(scores) == 6
    for fold in range(3):
        one = tree.grow_trees(
            rows.where(F.col("fold") != fold), ["x"], ["a", "b"], grid.settings(), max_depth=2, layout=forest.layout
        )
        held = tree.score(rows.where(F.col("fold") == fold), tree.node_table(one))
        assert scores[fold, "test"] == pytest.approx(roc_auc(held, few_scores=True).first()["auc_roc"])


def test_ranking_prefers_the_first_of_equals(spark):
    scores = spark.createDataFrame(
        [(c, f, p, s) for c, s in ((0, 0.6), (1, 0.8), (2, 0.8)) for f in (0, 1) for p in ("train", "test")],
        "candidate int, fold int, part string, auc_roc double",
    )
    ranked = rank_candidates(scores)
    assert {r["candidate"]: r["rank_test_score"] for r in ranked.collect()} == {0: 3, 1: 1, 2: 1}
    assert best_candidate(ranked).first()["candidate"] == 1
    assert len(Grid().candidates()) == 320


@pytest.fixture(scope="module")
def gaps(rows):
    """The same rows, a third of them without x, and some with NaN."""
    x = F.when(F.col("id") % 3 == 1, None).when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("x"))
    return rows.withColumn("x", x).withColumn("label", F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("label"))).cache()


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_missing_values_split_and_score(gaps, depth):
    nodes = grown(gaps, depth)
    by_node = {r["node"]: r for r in nodes.collect()}
    for r in by_node.values():
        inner = r["left"] in by_node
        assert inner == (r["right"] in by_node) == (r["feature"] is not None)
        if inner:
            assert r["threshold"] is not None and r["n"] == by_node[r["left"]]["n"] + by_node[r["right"]]["n"]
    # Rescoring finds as many rows, and the class share, of each leaf.
    leaves = [(round(r["p1"], 9), r["n"]) for k, r in by_node.items() if r["feature"] is None]
    want = {p: sum(n for q, n in leaves if q == p) for p, _ in leaves}
    for how in ({}, {"case_nodes": 0}, {"walk_nodes": 1}):
        got = tree.score(gaps, nodes, keep=["id"], **how).groupBy(F.round("p", 9).alias("p")).count().collect()
        assert {r["p"]: r["count"] for r in got} == want


def test_fold_scores_with_missing_values(gaps):
    grid = Grid(balanced=(False,), criterion=("entropy",), max_depth=(4,), min_leaf=(2,), min_split=(2,))
    forest = tree.grow_trees(gaps, ["x"], ["a", "b"], grid.settings(), fold="fold", folds=3, max_depth=4)
    scores = {(r["fold"], r["part"]): r["auc_roc"] for r in fold_scores(forest, grid).collect()}
    for fold in range(3):
        one = tree.grow_trees(
            gaps.where(F.col("fold") != fold), ["x"], ["a", "b"], grid.settings(), max_depth=4, layout=forest.layout
        )
        held = tree.score(gaps.where(F.col("fold") == fold), tree.node_table(one))
        assert scores[fold, "test"] == pytest.approx(roc_auc(held, few_scores=True).first()["auc_roc"])


@pytest.mark.parametrize("name", ["grid_search", "holdout_evaluation"])
def test_registered_searches_are_full(spark, monkeypatch, name):
    """320 candidates on 10 folds reach the search."""
    from canvass.catalog.queries import REGISTRY
    from canvass.plans import jobs

    class Reached(Exception):
        pass

    def search(rows, key, layout, asked, folds=None, **other):
        assert len(asked.candidates()) == 320 and asked == grid.Grid() and folds == 10
        raise Reached

    monkeypatch.setattr(grid, "search_arrays", search)
    monkeypatch.setattr(jobs, "search_arrays", search)
    with pytest.raises(Reached):
        REGISTRY[name](spark, "/root/testdata/sf0.001")


def test_the_training_part_is_encoded_from_written_rows(spark, monkeypatch):
    """The view's expressions are not repeated in every indicator: what is encoded reads no table of the warehouse."""
    from canvass.catalog import queries

    read, put = {}, queries.materialize

    def noted(df, label):
        read[label] = df.inputFiles()
        return put(df, label)

    monkeypatch.setattr(queries, "materialize", noted)
    _, train = queries._train_part(spark, "/root/testdata/sf0.001")
    assert train.count() > 0 and read["train"]
    assert not [f for f in read["train"] if "/testdata/" in f]
