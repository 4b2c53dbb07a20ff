"""Decision trees as node tables: training, truncation, scoring.

``grow_trees`` trains many trees at once, level by level, as DataFrame aggregations.  A row is stored
once and carries the regions ("cells") it is in; trees of one fold that made the same splits so far share
their cells, so a grid of settings costs little more than one tree near the root.  Values are counted per cell and
column, each tree picks its best split from the running counts, and the rows' cells move on.  Held-out rows are
routed along with the training rows, so the node table holds the counts needed to score every fold without another pass.

There is no bound on the number of split points, levels or nodes: only settings and folds reach the driver.

A cell of fewer than ``LOCAL_CELL`` rows needs no more shuffles: its rows meet in a task, which grows all that is below
(``subtrees.py``).  Levels end when no larger cell is left.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from canvass.functions.ordered import running_totals
from canvass.operators import subtrees
from canvass.operators.binning import Layout, array_rows, make_layout, value_array
from canvass.session import discard, materialize, scratch_path, small_table, without_constraints, written
from canvass.spec import NODE_TABLE

cloudpickle.register_pickle_by_value(subtrees)  # the tasks need no copy of this package
NO_LIMIT = 2**31 - 1
CASE_NODES = 200  # above this a nested CASE outgrows one generated method
WALK_NODES = 1_000_000  # up to here a tree is sent to the tasks; beyond, rows and nodes meet in joins
#: Cells of more rows: running counts go digit by digit instead of through one window group.
WIDE_CELL = 1 << 20
#: Children of cells of more rows: the larger one is the parent less the smaller one.
DERIVE_CELL = 1 << 20
#: Cells of fewer rows are grown to the end in one task each.  If these cells are fewer than ``BUSY`` for each core, the trees of the larger
#: ones of them are dealt to a task for each criterion and kind of weights; trees that differ in their least leaf split much alike.
LOCAL_CELL, PARTED_CELL, BUSY = 1 << 20, 1 << 14, 2
ROOT = 1
_COUNTS = ("n0", "n1", "v0", "v1")
_KINDS = ("h0", "h1", "g0", "g1")
_NODE = ("tree", "node", "cell", "left_out", "depth", "parent_n", *_COUNTS)
_SETTING = ("criterion", "min_leaf", "w0", "w1")


@dataclass(frozen=True)
class TreeSetting:
    """Settings that change which split is best; depth and minimum split size do not."""

    criterion: str = "gini"
    balanced: bool = False
    min_leaf: int = 1

    def __post_init__(self):
        if self.criterion not in ("gini", "entropy"):
            raise ValueError(f"unknown criterion {self.criterion!r}")


@dataclass
class Forest:
    """Result of ``grow_trees``.

    ``nodes``: tree, node, depth, parent_n, n0, n1 (training rows per class), v0, v1
    (validation rows), feature, threshold, left, right, w0, w1 (class weights).
    """

    nodes: DataFrame
    trees: list[dict]
    layout: Layout
    levels: int = 0
    settings: list[TreeSetting] = field(default_factory=list)


def _impurity(a: str, b: str) -> str:
    """SQL of size times impurity of a node with class weights a and b."""
    def term(x: str) -> str:
        return f"if({x} > 0, -{x} * log2({x} / ({a} + {b})), 0D)"

    return f"if(criterion = 'gini', {a} + {b} - ({a} * {a} + {b} * {b}) / ({a} + {b}), {term(a)} + {term(b)})"


def grow_trees(
    df: DataFrame,
    numeric: Sequence[str],
    indicators: Sequence[str],
    settings: Sequence[TreeSetting],
    label: str = "label",
    fold: str | None = None,
    folds: int = 0,
    layout: Layout | None = None,
    **limits,
) -> Forest:
    """Grow one tree per setting (and per fold, leaving that fold out for validation).

    ``layout`` fixes the candidate splits; by default they come from ``df``.  ``limits``
    are ``max_depth`` and ``min_split``.
    """
    layout = layout or make_layout(df, numeric, indicators)
    keep = [F.col(label).alias("label"), *([F.col(fold).alias("fold")] if fold else [])]
    return grow_arrays(array_rows(df, layout, keep), layout, settings, folds, **limits)


def grow_arrays(
    rows: DataFrame,
    layout: Layout,
    settings: Sequence[TreeSetting],
    folds: int = 0,
    max_depth: int | None = None,
    min_split: int = 2,
) -> Forest:
    """``grow_trees`` from rows of (label, x), and (fold) when ``folds`` are left out.

    Deterministic: ties go to the first column and the lowest value.  Without ``max_depth`` it grows until nothing can be split.
    """
    spark = rows.sparkSession
    fold_number = F.col("fold") if folds else F.lit(-1)
    base = materialize(
        rows.select(F.monotonically_increasing_id().alias("row"), F.col("label").cast("int").alias("label"), fold_number.cast("int").alias("fold"), "x"),
        "tree-base",
    )

    # One root cell per fold, or a single one.  Class counts are folds x 2 numbers.
    cells = list(range(folds)) if folds else [0]
    sizes = {(r["fold"], r["label"]): r["count"] for r in base.groupBy("fold", "label").count().collect()}
    held = {c: [sizes.get((c, y), 0) for y in (0, 1)] for c in cells}
    classes = [sum(n for (_, y), n in sizes.items() if y == wanted) for wanted in (0, 1)]

    trees, roots = [], []
    for c in cells:
        n = [classes[y] - held[c][y] for y in (0, 1)]
        for s in settings:
            w = [sum(n) / (2 * k) if s.balanced and k else 1.0 for k in n]
            trees.append(dict(
                tree=len(trees), fold=c if folds else None, criterion=s.criterion,
                balanced=s.balanced, min_leaf=s.min_leaf, w0=w[0], w1=w[1],
            ))
            roots.append((len(roots), ROOT, c, c, 0, None, *n, *held[c], s.criterion, s.min_leaf, *map(float, w)))
    # settings x folds rows
    root_rows = small_table(
        spark, roots,
        "tree int, node bigint, cell bigint, left_out int, depth int, parent_n bigint, n0 bigint, n1 bigint, "
        "v0 bigint, v1 bigint, criterion string, min_leaf int, w0 double, w1 double",
    )

    limits = (min_split, NO_LIMIT if max_depth is None else max_depth)
    open_nodes = root_rows.where(_goes_on(F.col("n0"), F.col("n1"), F.col("depth"), *limits)).withColumn("local", _is_local(*_COUNTS))
    every_root = F.array(*[
        F.struct(F.lit(c).cast("bigint").alias("cell"), F.lit(c).alias("left_out"), F.lit(sum(classes) >= _local_limit()).alias("counted")) for c in cells])
    state, children, carried = base.withColumn("cells", every_root), None, None
    folder, ends, levels, paths, finished = scratch_path(spark, "tree-splits"), scratch_path(spark, "tree-ends"), 0, [], 0
    while True:
        size, local = open_nodes.agg(F.max(F.expr(" + ".join(_COUNTS))), F.count_distinct(F.when(F.col("local"), F.col("cell")))).first()
        if size is None:
            break
        # Every level is written: its plan does not grow with the depth, a lost executor
        # repeats one level at most, and joins see the true size of the node tables.
        fresh = []
        if children is not None:
            state, path = written(_route(state, base, children, layout), "tree-rows")
            fresh.append(path)
        if local:
            below = _finish(state, open_nodes.where("local"), local < BUSY * spark.sparkContext.defaultParallelism, layout, *limits)
            below.write.parquet(os.path.join(ends, f"level={levels}"))
            finished += 1
            open_nodes = open_nodes.where("NOT local")
            if size < _local_limit():
                discard(spark, *fresh)
                break
        counts, files = _histogram(state, layout, carried, children, size >= DERIVE_CELL)
        level = os.path.join(folder, f"level={levels}")
        with without_constraints(spark):  # costs are long expressions
            _best_splits(counts, open_nodes, layout, size >= WIDE_CELL).write.parquet(level)
        discard(spark, *paths)
        paths, levels = fresh + files, levels + 1
        carried = counts if size >= DERIVE_CELL else None
        children = _children(spark.read.parquet(level), *limits)
        open_nodes = children.where("goes_on")
    discard(spark, *paths)

    node_columns = ["tree", "node", "depth", "parent_n", *_COUNTS, "w0", "w1"]
    nodes = root_rows.select(*node_columns)
    if levels or finished:
        splits = [spark.read.parquet(f).drop("level") for f in [folder] * (levels > 0) + [ends] * (finished > 0)]
        if levels:
            _refuse_collisions(_children(splits[0], *limits))
        splits = splits[0] if len(splits) == 1 else splits[0].unionByName(splits[1])
        children = _children(splits, *limits)
        depths = (children.agg(F.max("depth")).first()[0] or 0) if finished else levels
        cut = layout.named(splits.select("tree", "node", "column", "value", "left", "right"))
        nodes = nodes.unionByName(children.select(*node_columns)).join(cut, ["tree", "node"], "left")
    else:
        depths = 0
        nodes = nodes.selectExpr("*", "CAST(NULL AS STRING) AS feature", "CAST(NULL AS DOUBLE) AS threshold", "CAST(NULL AS BIGINT) AS left", "CAST(NULL AS BIGINT) AS right")
    return Forest(materialize(nodes, "tree-nodes"), trees, layout, depths, list(settings))


def _goes_on(n0: Column, n1: Column, depth: Column, min_split: int, deepest: int) -> Column:
    return (n0 > 0) & (n1 > 0) & (n0 + n1 >= min_split) & (depth < deepest)


def _histogram(state: DataFrame, layout: Layout, carried: DataFrame | None, children: DataFrame | None, keep: bool) -> tuple[DataFrame, list[str]]:
    """(cell, column, value, h0, h1, g0, g1): training and held-out rows per class; and the paths of what was written.

    ``carried``: the counts of the level before, if large cells were among them.  Children that rows do not count
    for are their parent less their sibling.
    """
    kinds = {  # training rows per class, then held-out rows per class
        n: F.count_if((F.col("held") == out) & (F.col("label") == y)) for n, out, y in zip(_KINDS, (False, False, True, True), (0, 1, 0, 1))
    }
    entries = state.select(F.explode(F.filter("cells", lambda c: c["counted"])).alias("c"), "label", "fold", "x").select(
        F.col("c.cell").alias("cell"), (F.col("fold") == F.col("c.left_out")).alias("held"), "label", F.posexplode("x").alias("column", "value"))
    entries = entries.where(~layout.is_choice(F.col("column")) | (F.col("value") != 0))
    counts, files = entries.groupBy("cell", "column", "value").agg(*[k.alias(n) for n, k in kinds.items()]), []
    if carried is not None:
        counts, path = written(counts, "tree-counts")
        files.append(path)
        derived = children.where("derived").select("parent_cell", "sibling", F.col("cell").alias("larger")).distinct()
        place = [F.col("larger").alias("cell"), "column", "value"]
        whole = carried.join(derived.select(F.col("parent_cell").alias("cell"), "larger"), "cell").select(*place, *_KINDS)
        part = counts.join(derived.select(F.col("sibling").alias("cell"), "larger"), "cell").select(*place, *[(-F.col(n)).alias(n) for n in _KINDS])
        rest = whole.unionByName(part).groupBy("cell", "column", "value").agg(*[F.sum(n).alias(n) for n in _KINDS])
        counts = counts.unionByName(rest.where("h0 + h1 + g0 + g1 > 0"))
    if keep:
        counts, path = written(counts, "tree-histogram")
        files.append(path)
    return counts, files


def _best_splits(counts: DataFrame, open_nodes: DataFrame, layout: Layout, wide: bool) -> DataFrame:
    """Best split of each open node: the node with ``column``, ``value`` and the left counts."""
    numbers = counts.where(~layout.is_choice(F.col("column")) & ~F.isnan("value"))
    if wide:
        upto = running_totals(numbers, ["cell", "column"], "value", list(_KINDS))
        left = upto.select("cell", "column", "value", *[(F.col(k) + F.col(f"{k}_before")).alias(k) for k in _KINDS])
    else:
        # A cell has WIDE_CELL rows at most here, so a group has no more.
        order = Window.partitionBy("cell", "column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        left = numbers.select("cell", "column", "value", *[F.sum(k).over(order).alias(k) for k in _KINDS])
    # A chosen category goes right, so its left side is the rest of the node.
    chosen = counts.where(layout.is_choice(F.col("column")))
    sides = left.withColumn("rest", F.lit(False)).unionByName(chosen.withColumn("rest", F.lit(True)))
    node = ["tree", "node", "cell", *_COUNTS, *_SETTING]
    candidates = (
        sides.join(open_nodes.select(*node), "cell")
        .selectExpr(*node, "column", "value", *[f"if(rest, {n} - {k}, {k}) AS l_{n}" for n, k in zip(_COUNTS, _KINDS)])
        .where("l_n0 + l_n1 >= min_leaf AND n0 + n1 - l_n0 - l_n1 >= min_leaf")
    )
    parts = ("l_n0 * w0", "l_n1 * w1"), ("(n0 - l_n0) * w0", "(n1 - l_n1) * w1")
    cost = " + ".join(_impurity(f"({a})", f"({b})") for a, b in parts)
    pick = ", ".join(f"l_{n}" for n in _COUNTS)
    named = [_child_id(side).alias(side) for side in ("left", "right")]
    best = candidates.selectExpr("tree", "node", "column", "value", *[f"l_{n}" for n in _COUNTS], f"{cost} AS cost")
    best = best.groupBy("tree", "node").agg(F.expr(f"min_by(struct(column, value, {pick}), struct(cost, column, value))").alias("best"))
    return open_nodes.select(*_NODE, *_SETTING).join(best.select("tree", "node", "best.*"), ["tree", "node"]).select("*", *named)


def _local_limit() -> int:
    return min(LOCAL_CELL, WIDE_CELL, DERIVE_CELL)


def _is_local(*counts: str) -> Column:
    return F.expr(" + ".join(counts)) < _local_limit()


def _finish(state: DataFrame, open_nodes: DataFrame, parted: bool, layout: Layout, min_split: int, deepest: int) -> DataFrame:
    """All splits below the open nodes, from the rows of their cells; columns as of :func:`_best_splits`."""
    spark = state.sparkSession
    large = F.lit(parted) & (F.expr(" + ".join(_COUNTS)) >= PARTED_CELL)
    kind = 2 * (F.col("criterion") == "gini").cast("int") + (F.col("w0") == F.col("w1")).cast("int")
    nodes = open_nodes.withColumn("part", F.when(large, kind).otherwise(0))
    tops = nodes.select("cell", "part", F.struct(*_NODE, *_SETTING).alias("top"), F.lit(None).cast("int").alias("kind"),
                        F.lit(None).cast("array<double>").alias("x"))
    own = state.where("label IN (0, 1)").select(F.explode("cells").alias("c"), "label", "fold", "x").select(
        F.col("c.cell").alias("cell"), (F.col("label") + F.when(F.col("fold") == F.col("c.left_out"), 2).otherwise(0)).alias("kind"), "x")
    rows = own.join(nodes.select("cell", "part").distinct(), "cell").select("cell", "part", F.lit(None).cast(tops.schema["top"].dataType).alias("top"), "kind", "x")
    # More tasks than cores, as cells differ in size; one cell and part is in one task.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    dealt = tops.unionByName(rows).repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", F.col("kind").asc_nulls_first())
    schema = open_nodes.select(*_NODE, *_SETTING).schema
    for name, kind in [("column", "integer"), ("value", "double"), *[(f"l_{n}", "long") for n in _COUNTS], ("left", "long"), ("right", "long")]:
        schema = schema.add(name, kind)
    return dealt.mapInArrow(subtrees.finisher(len(layout.numeric), min_split, deepest, to_arrow_schema(schema)), schema)


def _child_id(side: str) -> Column:
    return F.xxhash64("node", F.lit(side))


def _children(splits: DataFrame, min_split: int, deepest: int) -> DataFrame:
    """The two child nodes of every split, with their counts and the way to get there.

    ``goes_on``: can be split again.  ``local``: so small that it is grown to the end at once.  ``counted``: rows count for the
    cell themselves; of two children of a large cell that both go on, the larger one is ``derived`` from parent and sibling instead.
    """
    counts = {left: [F.col(f"l_{n}") if left else F.col(n) - F.col(f"l_{n}") for n in _COUNTS] for left in (True, False)}
    rows = {left: sum(c[1:], c[0]) for left, c in counts.items()}
    depth = F.col("depth") + 1
    goes_on = {left: _goes_on(c[0], c[1], depth, min_split, deepest) for left, c in counts.items()}
    pair = (rows[True] + rows[False] >= DERIVE_CELL) & goes_on[True] & goes_on[False]
    larger = {True: rows[True] > rows[False], False: rows[False] >= rows[True]}
    local = {left: n < _local_limit() for left, n in rows.items()}
    derived = {left: pair & larger[left] & ~local[left] for left in (True, False)}

    def child(left: bool) -> Column:
        return F.struct(
            F.col("left" if left else "right").alias("node"), _child_cell(left).alias("cell"), _child_cell(not left).alias("sibling"),
            F.col("cell").alias("parent_cell"), "left_out", "column", "value", F.lit(left).alias("goes_left"), depth.alias("depth"),
            (F.col("n0") + F.col("n1")).alias("parent_n"), *[c.alias(n) for c, n in zip(counts[left], _COUNTS)],
            goes_on[left].alias("goes_on"), local[left].alias("local"), derived[left].alias("derived"),
            (~(local[left] | derived[left]) | derived[not left]).alias("counted"),
        )

    return splits.select("tree", *_SETTING, F.explode(F.array(child(True), child(False))).alias("c")).select("tree", *_SETTING, "c.*")


def _child_cell(left: bool) -> Column:
    return F.xxhash64("cell", "column", "value", F.lit(left))


def _refuse_collisions(children: DataFrame) -> None:
    """Cells are 64-bit hashes of the way to them; should two ways meet in one number, fail instead of mixing rows."""
    way = F.struct("parent_cell", "column", "value", "goes_left")
    if not children.groupBy("cell").agg(F.min(way).alias("a"), F.max(way).alias("b")).where("a <> b").isEmpty():
        raise RuntimeError("two tree regions got the same 64-bit number")


def _route(state: DataFrame, base: DataFrame, children: DataFrame, layout: Layout) -> DataFrame:
    """Rows with the cells they are in on the next level, one row each; rows of finished cells only drop out.

    The planner broadcasts the ways while their files are small.  Beyond that it is a shuffled join, where
    adaptive execution splits a cell that holds most of the rows.
    """
    ways = children.where("goes_on").groupBy(F.col("parent_cell").alias("cell"), "column", "value", "goes_left").agg(
        F.any_value(F.struct(F.col("cell"), "left_out", "counted")).alias("child"))
    here = F.try_element_at("x", F.col("column") + 1)
    stays_left = F.when(layout.is_choice(F.col("column")), here != F.col("value")).otherwise(here <= F.col("value"))
    moved = (
        state.select("row", "x", F.explode("cells.cell").alias("cell")).join(ways, "cell")
        .where(stays_left == F.col("goes_left"))
        # As many cells as there are settings and folds, at most.
        .groupBy("row").agg(F.collect_list("child").alias("cells"))
    )
    return base.join(moved, "row")


def node_table(forest: Forest, tree: int = 0) -> DataFrame:
    """One tree of a forest in the layout of a saved model."""
    a, b = F.col("n0") * F.col("w0"), F.col("n1") * F.col("w1")
    return forest.nodes.where(F.col("tree") == tree).select(
        "node", "depth", "feature", "threshold", (F.col("n0") + F.col("n1")).alias("n"),
        (a + b).alias("n_weighted"), F.coalesce(F.try_divide(b, a + b), F.lit(0.0)).alias("p1"), "parent_n", "left", "right",
    )


def is_reachable(max_depth: Column, min_split: Column) -> Column:
    """Node still exists after truncation.

    Counts shrink and depth grows along a path, so the parent decides for all ancestors.
    """
    return F.col("parent_n").isNull() | ((F.col("parent_n") >= min_split) & (F.col("depth") <= max_depth))


def is_inner(max_depth: Column, min_split: Column) -> Column:
    return F.col("feature").isNotNull() & (F.col("depth") < max_depth) & (F.col("n") >= min_split)


def truncate(nodes: DataFrame, max_depth: int | None = None, min_split: int = 2) -> DataFrame:
    """The tree that smaller limits would have grown.

    Splits are greedy and depend on the rows of the node only, so a tree with smaller
    limits is the deep tree with the nodes beyond them cut off.
    """
    limit, size = F.lit(NO_LIMIT if max_depth is None else max_depth), F.lit(min_split)
    inner = is_inner(limit, size)
    kept = {c: F.when(inner, F.col(c)) for c in ("feature", "threshold", "left", "right")}
    return nodes.where(is_reachable(limit, size)).withColumns(kept)


def numbered(nodes: DataFrame) -> DataFrame:
    """Node tables with heap numbers: the root is 1, the children of i are 2i and 2i + 1.  For trees of up to 60 levels."""
    keys = [c for c in ("tree",) if c in nodes.columns]
    step, found = nodes.where("depth = 0").select(*keys, "node", "left", "right", F.lit(1).cast("bigint").alias("number")), None
    for depth in range(nodes.agg(F.max("depth")).first()[0] + 1):
        found = step.select(*keys, "node", "number") if found is None else found.unionByName(step.select(*keys, "node", "number"))
        below = step.select(*keys, F.inline(F.array(
            F.struct(F.col("left").alias("node"), (2 * F.col("number")).alias("number")),
            F.struct(F.col("right").alias("node"), (2 * F.col("number") + 1).alias("number")))))
        step = nodes.where(F.col("depth") == depth + 1).select(*keys, "node", "left", "right").join(below, [*keys, "node"])
    return nodes.join(found, [*keys, "node"]).drop("node", "left", "right").withColumnRenamed("number", "node")


def save_tree(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    nodes.write.mode(mode).parquet(path)


def load_tree(spark: SparkSession, path: str) -> DataFrame:
    """A missing path raises Spark's ``AnalysisException``.  Older tables have heap numbers and no pointers."""
    nodes, inner = spark.read.schema(NODE_TABLE).parquet(path), F.col("feature").isNotNull()
    return nodes.withColumns({
        side: F.coalesce(side, F.when(inner, 2 * F.col("node") + i)) for i, side in enumerate(("left", "right"))})


def _root(rows: Sequence[dict]) -> int:
    children = {r[side] for r in rows for side in ("left", "right")}
    roots = [r["node"] for r in rows if r["node"] not in children]
    if len(roots) != 1:
        raise ValueError(f"the node table has {len(roots)} roots")
    return roots[0]


def _nested_case(by_node: dict, node: int, x: Column) -> Column:
    r = by_node[node]
    if r["left"] is None:
        return F.lit(float(r["p1"]))
    here = x[r["column"]]
    goes_left = here <= F.lit(float(r["threshold"])) if r["value"] is None else here != F.lit(float(r["value"]))
    return F.when(goes_left, _nested_case(by_node, r["left"], x)).otherwise(_nested_case(by_node, r["right"], x))


def _walk(by_node: dict, start: int, x: Column) -> Column:
    """Arrow-batched walk down a large tree: one array lookup per level for a whole batch."""
    place = {node: i for i, node in enumerate(by_node)}
    values = list(by_node.values())
    inner = np.array([r["left"] is not None for r in values])
    column = np.array([r["column"] if r["left"] is not None else 0 for r in values])
    threshold = np.array([r["threshold"] if r["left"] is not None else np.inf for r in values], float)
    chosen = np.array([np.nan if r["value"] is None else r["value"] for r in values], float)
    left, right = (np.array([place[r["node"] if r[side] is None else r[side]] for r in values]) for side in ("left", "right"))
    p1 = np.array([r["p1"] for r in values], float)
    root = place[start]

    @F.pandas_udf("double")
    def walk(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=float)
        x = np.stack(rows.to_numpy())
        at = np.full(len(x), root)
        active = np.flatnonzero(inner[at])
        while active.size:
            here = at[active]
            mine = x[active, column[here]]
            goes_left = np.where(np.isnan(chosen[here]), mine <= threshold[here], mine != chosen[here])
            at[active] = np.where(goes_left, left[here], right[here])
            active = active[inner[at[active]]]
        return pd.Series(p1[at])

    return walk(x)


def _by_levels(df: DataFrame, nodes: DataFrame, keep: Sequence[Column], x: str) -> DataFrame:
    """``keep`` columns and ``p``: rows and nodes meet level by level, rows that reach a leaf leave.

    No node reaches the driver or all tasks.  A level is written, so its plan does not grow with the depth.
    """
    spark = df.sparkSession
    nodes, paths = materialize(nodes, "tree-table"), []
    start = nodes.where("depth = 0").select(F.col("node").alias("_at"))  # one row
    state = df.select(F.struct(*keep).alias("_keep"), F.col(x).alias("_x")).join(F.broadcast(start), how="cross")
    folder, depth = scratch_path(spark, "tree-scores"), 0
    while True:
        level = nodes.where(F.col("depth") == depth).select(F.col("node").alias("_at"), "column", "value", "threshold", "p1", "left", "right")
        met = state.join(level, "_at")
        met.where("left IS NULL").select("_keep", F.col("p1").alias("p")).write.parquet(os.path.join(folder, f"level={depth}"))
        here = F.try_element_at("_x", F.col("column") + 1)
        goes_left = F.when(F.col("value").isNull(), here <= F.col("threshold")).otherwise(here != F.col("value"))
        state, path = written(met.where("left IS NOT NULL").select("_keep", "_x", F.when(goes_left, F.col("left")).otherwise(F.col("right")).alias("_at")), "tree-walk")
        discard(spark, *paths)
        paths, depth = [path], depth + 1
        if state.isEmpty():
            return spark.read.parquet(folder).select("_keep.*", "p")


def score_arrays(
    df: DataFrame, nodes: DataFrame, keep: Sequence[str], case_nodes: int = CASE_NODES, walk_nodes: int = WALK_NODES, x: str = "x",
) -> DataFrame:
    """``keep`` columns, ``p`` and ``prediction`` of rows whose values are in the array ``x``.

    ``nodes``: a node table with ``column``, and ``value`` where the test is for a category.  Up to ``walk_nodes``
    nodes are sent to the tasks; a larger tree is scored by joins, with equal results.
    """
    columns = [F.col(f"`{k}`") for k in keep]
    nodes = nodes.select("node", "depth", F.col("column").cast("int").alias("column"), "value", "threshold", "p1", "left", "right")
    rows = [r.asDict() for r in nodes.limit(walk_nodes + 1).collect()]
    if len(rows) > walk_nodes:
        out = _by_levels(df, nodes, columns, x)
    else:
        out = df.select(*columns, leaf_probability(rows, F.col(x), case_nodes).alias("p"))
    return out.withColumn("prediction", F.when(F.col("p") > 0.5, 1).otherwise(0))


def leaf_probability(rows: Sequence[dict], x: Column, case_nodes: int = CASE_NODES) -> Column:
    """Probability of a row under a collected tree, as a column over the array of its values."""
    by_node = {r["node"]: r for r in rows}
    return (_nested_case if len(rows) <= case_nodes else _walk)(by_node, _root(rows), x)


def score(df: DataFrame, nodes: DataFrame, keep: Sequence[str] | None = None, **limits) -> DataFrame:
    """Adds ``p`` and ``prediction`` (1 when p > 0.5, so a tie is class 0) to a table with one column per feature."""
    # Columns of ``df``, at most.
    used = sorted(r["feature"] for r in nodes.where("feature IS NOT NULL").select("feature").distinct().collect())
    place = F.array_position(F.array(*[F.lit(f) for f in used]).cast("array<string>"), F.col("feature")) - 1
    placed = nodes.withColumns({"column": F.when(F.col("feature").isNotNull(), place), "value": F.lit(None).cast("double")})
    names = list(df.columns if keep is None else keep)
    values = value_array([F.col(f"`{f}`") for f in used], []).alias("_values")
    return score_arrays(df.select(*[F.col(f"`{k}`") for k in names], values), placed, names, x="_values", **limits)
