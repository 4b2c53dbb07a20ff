"""SQL that grows decision trees by brute force: every value of every feature, level by level."""

from __future__ import annotations

from collections.abc import Sequence


def _impurity(a: str, b: str) -> str:
    entropy = " + ".join(f"CASE WHEN {x} > 0 THEN -({x}) * log2(({x}) / ({a} + {b})) ELSE 0 END" for x in (a, b))
    return f"CASE WHEN criterion = 'gini' THEN {a} + {b} - (({a}) * ({a}) + ({b}) * ({b})) / ({a} + {b}) ELSE {entropy} END"


def grown(
    source: str, numeric: dict[str, str], flags: dict[str, str], trees: Sequence[tuple[str, bool, int]], depth: int, choices: dict[str, str] | None = None,
) -> str:
    """CTEs from ``source`` (contact_id, label, ...) to ``nodes`` (tree, node, depth, n0, n1, w0, w1, parent_n, feature, threshold).

    ``numeric`` and ``flags``: feature names and expressions, in the order that decides ties.  ``trees``: criterion, balanced, least leaf.
    Missing numbers go right.  ``choices``: columns and expressions of categories; each but the first in order is a feature, and goes right.
    """
    features, choices = [*numeric, *flags], choices or {}
    start = len(features)
    values = [f"SELECT contact_id, {i} AS f, CAST({e} AS DOUBLE) AS value FROM {source}" for i, e in enumerate(numeric.values())]
    values += [f"SELECT contact_id, {i + len(numeric)}, CASE WHEN {e} THEN 1.0 ELSE 0.0 END FROM {source}" for i, e in enumerate(flags.values())]
    chosen = " UNION ALL ".join(f"SELECT contact_id, {start + i} AS f, '{c}' AS name, {e} AS category FROM {source}" for i, (c, e) in enumerate(choices.items()))
    if choices:
        values.append("SELECT contact_id, f, CAST(dense_rank() OVER (PARTITION BY f ORDER BY category) - 1 AS DOUBLE) FROM chosen")
    listed = ", ".join(f"({i}, '{c}', {str(b).lower()}, {m})" for i, (c, b, m) in enumerate(trees))
    parts = ([f"chosen AS ({chosen})"] if choices else []) + [
        f"long_rows AS MATERIALIZED ({' UNION ALL '.join(values)})",
        f"sizes AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM {source})",
        f"""trees AS MATERIALIZED (SELECT tree, criterion, min_leaf, CASE WHEN balanced THEN n / (2.0 * c0) ELSE 1.0 END::DOUBLE AS w0,
 CASE WHEN balanced THEN n / (2.0 * c1) ELSE 1.0 END::DOUBLE AS w1 FROM (VALUES {listed}) t(tree, criterion, balanced, min_leaf), sizes)""",
        f"s0 AS MATERIALIZED (SELECT tree, CAST(1 AS BIGINT) AS node, contact_id, label FROM trees, {source})",
        "t0 AS MATERIALIZED (SELECT tree, node, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM s0 GROUP BY ALL)",
    ]
    l0, l1, r0, r1 = "l0 * w0", "l1 * w1", "(n0 - l0) * w0", "(n1 - l1) * w1"
    for k in range(depth):
        parts += [
            f"""h{k} AS (SELECT tree, node, f, value, count(*) FILTER (label = 0) AS h0, count(*) FILTER (label = 1) AS h1
 FROM s{k} JOIN long_rows USING (contact_id) WHERE value IS NOT NULL GROUP BY ALL)""",
            f"""r{k} AS (SELECT tree, node, f, value, sum(h0) OVER o AS l0, sum(h1) OVER o AS l1 FROM h{k} WHERE f < {start} WINDOW o AS (PARTITION BY tree, node, f ORDER BY value)
 UNION ALL SELECT tree, node, f, value, n0 - h0, n1 - h1 FROM h{k} JOIN t{k} USING (tree, node) WHERE f >= {start} AND value > 0)""",
            f"""b{k} AS MATERIALIZED (SELECT tree, node, f, value FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY round({_impurity(l0, l1)} + {_impurity(r0, r1)}, 7), f, value) AS rk
 FROM r{k} JOIN t{k} USING (tree, node) JOIN trees USING (tree) WHERE l0 + l1 >= min_leaf AND n0 + n1 - l0 - l1 >= min_leaf AND n0 > 0 AND n1 > 0) WHERE rk = 1)""",
            f"""s{k + 1} AS MATERIALIZED (SELECT s.tree, s.node * 2 + CASE WHEN (f < {start} AND v.value <= b.value) OR (f >= {start} AND v.value <> b.value) THEN 0 ELSE 1 END AS node, contact_id, label
 FROM s{k} s JOIN b{k} b USING (tree, node) JOIN long_rows v USING (contact_id, f))""",
            f"t{k + 1} AS MATERIALIZED (SELECT tree, node, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM s{k + 1} GROUP BY ALL)",
        ]
    names = ", ".join(f"({i}, CAST(NULL AS DOUBLE), '{n}')" for i, n in enumerate(features))
    named = f"SELECT * FROM (VALUES {names}) x(f, value, feature)"
    if choices:
        named += " UNION ALL SELECT DISTINCT f, CAST(dense_rank() OVER (PARTITION BY f ORDER BY category) - 1 AS DOUBLE), concat('cat__', name, '_', category) FROM chosen"
    best = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(depth))
    parts += [
        f"counts AS ({' UNION ALL '.join(f'SELECT *, {k} AS depth FROM t{k}' for k in range(depth + 1))})",
        "followed AS (SELECT f, value, lead(value) OVER (PARTITION BY f ORDER BY value) AS nxt FROM (SELECT DISTINCT f, value FROM long_rows WHERE value IS NOT NULL))",
        f"""cuts AS (SELECT tree, node, feature, CASE WHEN followed.f >= {len(numeric)} THEN 0.5 WHEN nxt IS NULL THEN CAST('infinity' AS DOUBLE)
  WHEN isinf(b.value) OR isinf(nxt) THEN b.value ELSE (b.value + nxt) / 2 END AS threshold
 FROM ({best}) b JOIN followed ON b.f = followed.f AND b.value = followed.value JOIN ({named}) x ON x.f = followed.f AND coalesce(x.value, followed.value) = followed.value)""",
        """nodes AS (SELECT c.tree, c.node, c.depth, c.n0, c.n1, w0, w1, p.n0 + p.n1 AS parent_n, feature, threshold
 FROM counts c JOIN trees USING (tree) LEFT JOIN cuts USING (tree, node) LEFT JOIN counts p ON p.tree = c.tree AND p.node = c.node // 2 AND p.depth = c.depth - 1)""",
    ]
    return ",\n ".join(parts)


#: The columns of one tree, as of a saved model with heap numbers.
NODE_COLUMNS = """node, CAST(depth AS INT) AS depth, feature, round(threshold, 9) AS threshold, n0 + n1 AS n, round(n0 * w0 + n1 * w1, 9) AS n_weighted,
 round(n1 * w1 / (n0 * w0 + n1 * w1), 9) AS p1, parent_n"""
#: Rows per probability of the leaves.
LEAF_COUNTS = "round(n1 * w1 / (n0 * w0 + n1 * w1), 9) AS p, CAST(sum(n0 + n1) AS BIGINT) AS n"
#: Several trees; an endless threshold as a number.
SPLIT_COLUMNS = """tree, node, n0, n1, feature, CASE WHEN isinf(threshold) THEN CASE WHEN threshold > 0 THEN 1e300 ELSE -1e300 END ELSE threshold END AS threshold,
 round(n1 * w1 / (n0 * w0 + n1 * w1), 9) AS p1"""


def cut_counts(leaves: Sequence[int], depths: Sequence[int], sizes: Sequence[int]) -> str:
    """Of ``nodes``, one tree per leaf size: numbers of nodes and leaves under smaller limits."""
    return f"""SELECT min_leaf, max_depth, min_split, count(*) AS nodes, count(*) FILTER (NOT (feature IS NOT NULL AND depth < max_depth AND n0 + n1 >= min_split)) AS leaves,
 CAST(max(depth) AS INT) AS deepest
FROM nodes JOIN (SELECT tree, CAST(min_leaf AS INT) AS min_leaf FROM (VALUES {', '.join(f'({i}, {m})' for i, m in enumerate(leaves))}) l(tree, min_leaf)) USING (tree),
 (SELECT CAST(unnest([{', '.join(map(str, depths))}]) AS INT) AS max_depth), (SELECT CAST(unnest([{', '.join(map(str, sizes))}]) AS INT) AS min_split)
WHERE parent_n IS NULL OR (parent_n >= min_split AND depth <= max_depth) GROUP BY ALL"""
