"""The rest of a tree below a cell of bounded size, as array operations on the cell's rows.

Cells come as a stream sorted by cell, the open nodes of a cell before its rows; many small cells are grown together,
level by level.  Nodes of several trees with the same rows are a group: its values are counted once, costs are found once for each criterion
and weights, and its rows are held once until the trees split them differently.
Splits, ties and names follow the same rules as the levels of ``tree.py``, to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of cells taken up together; twice as many rows of groups are grown together, one group at least.
BATCH_ROWS = 1 << 18
#: Candidates whose costs are found at a time, so that the steps of a cost stay near the processor.
COST_BLOCK = 1 << 14
COUNTS = ("n0", "n1", "v0", "v1")
#: Whole numbers of a node, and its weights.
FIELDS = ("tree", "node", "cell", "left_out", "depth", "parent_n", *COUNTS, "min_leaf")
WEIGHTS = ("w0", "w1")


def _log(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of normal positive numbers by the steps of Java's StrictMath, so that equal costs stay equal."""
    bits = x.view(np.int64)
    high, low = bits >> 32, bits & 0xFFFFFFFF
    k, h = (high >> 20) - 1023, high & 0xFFFFF
    up = (h + 0x95F64) & 0x100000
    k = (k + (up >> 20)).astype(float)
    f = (((h | (up ^ 0x3FF00000)) << 32) | low).view(float) - 1.0
    s = f / (2.0 + f)
    z = s * s
    w = z * z
    odd = z * (6.666666666666735130e-01 + w * (2.857142874366239149e-01 + w * (1.818357216161805012e-01 + w * 1.479819860511658591e-01)))
    r = w * (3.999999999940941908e-01 + w * (2.222219843214978396e-01 + w * 1.531383769920937332e-01)) + odd
    k_high, k_low, half = k * 6.93147180369123816490e-01, k * 1.90821492927058770002e-10, 0.5 * f * f
    wide = k_high - ((half - (s * (half + r) + k_low)) - f)
    near = k_high - ((s * (f - r) - k_low) - f)
    tiny = f * f * (0.5 - 0.33333333333333333 * f)
    out = np.where(((h - 0x6147A) | (0x6B851 - h)) > 0, wide, near)
    return np.where(((2 + h) & 0xFFFFF) < 3, k_high - ((tiny - k_low) - f), out)


def _log2(x: np.ndarray) -> np.ndarray:
    return _log(x) / _log(np.array([2.0]))


def _impurity(a: np.ndarray, b: np.ndarray, gini: np.ndarray) -> np.ndarray:
    """Size times impurity of sides with class weights a and b."""
    out = a + b - (a * a + b * b) / (a + b)
    if not gini.all():
        def term(x: np.ndarray, total: np.ndarray) -> np.ndarray:
            return np.where(x > 0, -x * _log2(np.where(x > 0, x / total, 1.0)), 0.0)

        at = np.flatnonzero(~gini)
        a, b = a[at], b[at]
        out[at] = term(a, a + b) + term(b, a + b)
    return out


def _tally(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``size`` in order, and how often they occur."""
    if size <= 2 * len(keys):
        counts = np.bincount(keys, minlength=size)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(keys, return_counts=True)


def _name(node: np.ndarray, left: bool) -> np.ndarray:
    """The name of a child: a 64-bit hash of its parent's name and the side."""
    h = node.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 if left else 0x3C6EF372FE94F82A)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal keys the first one, in the order of the keys, and for each row the number of its keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges, one range after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def _best(nodes: dict, codes: np.ndarray, values: list, numeric: int, label: np.ndarray, row: np.ndarray, at: np.ndarray):
    """Column and code of the best split of each node from the training rows of its group; column -1 where there is none."""
    group = nodes["group"]
    count = int(group.max()) + 1
    whole = {n: np.empty(count, np.int64) for n in ("n0", "n1")}
    for n in whole:
        whole[n][group] = nodes[n]
    least = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(least, group, nodes["min_leaf"])
    # Groups with a criterion and weights; of these the ones with a least leaf are choices.
    kind, kind_of = _first_of(group, nodes["gini"], nodes["w0"], nodes["w1"])
    choice, choice_of = _first_of(nodes["min_leaf"], kind_of)
    choice_kind, choice_leaf = kind_of[choice], nodes["min_leaf"][choice]
    own, w0, w1, gini = group[kind], nodes["w0"][kind], nodes["w1"][kind], nodes["gini"][kind]
    best = np.full(len(choice), np.inf)
    column, code = np.full(len(choice), -1), np.zeros(len(choice), np.int64)
    before = {n: np.cumsum(whole[n]) - whole[n] for n in whole}
    label = label[row]
    for c, known in enumerate(values):
        size = len(known)
        keys, n = _tally((at * size + codes[c][row]) * 2 + label, count * size * 2)
        one, place = keys & 1, keys >> 1
        last = np.flatnonzero(np.append(place[1:] != place[:-1], True))
        upto = [np.cumsum(np.where(one == y, n, 0))[last] for y in (0, 1)]
        place = place[last]
        node = place // size
        here = place - node * size
        if c < numeric:
            l0, l1 = upto[0] - before["n0"][node], upto[1] - before["n1"][node]
            fits = ~np.isnan(known)[here]
        else:  # a chosen category goes right
            l0, l1 = (whole[x][node] - np.diff(u, prepend=0) for x, u in zip(("n0", "n1"), upto))
            fits = (known != 0)[here]
        r0, r1 = whole["n0"][node] - l0, whole["n1"][node] - l1
        smaller = np.minimum(l0 + l1, r0 + r1)
        fits = np.flatnonzero(fits & (smaller >= least[node]))
        if not len(fits):
            continue
        node, here, smaller, sides = node[fits], here[fits], smaller[fits], [u[fits] for u in (l0, l1, r0, r1)]
        # The candidates of a group for each of its kinds.
        cut = np.searchsorted(node, np.arange(count + 1))
        sizes = (cut[1:] - cut[:-1])[own]
        each, mine = _spread(cut[:-1][own], sizes), np.repeat(np.arange(len(kind)), sizes)
        cost = np.empty(len(each))
        for a in range(0, len(each), COST_BLOCK):
            i, k = each[a:a + COST_BLOCK], mine[a:a + COST_BLOCK]
            a0, a1, b0, b1 = (u[i] * w[k] for u, w in zip(sides, (w0, w1, w0, w1)))
            cost[a:a + COST_BLOCK] = _impurity(a0, a1, gini[k]) + _impurity(b0, b1, gini[k])
        here, smaller, begin = here[each], smaller[each], 0
        while begin < len(choice):
            end = begin + int(np.searchsorted(choice_leaf[begin:], choice_leaf[begin], "right"))
            wanted = np.full(len(kind), -1)
            wanted[choice_kind[begin:end]] = np.arange(begin, end)
            able = np.flatnonzero((smaller >= choice_leaf[begin]) & (wanted >= 0)[mine])
            begin = end
            if not len(able):
                continue
            place, low = wanted[mine[able]], cost[able]
            starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            lowest = np.minimum.reduceat(low, starts)
            hit = np.flatnonzero(low == np.repeat(lowest, np.diff(np.append(starts, len(place)))))
            hit = hit[np.append(True, place[hit][1:] != place[hit][:-1])]  # the lowest value
            place = place[hit]
            better = lowest < best[place]
            place, hit = place[better], able[hit[better]]
            best[place], column[place], code[place] = cost[hit], c, here[hit]
    return column[choice_of], code[choice_of]


def _rows_of(wanted: np.ndarray, count: int, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each wanted group and the places of these in ``wanted``, which is sorted and may have a group more than once."""
    start = np.searchsorted(wanted, np.arange(count + 1))
    times, rows, places = np.diff(start), [], []
    for i in range(int(times.max(initial=0))):
        own = at if times.min() > i else at[times[at] > i]
        rows.append(row if own is at else row[times[at] > i])
        places.append(start[own] + i)
    return (np.concatenate(rows), np.concatenate(places)) if rows else (row[:0], at[:0])


def _pieces(nodes: dict, row: np.ndarray, at: np.ndarray) -> list[tuple[dict, np.ndarray, np.ndarray]]:
    """Nodes and rows in pieces of about ``2 * BATCH_ROWS`` rows that do not cut a group."""
    if not len(nodes["tree"]):
        return []
    upto = np.cumsum(np.bincount(at, minlength=int(nodes["group"].max()) + 1))
    if len(row) <= 2 * BATCH_ROWS or len(upto) == 1:
        return [(nodes, row, at)]
    pieces, begin = [], 0
    while begin < len(upto):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 2 * BATCH_ROWS, "right")))
        mine, own = ((x >= begin) & (x < end) for x in (nodes["group"], at))
        part = {k: v[mine] for k, v in nodes.items()}
        part["group"] -= begin
        pieces.append((part, row[own], at[own] - begin))
        begin = end
    return pieces


def _grow(nodes: dict, codes: np.ndarray, values: list, numeric: int, kind: np.ndarray, row: np.ndarray, at: np.ndarray,
          min_split: int, deepest: int) -> Iterator[dict]:
    """Splits below the nodes, level by level.  ``row`` and ``at``: rows and the groups they are in."""
    label, held = kind & 1, kind > 1
    open_ = [(nodes, row, at)]
    while open_:
        nodes, row, at = open_.pop()
        training = ~held[row]
        column, code = _best(nodes, codes, values, numeric, label, row[training], at[training])
        found = column >= 0
        if not found.any():
            continue
        nodes, column, code = {k: v[found] for k, v in nodes.items()}, column[found], code[found]
        # Trees that split a group alike stay together.
        first, split = _first_of(nodes["group"], column, code)
        row, at = _rows_of(nodes["group"][first], int(at.max()) + 1, row, at)
        by, here = column[first][at], code[first][at]
        mine = codes[by, row]
        goes_left = np.where(by < numeric, mine <= here, mine != here)
        count = len(first)
        sides = np.bincount((at * 4 + kind[row])[goes_left], minlength=4 * count).reshape(count, 4)[split]
        left = {n: sides[:, i] for i, n in enumerate(COUNTS)}
        names = [_name(nodes["node"], True), _name(nodes["node"], False)]
        value = np.array([values[c][v] for c, v in zip(column[first], code[first])], float)[split]
        kept = {k: v for k, v in nodes.items() if k != "group"}
        yield {**kept, "column": column, "value": value, **{f"l_{n}": left[n] for n in COUNTS}, "left": names[0], "right": names[1]}
        # Children 2k and 2k + 1 of node k, as far as they go on; those of split k are the groups 2k and 2k + 1.
        two = {k: np.repeat(v, 2) for k, v in nodes.items()}
        two |= {"node": np.stack(names, 1).ravel(), "depth": two["depth"] + 1, "parent_n": two["n0"] + two["n1"],
                **{n: np.stack([left[n], nodes[n] - left[n]], 1).ravel() for n in COUNTS},
                "group": np.stack([2 * split, 2 * split + 1], 1).ravel()}
        n0, n1 = two["n0"], two["n1"]
        goes_on = (n0 > 0) & (n1 > 0) & (n0 + n1 >= min_split) & (two["depth"] < deepest)
        nodes = {k: v[goes_on] for k, v in two.items()}
        kept = np.zeros(2 * count, bool)
        kept[nodes["group"]] = True
        place = np.cumsum(kept) - 1
        at = at * 2 + ~goes_left
        mine = kept[at]
        nodes["group"] = place[nodes["group"]]
        open_ += _pieces(nodes, row[mine], place[at[mine]])


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The stream in tables of about ``BATCH_ROWS`` rows that do not cut a cell."""
    held, size, before = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(n).to_numpy() for n in ("cell", "part")]
        change = np.zeros(b.num_rows, bool)
        for i, k in enumerate(key):
            change[1:] |= k[1:] != k[:-1]
            change[0] |= before is not None and k[0] != before[i]
        starts, before = np.flatnonzero(change), [k[-1] for k in key]
        if len(starts) and size + starts[-1] >= BATCH_ROWS:
            cut = int(starts[-1])
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, size, b = [], 0, b.slice(cut)
        held, size = [*held, b], size + b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _splits_of(table: pa.Table, numeric: int, min_split: int, deepest: int) -> Iterator[dict]:
    change = np.zeros(table.num_rows, bool)
    for n in ("cell", "part"):
        k = table.column(n).to_numpy()
        change[1:] |= k[1:] != k[:-1]
    group, is_row = np.cumsum(change), pc.is_valid(table.column("kind")).to_numpy(zero_copy_only=False).astype(bool)
    rows, top = table.filter(pa.array(is_row)), table.filter(pa.array(~is_row)).column("top").combine_chunks()
    x = pc.list_flatten(rows.column("x")).to_numpy().reshape(rows.num_rows, -1) + 0.0  # -0.0 is 0.0
    values, codes = [], np.empty(x.shape[::-1], np.int32)
    for c in range(x.shape[1]):
        known, codes[c] = np.unique(x[:, c], return_inverse=True)
        values.append(known)
    kind = rows.column("kind").to_numpy().astype(np.int64)
    nodes = {f: pc.fill_null(top.field(f), -1).to_numpy(zero_copy_only=False).astype(np.int64) for f in FIELDS}
    nodes |= {f: top.field(f).to_numpy(zero_copy_only=False) for f in WEIGHTS}
    nodes["gini"] = pc.equal(top.field("criterion"), "gini").to_numpy(zero_copy_only=False)
    starts, ends = (np.searchsorted(group[is_row], group[~is_row], side) for side in ("left", "right"))
    first, nodes["group"] = _first_of(group[~is_row])
    sizes = (ends - starts)[first]
    # The rows of a cell and part, which all nodes of it share.
    for part, own, at in _pieces(nodes, _spread(starts[first], sizes), np.repeat(np.arange(len(first)), sizes)):
        yield from _grow(part, codes, values, numeric, kind, own, at, min_split, deepest)


def finisher(numeric: int, min_split: int, deepest: int, schema: pa.Schema) -> Callable:
    """For ``mapInArrow`` over (cell, part, top, kind, x) sorted by cell and part, nodes (``kind`` null) first.

    ``kind``: label, plus 2 for held-out rows.  Gives the splits of all nodes below in the columns of ``schema``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            for level in _splits_of(table, numeric, min_split, deepest):
                level["criterion"] = np.where(level.pop("gini"), "gini", "entropy").astype(object)
                arrays = [pa.array(level[f.name], f.type) if f.name != "parent_n" else
                          pa.array(level["parent_n"], f.type, mask=level["parent_n"] < 0) for f in schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run
