"""Prefix trie of conversations, rolled up by depth bands.

A node is a distinct sequence of first turns.  Its identity is a chain of 128-bit digests, one
link per turn, so that equal prefixes get equal names in any task.  A conversation's turns stream
through a task in order; only the names of ``band`` ancestors per level are held.

Subtree sums need every node to reach all of its ancestors.  A node of depth d would explode into
d rows, a round per level of depth would need d rounds.  Depth is cut into bands of height
``band`` instead, and the tops of bands into bands of their own, and so on: write the depth in base
``band``; the number of its trailing zeros is the node's level.

* Upwards: on each level, nodes explode to the ancestors of that level in the same band
  (``band - 1`` at most), and sums meet there.  After the last level the root's total is complete.
* Downwards: completed totals of band tops go to the nodes of the band above them (``band - 1``
  again), level by level.

So there are two rounds per digit of the greatest depth, whatever the depth, and a node explodes
into ``band - 1`` rows per round at most.  All sums are combined before the shuffle: a prefix that
every conversation shares is a few rows per task.

Null roles and texts count as empty.  Rows without a conversation id belong to no conversation
and are left out.  Equal turn numbers are ordered by role and text, null turn numbers come first.
Repeated rows are turns like any other.  Without conversations there are no nodes, not even the
root.  Columns besides ``conv_id``, ``turn``, ``role`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.store import Store

BAND = 16
#: Ids per piece of the list of a node's ends.
PIECE_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
ROOT_LEVEL = 99
_STEPS = ("conv_id long, node binary, parent binary, depth long, words long, ends boolean, level int, "
          "up array<binary>, below array<struct<level: int, node: binary>>")
_SUMS = ("n_leaves", "saved_tokens")


def numbered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, mark, words)``: turns in order from 1, a digest of role and text, words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    framed = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return turns.withColumn("place", F.row_number().over(order).cast("long")).select(
        "conv_id", "place", F.unhex(F.sha2(framed, 256)).alias("mark"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def with_shared_heads(own: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that start with the first turns of their group's first conversation.

    A conversation c takes h = crc32(c) % ``heads`` turns of c - c % ``group`` in place of its own
    first h.  ``own`` is a written table as of :func:`numbered`; the result has the same columns.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    own = own.withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads)
    kept = own.where("place > h OR conv_id = base")
    first = own.where((F.col("conv_id") == F.col("base")) & (F.col("place") < heads)).select("base", "place", "mark", "words")
    taken = own.where("conv_id <> base").select("conv_id", "base", "h").distinct().join(first, "base").where("place <= h")
    columns = ["conv_id", "place", "mark", "words"]
    return kept.select(columns).unionByName(taken.select(columns))


def _chain(band: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation and prefix, from turns sorted by conversation and place; a row of place 0 opens each."""
    names = ["conv_id", "node", "parent", "depth", "words", "ends", "level", "up", "below"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.binary()),
             pa.list_(pa.struct([("level", pa.int32()), ("node", pa.binary())]))]
    now, name, depth, waiting = None, b"", 0, None
    passed: list[deque] = []

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        out = []
        for conv, place, mark, words in zip(*(c.to_pylist() for c in batch.columns)):
            if place == 0:
                if waiting:
                    out.append(waiting)
                now, name, depth, passed = conv, b"", 0, [deque(maxlen=band)]
                parent, level, up, below = None, ROOT_LEVEL, [], []
            else:
                if conv != now:
                    raise ValueError("turns are not in order")
                out.append((*waiting[:5], False, *waiting[6:]))
                parent, depth = name, depth + 1
                level, rest = 0, depth
                while rest % band == 0:
                    level, rest = level + 1, rest // band
                if level == len(passed):
                    passed.append(deque([passed[-1][0]], maxlen=band))  # the root alone stands on a level that is new
                up = list(passed[level])[-(rest % band):]
                below = [{"level": j, "node": a} for j in range(level) for a in list(passed[j])[1 - band:]]
            name = hashlib.blake2b(name + mark, digest_size=16).digest() if place else bytes(16)
            for held in passed[: level + 1]:
                held.append(name)
            waiting = (conv, name, parent, depth, words, True, level, up, below)
        if out:
            yield packed(out)
    if waiting:
        yield packed([waiting])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's pieces joined by commas, from pieces sorted by node and place; holds one piece at a time."""
    now, running = None, None
    for batch in batches:
        done = []
        for node, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node == now:
                running.update(b"," + piece.encode())
                continue
            if running:
                done.append((now, running.hexdigest()))
            now, running = node, hashlib.sha256(piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["node", "ends_sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], names=["node", "ends_sha256"])


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(*[F.sum(s).alias(s) for s in _SUMS])


def rollup(nodes: DataFrame, store: Store, band: int = BAND) -> DataFrame:
    """``(node, n_leaves, saved_tokens)`` summed over subtrees.

    ``nodes``: written table of (node, depth, level, up, below) and the sums of each node alone.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    top = 0
    while band ** (top + 1) <= deepest:
        top += 1
    upward = []
    values = nodes.select("node", "level", "up", *_SUMS)
    for level in range(top + 1):
        if level:
            values = nodes.where(F.col("level") >= level).select("node", "level", "up").join(upward[-1], "node")
        targets = F.when(F.col("level") == level, F.concat(F.array("node"), "up")).otherwise(F.array("node"))
        upward.append(store.put(_added(values.select(F.explode(targets).alias("node"), *_SUMS)), f"up-{level}"))
    if not top:
        return upward[0]
    levels = nodes.select("node", "level")
    done = upward[top].join(levels.where(F.col("level") > top), "node").drop("level")
    for level in range(top, -1, -1):
        mine = upward[level].join(levels.where(F.col("level") == level), "node").select("node", *_SUMS)
        whole = done.join(nodes.where(F.col("level") > level).select("node", "below"), "node")
        sent = whole.select(F.explode(F.filter("below", lambda b: b["level"] == level)["node"]).alias("node"), *_SUMS)
        finished = store.put(_added(mine.unionByName(sent)), f"down-{level}")
        done = done.unionByName(finished)
    return done


def trie(turns: DataFrame, members: DataFrame, store: Store, band: int = BAND) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, place from 1, mark, words), one row each.

    ``members`` holds every conversation id once, turnless ones too.  Result: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``.  A node's last turn is turn ``depth`` of conversation ``conv_id``.
    """
    opened = members.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("words"))
    rows = opened.unionByName(turns.select("conv_id", "place", "mark", "words"))
    steps = store.put(rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(partial(_chain, band), _STEPS), "steps")
    nodes = steps.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"),
        *[F.any_value(c).alias(c) for c in ("parent", "depth", "words", "level", "up", "below")])
    # Whoever does not end in a node goes on below it.
    nodes = store.put(nodes.withColumns({
        "n_leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "nodes")
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece")
    pieces = steps.where("ends").groupBy("node", F.shiftright("conv_id", PIECE_BITS).alias("place")).agg(piece)
    ends = pieces.repartition("node").sortWithinPartitions("node", "place").select("node", "piece").mapInArrow(_digests, "node binary, ends_sha256 string")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.select("node", "parent", "conv_id", "depth", "n_convs").join(rollup(nodes, store, band), "node")
        .join(children, "node", "left").join(ends, "node", "left").join(parents, "parent", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    )


def prefix_trie(conversations: DataFrame, shared_heads: bool = True, band: int = BAND) -> DataFrame:
    """The trie of ``conversations`` (see :func:`trie`), with heads shared in groups or as they are."""
    store = Store(conversations.sparkSession, "trie")
    own = store.put(numbered(conversations), "own")
    turns = with_shared_heads(own) if shared_heads else own
    return trie(turns, own.select("conv_id").distinct(), store, band)
