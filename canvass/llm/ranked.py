"""Ranked lexical search over a length-stratified index.

Terms are runs of letters and digits (A-Z folded) and of everything beyond ASCII.  A term that occurs
tf times in a document of normaliser m adds ``w * (10^9 tf div (1000 tf + 8 m))`` to its score, where
w depends on how many documents hold the term.  m depends on the document's length only.

* **Strata.**  Documents of equal m form a stratum, so within it a term's share depends on tf alone.  A
  stratum is dealt over tasks by a hash and stored in packets of at most ``PACKET`` terms (a longer
  document is a packet of its own); no group is gathered, whatever its size.
* **Postings** of a packet are sorted by term and tf: one run of documents for each (term, tf), whose impact is
  computed once.
* **Bounds.**  The highest tf of each term in a packet bounds every score in it; the highest bound of its packets
  bounds a stratum.  A first visit takes for each item the strata of highest bound, until they hold ``k`` documents.  The
  k-th best score found there is the item's threshold; of all other strata only those packets are visited whose bound
  reaches it.  Documents that could tie are visited, so the ranking is exact.
* **Items** are taken in blocks of about ``PAIRS`` (item, term) pairs, which also bounds what is sent to the tasks;
  the index is read once per block, and what it holds of the block's terms is kept for the visits.

Null or termless texts are in no packet and in no result.  Every row is a document of its own, repeated rows too; ties are in
order of ``doc_id``, a null id last.  Rows of one ``item_id`` are one item, with the terms of all of them.  Items without terms and empty
tables give no rows.  Columns besides id and text are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm.store import Store
from canvass.llm.words import slices, text_bytes
from canvass.session import small_table

#: Every ASCII character by itself: a class of single characters is one table look-up, one of ranges costs ten times as much.
TERM = "[^" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
UPPER = "".join(map(chr, range(65, 91)))
PACKET = 1 << 18
#: Terms of a stratum that go to one task.
DEALT = 1 << 22
PAIRS = 1 << 13
#: Entries of a dense matrix in a task.
TILE = 1 << 22
#: Up to so many terms of an item, sums of w * impact are exact in doubles: w < 2^15, impact < 2^20.
EXACT = 1 << 18
_RUNS = "run_term array<int>, run_tf array<int>, run_end array<int>, places array<int>"
PACKETS = f"m long, docs array<long>, terms array<string>, {_RUNS}"
HITS = f"m long, docs array<long>, terms array<int>, held array<int>, {_RUNS}"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0


@dataclass(frozen=True)
class Index:
    """Packets (see ``PACKETS``), the number of documents with a term, and of all their terms."""

    packets: DataFrame
    n_docs: int
    n_terms: int

    def save(self, path: str) -> None:
        self.packets.write.parquet(os.path.join(path, "packets"))
        small_table(self.packets.sparkSession, [(self.n_docs, self.n_terms)], "n_docs long, n_terms long").write.parquet(os.path.join(path, "totals"))


def load_index(spark: SparkSession, path: str) -> Index:
    totals = spark.read.parquet(os.path.join(path, "totals")).first()
    return Index(spark.read.schema(PACKETS).parquet(os.path.join(path, "packets")), totals["n_docs"], totals["n_terms"])


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a text column one after the other, and the place of each text's first one."""
    raw, offsets = text_bytes(column)
    folded = _FOLD[raw]
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = folded != 0
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] = inside[1:-1][edges]
    closes[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(opens)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(closes) + 1 - starts)]).astype(np.int64)
    data = folded[inside[1:-1]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data))
    return terms, np.searchsorted(starts, offsets)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32)))


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packet(m: int, ids: pa.Array, terms: pa.Array, first: np.ndarray) -> pa.RecordBatch:
    coded = terms.dictionary_encode()
    place = np.repeat(np.arange(len(ids)), np.diff(first))
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + place, return_counts=True)
    term, place = pair // len(ids), pair % len(ids)
    order = np.lexsort((tf, term))
    term, tf, place = term[order], tf[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    return pa.RecordBatch.from_arrays([
        pa.array([m], pa.int64()), _one(ids.cast(pa.int64())), _one(coded.dictionary.cast(pa.string())), _ints(term[starts]), _ints(tf[starts]),
        _ints(np.concatenate([starts[1:], [len(term)]])), _ints(place),
    ], names=["m", "docs", "terms", "run_term", "run_tf", "run_end", "places"])


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        strata = batch.column(0).to_numpy()
        for a, b in slices(batch.column(2)):
            terms, first = terms_of(batch.column(2).slice(a, b - a))
            i = 0
            while i < b - a:
                j = i + 1
                while j < b - a and strata[a + j] == strata[a + i] and first[j + 1] - first[i] <= PACKET:
                    j += 1
                yield _packet(int(strata[a + i]), batch.column(1).slice(a + i, j - i), terms.slice(first[i], first[j] - first[i]), first[i:j + 1] - first[i])
                i = j


def build_index(documents: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of all rows with a term; the packets are written to the shared folder."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(TERM)).cast("long")).where("n > 0")
    lengths = store.put(rows.groupBy("n").agg(F.count("*").alias("docs")), "lengths")
    n_docs, n_terms = lengths.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("n"))).first()
    if not n_docs:
        return Index(documents.sparkSession.createDataFrame([], PACKETS), 0, 0)
    # One row per length: as many as the longest text has terms, at most.
    strata = lengths.withColumn("m", F.expr(f"100 - 90 + (90 * n * {n_docs}L) div {n_terms}L"))
    room = strata.groupBy("m").agg(F.ceil(F.sum(F.col("docs") * F.col("n")) / DEALT).alias("parts"))
    dealt = rows.join(strata.join(room, "m").select("n", "m", "parts"), "n")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), "parts")).select("m", "doc_id", "text", "part")
    ordered = dealt.repartition("m", "part").sortWithinPartitions("m", "part").select("m", "doc_id", "text")
    return Index(store.put(ordered.mapInArrow(_packets, PACKETS), "packets"), n_docs, n_terms)


@dataclass(frozen=True)
class _Block:
    """Items of a block: their terms in one list, and (item, term) pairs sorted by item."""

    terms: list[str]
    item: np.ndarray
    term: np.ndarray
    n_items: int


def _matched(block):
    """What packets hold of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(block.value.terms, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                known = pc.index_in(batch.column(2)[i].values, value_set=wanted)
                if known.null_count == len(known):
                    continue
                known = pc.fill_null(known, -1).to_numpy()
                run_term, run_tf, run_end, places = (batch.column(c)[i].values.to_numpy() for c in (3, 4, 5, 6))
                size = np.diff(run_end, prepend=0)
                kept = known[run_term] >= 0
                mine, dense = np.unique(known[run_term[kept]], return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), _ints(mine), _ints(np.bincount(dense, size[kept], len(mine))),
                    _ints(dense), _ints(run_tf[kept]), _ints(np.cumsum(size[kept])), _ints(places[np.repeat(kept, size)]),
                ], names=["m", "docs", "terms", "held", "run_term", "run_tf", "run_end", "places"])

    return run


class _Packet:
    """A packet's matches, with the impact of each run."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.m = batch.column(0)[i].as_py()
        self.docs = batch.column(1)[i].values
        self.terms, self.run_term, run_tf, run_end, self.places = (batch.column(c)[i].values.to_numpy() for c in (2, 4, 5, 6, 7))
        self.size = np.diff(run_end, prepend=0)
        tf, which = np.unique(run_tf.astype(np.int64), return_inverse=True)
        self.impact = (1_000_000_000 * tf // (1000 * tf + 8 * self.m))[which]

    def bounds(self, block: _Block, weight: np.ndarray) -> np.ndarray:
        """Highest score an item could reach here."""
        most = np.zeros(len(weight), np.int64)
        np.maximum.at(most, self.terms[self.run_term], self.impact)
        return np.bincount(block.item, (most * weight)[block.term], block.n_items).astype(np.int64)

    def scores(self, block: _Block, weight: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, items, scores of documents by items) in tiles."""
        column = np.full(len(weight), -1)
        column[self.terms] = np.arange(len(self.terms))
        doc_tile = max(1, TILE // len(self.terms))
        term_of, impact = np.repeat(self.run_term, self.size), np.repeat(self.impact, self.size)
        for a in range(0, len(self.docs), doc_tile):
            b = min(a + doc_tile, len(self.docs))
            here = (self.places >= a) & (self.places < b)
            item_tile = max(1, TILE // max(len(self.terms), b - a))
            for c in range(0, len(items), item_tile):
                chosen = items[c:c + item_tile]
                row = np.full(block.n_items, -1)
                row[chosen] = np.arange(len(chosen))
                pairs = (row[block.item] >= 0) & (column[block.term] >= 0)
                kind = np.float64 if pairs.sum() <= EXACT or np.bincount(block.item[pairs]).max() <= EXACT else np.int64
                held, weights = np.zeros((b - a, len(self.terms)), kind), np.zeros((len(self.terms), len(chosen)), kind)
                held[self.places[here] - a, term_of[here]] = impact[here]
                weights[column[block.term[pairs]], row[block.item[pairs]]] = weight[block.term[pairs]]
                yield a, chosen, (held @ weights).astype(np.int64)


def _bounded(block, weight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packet = _Packet(batch, i)
                bound = packet.bounds(block.value, weight.value)
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([
                    pa.array(some.astype(np.int32)), pa.array(np.full(len(some), packet.m)), pa.array(bound[some]),
                    pa.array(np.full(len(some), len(packet.docs))),
                ], names=["item", "m", "bound", "docs"])

    return run


def _visited(block, weight, k, first, least, leading: bool):
    """Best ``k`` documents of each packet for each item that visits it.

    ``first``: items by stratum of the first visit.  The first visit takes those, the second all others whose
    bound reaches the item's threshold in ``least``; the task raises its thresholds by what it finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest, at_first = np.maximum(least.value, 1), first.value
        for batch in batches:
            for i in range(batch.num_rows):
                packet = _Packet(batch, i)
                planned = at_first.get(packet.m, np.zeros(0, np.int64))
                due = packet.bounds(block.value, weight.value) >= lowest
                if leading:
                    items = planned[due[planned]]
                else:
                    due[planned] = False
                    items = np.flatnonzero(due)
                if not len(items):
                    continue
                ident = pc.fill_null(packet.docs, np.iinfo(np.int64).max).to_numpy()
                found: list[tuple] = []
                for a, chosen, scores in packet.scores(block.value, weight.value, items):
                    for c in np.flatnonzero((scores >= lowest[chosen]).any(axis=0)):
                        item = chosen[c]
                        docs = np.flatnonzero(scores[:, c] >= lowest[item])
                        best = docs[np.lexsort((ident[a + docs], -scores[docs, c]))[:k]]
                        found.append((np.full(len(best), item), a + best, scores[best, c]))
                        if len(best) == k:
                            lowest[item] = scores[best[-1], c]
                if found:
                    item, doc, score = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item.astype(np.int32)), packet.docs.take(pa.array(doc)), pa.array(score)], names=["item", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: Index, ids: list, pairs: list, k: int, store: Store) -> DataFrame:
    """``(item, doc_id, score, rank)`` for the items of one block."""
    context = store.spark.sparkContext
    terms = sorted({t for _, t in pairs})
    number, place = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(ids)}
    coded = np.array(sorted((place[x], number[t]) for x, t in pairs), np.int64)
    block = context.broadcast(_Block(terms, coded[:, 0], coded[:, 1], len(ids)))
    hits = store.put(index.packets.mapInArrow(_matched(block), HITS), "hits")
    held = hits.select(F.inline(F.arrays_zip("terms", "held"))).groupBy("terms").agg(F.sum("held").alias("df")).collect()
    weights = np.zeros(len(terms), np.int64)
    for r in held:
        weights[r["terms"]] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r["df"] + 1)))
    weight = context.broadcast(weights)
    bounds = hits.mapInArrow(_bounded(block, weight), "item int, m long, bound long, docs long")
    strata = bounds.groupBy("item", "m").agg(F.max("bound").alias("bound"), F.sum("docs").alias("docs"))
    # One row per stratum: their number depends on the longest text, not on the rows.  A first visit is k strata at most.
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "m").rowsBetween(Window.unboundedPreceding, -1)
    planned: dict[int, list] = {}
    for r in strata.withColumn("before", F.coalesce(F.sum("docs").over(order), F.lit(0))).where(F.col("before") < k).collect():
        planned.setdefault(r["m"], []).append(r["item"])
    first = context.broadcast({m: np.array(sorted(i), np.int64) for m, i in planned.items()})
    schema = "item int, doc_id long, score long"
    least = np.zeros(len(ids), np.int64)
    leading = store.put(_best(hits.mapInArrow(_visited(block, weight, k, first, context.broadcast(least), True), schema), k), "leading")
    for r in leading.where(F.col("rank") == k).collect():
        least[r["item"]] = r["score"]
    others = hits.mapInArrow(_visited(block, weight, k, first, context.broadcast(least.copy()), False), schema)
    out = store.put(_best(leading.drop("rank").unionByName(others), k), "ranked")
    store.drop(hits, leading)
    return out


def search(index: Index, items: DataFrame, k: int, store: Store, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item, score above 0."""
    spark = items.sparkSession
    folded = F.translate(F.col(text_col), UPPER, UPPER.lower())
    terms = items.select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))).alias("term"))
    terms = store.put(terms.distinct(), "item-terms")
    blocks = -(-terms.count() // PAIRS) if index.n_docs else 0
    kind = f"item int, item_id {terms.schema['item_id'].dataType.simpleString()}"
    out = spark.createDataFrame([], f"{kind[10:]}, rank int, doc_id long, score long")
    for b in range(blocks):
        pairs = [tuple(r) for r in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        if pairs:
            ids = sorted({x for x, _ in pairs}, key=lambda x: (x is None, x))
            names = small_table(spark, list(enumerate(ids)), kind)
            ranked = _search_block(index, ids, pairs, k, store).join(names, "item")
            out = out.unionByName(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def top_documents(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index ``documents`` and rank them for each of ``items``."""
    store = Store(documents.sparkSession, "ranked")
    return search(build_index(documents, store), items, k, store)
