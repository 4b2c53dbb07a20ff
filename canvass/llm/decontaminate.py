"""Documents that hold benchmark items.

Texts and items are compared in lower case, with ASCII punctuation as space.  Similarity is that
of weighted 5-word shingles (fewer words: one shingle): the sum of the smaller over the sum of the larger counts, each
times the shingle's weight, one over the number of different items that hold it; shingles that the item does not hold
weigh as much as its own do on average.  At least ``percent`` is a hit.

1. A window without any shingle of an item cannot be a hit.  At each place where a
   document has a shingle of an item, a window of the item's size is laid so that both agree there.
2. Windows and items get SimHash fingerprints of their words.  An index over eight blocks of
   eight bits finds *all* items of a window's size within ``RADIUS`` differing bits: of at most 23 differing
   bits, one block has two or fewer.
3. What is found is verified by the exact similarity; of the windows for an item the best counts, then the first.

Items are taken in blocks of about ``BLOCK_BYTES``, so what goes to the tasks has a fixed bound; documents are
read once per block.  Null or blank texts and items match nothing.  Repeated rows are treated alike; equal
items are all reported.  Columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.store import Store
from canvass.llm.words import U64, Words, signed, slices, words_of

SHINGLE, RADIUS, BLOCKS = 5, 23, 8
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 20
_NEAR = np.array([x for x in range(256) if bin(x).count("1") <= RADIUS // BLOCKS], np.int64)
HITS = "item_id long, first_word long, n_words long, similarity double"


def simhash(words: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fingerprints of word runs: the sign, bit by bit, of the sum over their words."""
    out = np.empty((len(start), BLOCKS), np.uint8)
    step = 2048
    for a in range(0, len(start), step):
        s, n = start[a:a + step], size[a:a + step]
        at = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
        bits = np.unpackbits(words.code[at].view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0)
        out[a:a + step] = np.packbits(2 * ones > n[:, None], axis=1)
    return out


def _shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with words; for each of their shingles the text's number among them, its place and code; the shingles' length by text."""
    full = np.flatnonzero(w.counts > 0)
    size, first = w.counts[full], w.first[:-1][full]
    span = np.minimum(size, SHINGLE)
    per_item = size - span + 1
    item = np.repeat(np.arange(len(full)), per_item)
    place = np.arange(per_item.sum()) - np.repeat(np.cumsum(per_item) - per_item, per_item)
    begin = first[item] + place
    return full, item, place, w.spans(begin, begin + span[item]), span


class Index:
    """Items of one block: shingles with their places, weights, and fingerprints by block."""

    def __init__(self, ids: list[int], texts: list[str], holders: dict[int, int] | None = None):
        """``holders``: for shingles of several different items of the whole benchmark, their number; counted here if not given."""
        w = words_of(pa.array(texts, pa.string()), "plain")
        full, item, place, code, span = _shingles(w)
        self.ids = np.array(ids, np.int64)[full]
        self.size = w.counts[full]
        first = w.first[:-1][full]
        self.counts = [Counter() for _ in full]
        for i, c in zip(item.tolist(), code.tolist(), strict=True):
            self.counts[i][c] += 1
        if holders is None:
            different = dict(zip(w.spans(first, first + self.size).tolist(), self.counts, strict=True))
            holders = Counter(c for items in different.values() for c in items)
        self.weight = {c: 1 / holders.get(c, 1) for items in self.counts for c in items}
        self.scale = [sum(self.weight[c] * k for c, k in items.items()) / items.total() for items in self.counts]
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place = code[order], item[order], place[order]
        self.lengths = np.unique(span)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(code >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.print = simhash(w, first, self.size)
        near = self.print[:, :, None].astype(np.int64) ^ _NEAR
        keys = self._key(self.size[:, None, None], np.arange(BLOCKS)[None, :, None], near)
        order = np.argsort(keys.ravel(), kind="stable")
        self.key, self.owner = keys.ravel()[order], np.broadcast_to(np.arange(len(full))[:, None, None], keys.shape).ravel()[order]

    @staticmethod
    def _key(size, block, byte):
        return (size * BLOCKS + block) * 256 + byte

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Window starts and sizes suggested by common shingles, each once."""
        starts, sizes = [], []
        for n in self.lengths:
            at = words.windows(int(n))
            code = words.spans(at, at + n)
            some = np.flatnonzero(self.filter[(code >> U64(64 - _FILTER_BITS)).astype(np.int64)])
            at, code = at[some], code[some]
            lo, hi = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
            times = hi - lo
            which = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
            fits = np.minimum(self.size[self.item[which]], SHINGLE) == n
            starts.append((np.repeat(at, times) - self.place[which])[fits])
            sizes.append(self.size[self.item[which]][fits])
            base = np.repeat(at, times)[fits]
            text = np.searchsorted(words.first, base, "right") - 1
            # A window that would reach over the text's ends is moved inside it.
            low, high = words.first[text], words.first[text + 1]
            starts[-1] = np.maximum(np.minimum(starts[-1], high - sizes[-1]), low)
        both = np.unique(np.stack([np.concatenate(starts), np.concatenate(sizes)]), axis=1) if starts else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def candidates(self, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item) of one size within the radius."""
        keys = self._key(size[:, None], np.arange(BLOCKS)[None, :], prints.astype(np.int64)).ravel()
        lo, hi = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
        times = hi - lo
        item = self.owner[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())]
        window = np.repeat(np.repeat(np.arange(len(size)), BLOCKS), times)
        pair = np.unique(window * len(self.ids) + item)
        window, item = pair // max(len(self.ids), 1), pair % max(len(self.ids), 1)
        near = np.bitwise_count(prints[window] ^ self.print[item]).sum(axis=1) <= RADIUS
        return window[near], item[near]

    def similarity(self, words: Words, start: int, end: int, item: int) -> float:
        n = min(end - start, SHINGLE)
        at = np.arange(start, end - n + 1)
        own = Counter(words.spans(at, at + n).tolist())
        other, weight, scale = self.counts[item], self.weight, self.scale[item]
        low = sum(weight[c] * min(k, own[c]) for c, k in other.items() if c in own)
        total = sum((weight[c] if c in other else scale) * k for c, k in own.items()) + sum(weight[c] * k for c, k in other.items())
        return low / (total - low)

    def hits(self, words: Words, percent: int) -> dict[int, list[tuple[int, int, int, float]]]:
        """For each text with hits: item, first word, number of words, similarity."""
        start, size = self.places(words)
        if not len(start):
            return {}
        text = np.searchsorted(words.first, start, "right") - 1
        end = np.minimum(start + size, words.first[text + 1])
        window, item = self.candidates(simhash(words, start, end - start), size)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for v, i in zip(window.tolist(), item.tolist(), strict=True):
            s = self.similarity(words, int(start[v]), int(end[v]), i)
            if s * 100 >= percent - 1e-9:
                here = (s, -int(start[v]), int(end[v] - start[v]))
                spot = (int(text[v]), i)
                if spot not in best or here > best[spot]:
                    best[spot] = here
        out: dict[int, list] = {}
        for (t, i), (s, at, n) in sorted(best.items()):
            out.setdefault(t, []).append((int(self.ids[i]), int(-at - words.first[t]), n, s))
        return out


def _found(index, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                hits = table.hits(words_of(batch.column(1).slice(a, b - a), "plain"), percent)
                rows = [(a + t, *h) for t, found in hits.items() for h in found]
                where, *rest = zip(*rows, strict=True) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))],
                    names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


def _clean(index, percent: int, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch in batches:
            for a, b in slices(batch.column(column)):
                hits = table.hits(words_of(batch.column(column).slice(a, b - a), "plain"), percent)
                yield batch.slice(a, b - a).take(pa.array([t for t in range(b - a) if t not in hits], pa.int64()))

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block, fingerprint of the item's words, shingle."""
    for batch in batches:
        for a, b in slices(batch.column(1)):
            w = words_of(batch.column(1).slice(a, b - a), "plain")
            full, item, _, code, _ = _shingles(w)
            first = w.first[:-1][full]
            text = signed(w.spans(first, first + w.counts[full]))
            block = batch.column(0).slice(a, b - a).to_numpy()[full]
            yield pa.RecordBatch.from_arrays([pa.array(block[item]), pa.array(text[item]), pa.array(signed(code))], names=["block", "item", "shingle"])


def _indexes(items: DataFrame) -> Iterator:
    """Broadcast indexes of the blocks of ``(item_id, text)``."""
    spark = items.sparkSession
    wanted = items.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    store = Store(spark, "leaks")
    wanted = store.put(wanted.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))), "items")
    held = wanted.select("block", "text").mapInArrow(_held, "block long, item long, shingle long").distinct()
    several = held.groupBy("shingle").agg(F.count_distinct("item").alias("n"), F.collect_set("block").alias("blocks")).where("n > 1")
    several = store.put(several, "several")
    for k in range(blocks):
        part = wanted.where(F.col("block") == k).orderBy("item_id", "text").toArrow()
        # At most the shingles of the block.
        known = several.where(F.array_contains("blocks", F.lit(k).cast("long"))).select("shingle", "n").toArrow()
        holders = dict(zip(known.column("shingle").to_numpy().astype(np.int64).view(U64).tolist(), known.column("n").to_pylist(), strict=True))
        index = Index(part.column("item_id").to_pylist(), part.column("text").to_pylist(), holders)
        if len(index.ids):
            yield spark.sparkContext.broadcast(index)


def leaks(documents: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, first_word, n_words, similarity)`` for each document and item it holds.  ``items``: ``(item_id, text)``."""
    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, {HITS}"
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = [rows.mapInArrow(_found(index, percent), schema) for index in _indexes(items)]
    return reduce(DataFrame.unionByName, found) if found else documents.sparkSession.createDataFrame([], schema)


def without_leaks(documents: DataFrame, items: DataFrame, percent: int = 80, text_col: str = "text") -> DataFrame:
    """Documents that hold no item, with all their columns; no row is moved."""
    for index in _indexes(items):
        documents = documents.mapInArrow(_clean(index, percent, documents.columns.index(text_col)), documents.schema)
    return documents
