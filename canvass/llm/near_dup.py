"""Near-duplicate documents: MinHash bands, odd sketches, exact verification, components.

* A document's set holds the fingerprints of its distinct 5-word shingles (A-Z folded); with
  fewer words it holds the whole sequence; without words it is empty and linked with nothing.
* Documents with equal sets form one class, whatever their number; only classes are compared.
* ``BANDS`` x ``ROWS`` MinHash samples give the bucket keys.  At a similarity of 0.85 a pair
  shares no key with probability (1 - 0.85^4)^24 = 2e-8.
* The samples are folded into an odd sketch: each flips one of ``SKETCH_BITS`` bits.  The
  population count of the XOR of two sketches estimates how many samples differ.  A candidate
  is dropped only if its estimate lies more than six standard deviations below the threshold.
* All other candidates are verified on the full sets, recomputed from the texts.
* Where a bucket does not end up in one component, its members are compared by prefixes: two sets
  of the wanted similarity share one of their ``n - ceil(percent / 100 * n) + 1`` first elements in
  any common order.  The order is by frequency, counted in ``CELLS`` cells, so its size is fixed;
  in a crowd of half-similar texts the first elements are what each has alone.

Null or blank text: empty set.  Repeated rows of a document are one document.  A null
``doc_id`` is kept apart: its component is null and it is kept.  Columns besides ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.linking import link
from canvass.llm.sieve import bitmap, marked
from canvass.llm.store import Store
from canvass.llm.words import U64, Words, mix, signed, slices, words_of

SHINGLE = 5
BANDS, ROWS, SKETCH_BITS = 24, 4, 512
SAMPLES = BANDS * ROWS
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, SAMPLES, dtype=U64) * U64(2) + U64(1)
SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"
CELLS = 1 << 20
#: Shingles per step, so that the arrays stay in a core's cache.
BLOCK = 1 << 16


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text."""
    at = words.windows(SHINGLE)
    codes = words.spans(at, at + SHINGLE)
    cut = np.searchsorted(at, words.first)
    sets = []
    for d, n in enumerate(words.counts):
        if n >= SHINGLE:
            sets.append(np.unique(codes[cut[d]:cut[d + 1]]))
        elif n:
            sets.append(words.spans(words.first[d:d + 1], words.first[d + 1:d + 2]))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """``SAMPLES`` minima for each set; sets are not empty."""
    out = np.empty((SAMPLES, len(sets)), U64)
    a = 0
    while a < len(sets):
        b, total = a, 0
        while b < len(sets) and (b == a or total + len(sets[b]) <= BLOCK):
            total += len(sets[b])
            b += 1
        flat = np.concatenate(sets[a:b])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[a:b - 1]])]).astype(np.int64)
        for k, m in enumerate(_MULTIPLIERS):
            out[k, a:b] = np.minimum.reduceat(flat * m, starts)
        a = b
    return out


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps as rows of 64-bit words."""
    samples, n = minima.shape
    bit = mix(minima + (np.arange(samples, dtype=U64) * U64(0x9E3779B97F4A7C15))[:, None]) % U64(SKETCH_BITS)
    flips = np.zeros((n, SKETCH_BITS), np.uint8)
    np.add.at(flips, (np.broadcast_to(np.arange(n), (samples, n)), bit.astype(np.int64)), 1)
    return np.packbits(flips & 1, axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts):
            sets = shingle_sets(words_of(texts.slice(a, b - a), "lower"))
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = sketches = np.zeros((0, 1), np.int64)
            keys: list = [None] * len(sets)
            drawn: list = [None] * len(sets)
            if full:
                minima = minhash([sets[i] for i in full])
                folded = np.zeros((BANDS, len(full)), U64)
                for r in range(ROWS):
                    folded = mix(folded * U64(31) + minima[r::ROWS])
                bands = signed(mix(folded + np.arange(BANDS, dtype=U64)[:, None])).T
                sketches = odd_sketch(minima)
                for j, i in enumerate(full):
                    keys[i], drawn[i] = bands[j], sketches[j]
            # Two independent sums over the set identify it.
            one = [int(mix(s).sum(dtype=U64)) if len(s) else 0 for s in sets]
            two = [int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                ids.slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(signed(np.array(one, U64))), pa.array(signed(np.array(two, U64))),
                pa.array(keys, pa.list_(pa.int64())), pa.array(drawn, pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            kept = []
            for a, b in slices(left):
                ones = shingle_sets(words_of(left.slice(a, b - a), "lower"))
                for c, d in slices(right.slice(a, b - a)):
                    twos = shingle_sets(words_of(right.slice(a + c, d - c), "lower"))
                    for i, y in enumerate(twos):
                        x = ones[c + i]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both and 100 * both >= percent * (len(x) + len(y) - both):
                            kept.append(a + c + i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])

    return run


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(1)):
            codes = np.concatenate(shingle_sets(words_of(batch.column(1).slice(a, b - a), "lower")))
            cells, n = np.unique(codes % U64(CELLS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(n)], names=["cell", "n"])


def _prefixes(percent: int, frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = frequency.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in slices(texts):
                keys, owners, sizes, places = [], [], [], []
                for i, s in enumerate(shingle_sets(words_of(texts.slice(a, b - a), "lower"))):
                    size = len(s) + 1 - -(-percent * len(s) // 100)
                    order = np.lexsort((s, counts[(s % U64(CELLS)).astype(np.int64)]))[:size]
                    keys.append(s[order])
                    owners.append(np.full(len(order), ids[a + i], np.int64))
                    sizes.append(np.full(len(order), len(s), np.int64))
                    places.append(np.arange(len(order)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(keys))), *(pa.array(np.concatenate(x)) for x in (owners, sizes, places))], names=["key", "id", "n", "place"])

    return run


def differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def sketch_limit(percent: int) -> int:
    """Differing bits beyond which a pair of the given similarity is out of the question."""
    share = percent / 100
    worst = SAMPLES * (1 - share) + 6 * math.sqrt(SAMPLES * share * (1 - share))
    # Each differing sample flips two bits; some flips cancel.
    flips = min(2 * worst, 2 * SAMPLES)
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    return math.ceil(mean + 6 * math.sqrt(SKETCH_BITS) / 4)


def near_duplicates(documents: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document.

    Linked: 100 * |A ∩ B| >= percent * |A ∪ B|.  ``component_id`` is the smallest id in reach.
    """
    spark = documents.sparkSession
    store = Store(spark, "near")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed_docs = store.put(texts.mapInArrow(_signatures, SIGNATURES), "signatures")
    some = signed_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n"),
        F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = store.put(classes, "classes")
    members = classes.select(F.explode("bands").alias("key"), "id")

    def side(name: str) -> DataFrame:
        return classes.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))

    def admissible(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differing(F.col("sa"), F.col("sb")) <= sketch_limit(percent))
        return both.where(near).select("a", "b")

    def texts_of(ids: DataFrame) -> DataFrame:
        near = marked(texts, "doc_id", store.put(bitmap(ids), "bits")).where("__hit").select("doc_id", "text")
        return store.put(near.join(ids, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"]), "texts")

    def refine(ids: DataFrame) -> DataFrame:
        wanted = texts_of(ids)
        cells = wanted.mapInArrow(_cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        frequency = np.zeros(CELLS, np.int64)
        frequency[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        return wanted.mapInArrow(_prefixes(percent, spark.sparkContext.broadcast(frequency)), "key long, id long, n long, place long")

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = texts_of(store.put(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "named"))
        return (
            pairs.join(wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb").mapInArrow(_similar(percent), "a long, b long")
        )

    # Where two sets first agree, what is left of both bounds what they share.
    room = (100 + percent) * F.least(F.col("n") - F.col("place"), F.col("x_n") - F.col("x_place")) >= percent * (F.col("n") + F.col("x_n"))
    alike = 100 * F.least("n", "x_n") >= percent * F.greatest("n", "x_n")
    roots = store.put(link(store.put(members, "members"), verify, refine, room & alike, store, admissible), "components")
    named = classes.select("set_a", "set_b", "id").join(roots, F.col("id") == F.col("node"), "left")
    named = store.put(named.select("set_a", "set_b", F.coalesce("root", "id").alias("root")), "classed")
    out = signed_docs.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns: that of the smallest id.

    Rows equal in id and text count as one; rows of one id with different texts go or stay together.  Documents without words, and those with a null id, are kept.
    """
    store = Store(documents.sparkSession, "near-out")
    found = store.put(near_duplicates(documents, percent, id_col, text_col).select("doc_id", "kept"), "found")
    gone = store.put(found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    bits = store.put(bitmap(gone.union(again)), "bits")
    rows = marked(documents, id_col, bits)
    # A null id has a place in the bitmap like any other, but equals none.
    hit = rows.where("__hit").join(gone, F.col(id_col) == F.col("__gone"), "left_anti").select(documents.columns)
    kept = hit.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
    return kept.unionByName(hit.where(F.col(id_col).isNull())).unionByName(rows.where("NOT __hit").select(documents.columns))
