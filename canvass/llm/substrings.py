"""Removal of long word sequences that occur more than once in the corpus.

A window is ``size`` words in a row within one document.  Each word covered by a window whose
words also start anywhere else, in the same document included, is removed.  Windows are judged
on the input.

``recompress.groups`` deals the windows of a document into groups by anchor; equal windows have
equal anchors.  Spark then

1. counts anchors over the corpus: an anchor met once has only windows met once;
2. counts, for the other anchors, the whole word run of each group: if a run is met again, all
   its windows are repeated, and none is looked at;
3. compares single windows only where one anchor stands in different runs, one copy of each run.

So copies are never expanded into windows, and what is shuffled is about a tenth of the words.

Results: a null text has no words.  Each row counts as a document of its own, also if an equal
row exists.  A document shorter than a window keeps its words.  Columns besides id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.recompress import groups
from canvass.llm.sieve import bitmap, marked
from canvass.llm.store import Store
from canvass.llm.words import slices, signed, words_of

WINDOW = 35
_RESULT = ["doc_id", "n_words", "n_removed", "kept_text"]


def _lists(values: np.ndarray, text: np.ndarray, n: int) -> pa.ListArray:
    ends = np.searchsorted(text, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _parsed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                words = words_of(texts.slice(a, b - a))
                g = groups(words, size)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(words.counts, pa.int64()),
                    _lists(signed(g.key), g.text, b - a), _lists(signed(g.whole), g.text, b - a),
                ], names=["doc_id", "n_words", "key", "whole"])

    return run


def _windows(size: int):
    """Single windows of the wanted groups of a document: ``(key, window, whole)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                words = words_of(texts.slice(a, b - a))
                g = groups(words, size)
                keep = np.zeros(len(g.key), bool)
                cut = np.searchsorted(g.text, np.arange(b - a + 1))
                whole = signed(g.whole)
                for d in range(b - a):
                    asked = np.array(wanted[a + d].as_py(), np.int64)
                    own = whole[cut[d]:cut[d + 1]]
                    # One copy of a run is enough.
                    place = np.unique(own, return_index=True)[1]
                    keep[cut[d] + place] = np.isin(own[place], asked)
                n = (g.end - g.begin)[keep]
                at = np.repeat(g.begin[keep], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(signed(g.key)[keep], n)), pa.array(signed(words.spans(at, at + size))),
                    pa.array(np.repeat(whole[keep], n)),
                ], names=["key", "window", "whole"])

    return run


def _cut(size: int):
    """Documents without their repeated words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, runs, single = (batch.column(k) for k in range(4))
            for a, b in slices(texts):
                words = words_of(texts.slice(a, b - a))
                g = groups(words, size)
                whole = signed(g.whole)
                cut = np.searchsorted(g.text, np.arange(b - a + 1))
                # Starts of repeated windows, as steps up and down of the cover.
                step = np.zeros(len(words.code) + 1, np.int64)
                for d in range(b - a):
                    c, e = cut[d], cut[d + 1]
                    full = np.isin(whole[c:e], np.array(runs[a + d].as_py() or [], np.int64))
                    np.add.at(step, g.begin[c:e][full], 1)
                    np.add.at(step, g.end[c:e][full] - 1 + size, -1)
                    asked = single[a + d].as_py()
                    if asked:
                        at = np.arange(words.first[d], words.first[d + 1] - size + 1)
                        at = at[np.isin(signed(words.spans(at, at + size)), np.array(asked, np.int64))]
                        np.add.at(step, at, 1)
                        np.add.at(step, at + size, -1)
                kept = np.cumsum(step)[:-1] == 0
                out = []
                for d in range(b - a):
                    own = (texts[a + d].as_py() or "").encode().split()
                    mask = kept[words.first[d]:words.first[d + 1]]
                    out.append(b" ".join([w for w, k in zip(own, mask, strict=True) if k]))
                removed = [int((~kept[words.first[d]:words.first[d + 1]]).sum()) for d in range(b - a)]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ], names=_RESULT)

    return run


def remove_repeats(documents: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)``, kept words joined by one space."""
    spark = documents.sparkSession
    store = Store(spark, "repeats")
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parsed = store.put(texts.mapInArrow(_parsed(size), f"doc_id {kind}, n_words long, key array<long>, whole array<long>"), "parsed")

    # 1. Anchors met more than once.
    met = parsed.select(F.explode("key").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = store.put(met, "anchors")
    placed = parsed.select("doc_id", F.explode(F.arrays_zip("key", "whole")).alias("g")).select("doc_id", "g.key", "g.whole")
    placed = store.put(placed.join(met, "key", "left_semi"), "placed")
    # 2. Runs met more than once.
    runs = store.put(placed.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc")), "runs")
    twice = store.put(runs.where("n > 1").select("key", "whole"), "twice")
    full = placed.join(twice, ["key", "whole"], "left_semi").groupBy("doc_id").agg(F.collect_set("whole").alias("runs"))
    # 3. Windows of anchors in different runs.
    mixed = store.put(runs.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "mixed")
    asked = store.put(runs.join(mixed, "key", "left_semi"), "asked")
    by_doc = store.put(asked.groupBy("doc").agg(F.collect_set("whole").alias("wanted")), "asked-by-doc")
    single = _join_texts(texts, by_doc, "doc", store).select("text", "wanted").mapInArrow(_windows(size), "key long, window long, whole long")
    single = store.put(single, "windows")
    weighed = single.join(asked, ["key", "whole"])
    again = weighed.groupBy("key", "window").agg(F.sum("n").alias("n")).where("n > 1").select("key", "window")
    lone = weighed.where("n = 1").join(store.put(again, "again"), ["key", "window"], "left_semi")
    lone = lone.groupBy("doc").agg(F.collect_set("window").alias("windows"))

    marks = full.join(lone, F.col("doc_id").eqNullSafe(F.col("doc")), "full_outer").select(
        F.coalesce("doc_id", "doc").alias("doc"), "runs", "windows")
    marks = store.put(marks, "marks")
    store.drop(placed, runs, twice, mixed, asked, by_doc, single)
    bits = store.put(bitmap(marks.select("doc")), "bits")
    rows = marked(texts, "doc_id", bits)
    result = f"doc_id {kind}, n_words long, n_removed long, kept_text string"
    touched = rows.where("__hit").join(marks, F.col("doc_id").eqNullSafe(F.col("doc")), "left").select("doc_id", "text", "runs", "windows")
    untouched = rows.where("NOT __hit").select("doc_id", "text")
    return touched.mapInArrow(_cut(size), result).unionByName(untouched.mapInArrow(_cut_nothing, result))


def _cut_nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(1)):
            words = [(t.as_py() or "").encode().split() for t in batch.column(1).slice(a, b - a)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), pa.array([0] * (b - a), pa.int64()),
                pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string()),
            ], names=_RESULT)


def _join_texts(texts: DataFrame, wanted: DataFrame, on: str, store: Store) -> DataFrame:
    bits = store.put(bitmap(wanted.select(on)), "bits")
    return marked(texts, "doc_id", bits).where("__hit").join(wanted, F.col("doc_id").eqNullSafe(F.col(on)))
