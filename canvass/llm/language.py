"""Language of texts by n-gram filters: one bit-sliced Bloom filter for all languages.

**Grams.**  Runs of three characters of the lower-cased text, every other character than a letter
taken as one space, a space before and after each text; a gram has a letter.  Three code points
fit into 64 bits, so a gram is its own exact code.

**Learning.**  Grams are counted per language over all training rows.  A gram belongs to a language if it
makes up at least ``FLOOR`` of the language's grams, and at least ``SHARE`` of the part that it makes up in
the language where it is most common.  Both are shares, so the rule is the same at every size, and no language
has more than ``1 / FLOOR`` grams.  That bounds the filter: ``SLOTS_PER_GRAM`` slots for each gram of
the largest language at most.

**Filter.**  A slot holds a bitmask of languages.  A gram sets its languages' bits in ``HASHES`` slots; looking
a gram up is the AND of those slots, which tells of all languages at once whether they have it.

**Decision.**  The masks of a text's grams are counted by language.  A language with a share f of its bits
set answers yes to an unknown gram with probability f^HASHES; with c yes of n grams the estimate of its own grams is
(c - n f^HASHES) / (1 - f^HASHES).  The highest estimate decides, ties go to the language with more training grams,
then by name; a text whose letters no language has goes the same way.  The score is the winner's part of all estimates.

``und`` with score 0 where the text is null or has no letter, or where nothing could be learned.  Rows with a null language teach nothing.
Repeated rows count as often as they occur.  Every text counts whole.  Languages are labels: their list, like the
filter, is held by the driver.  Columns besides id, text and language are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.store import Store
from canvass.llm.words import U64, mix, signed, slices

FLOOR, SHARE = 4e-6, 0.1
HASHES, SLOTS_PER_GRAM = 4, 8
_SALTS = (np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BITS = 63
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


_LETTERS: np.ndarray | None = None


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams of the texts, and the place of each text's first one."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    padded = [f" {t.lower()} " for t in texts]
    points = _LETTERS[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) for t in padded])
    text = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    # One space for a run of other characters; each text keeps its first.
    kept = (points != 32) | np.concatenate([[True], (points[:-1] != 32)])
    kept[ends[:-1]] = True
    points, text = points[kept].astype(U64), text[kept]
    if len(points) < 3:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    code = (points[:-2] << U64(42)) | (points[1:-1] << U64(21)) | points[2:]
    lettered = (points[:-2] != 32) | (points[1:-1] != 32) | (points[2:] != 32)
    inside = (text[:-2] == text[2:]) & lettered
    return code[inside], np.searchsorted(text[:-2][inside], np.arange(len(texts) + 1))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of each language, combined per slice of text."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        numbers = langs.indices.to_numpy().astype(np.int64)
        for a, b in slices(batch.column(1)):
            code, first = grams(batch.column(1).slice(a, b - a).to_pylist())
            owner = np.repeat(numbers[a:b], np.diff(first))
            for x in np.unique(owner):
                gram, n = np.unique(code[owner == x], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs.dictionary[int(x)].as_py()] * len(gram)), pa.array(signed(gram)), pa.array(n)], names=["lang", "gram", "n"])


def _slots(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    return [(mix(gram ^ s) & U64(slots - 1)).astype(np.int64) for s in _SALTS]


def _placed(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy().view(U64)
            place = np.concatenate(_slots(gram, slots))
            repeated = pa.array(np.tile(np.arange(len(gram)), HASHES))
            yield pa.RecordBatch.from_arrays([pa.array(place), *(batch.column(c).take(repeated) for c in (1, 2))], names=["slot", "part", "bits"])

    return run


@dataclass(frozen=True)
class Filters:
    """``masks``: slots x words of 63 languages each; languages with more training grams first."""

    languages: tuple[str, ...]
    masks: np.ndarray

    @property
    def chance(self) -> np.ndarray:
        """Of each language, the probability of yes to an unknown gram."""
        full = [((self.masks[:, i // _BITS] >> (i % _BITS)) & 1).mean() for i in range(len(self.languages))]
        return np.array(full) ** HASHES

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Grams of each text, and for each language how many of them it answers with yes."""
        code, first = grams(texts)
        mask = np.full((len(code), self.masks.shape[1]), (1 << _BITS) - 1, np.int64)
        for place in _slots(code, len(self.masks)):
            mask &= self.masks[place]
        yes = np.zeros((len(texts), len(self.languages)), np.int64)
        for i in range(len(self.languages)):
            has = (mask[:, i // _BITS] >> (i % _BITS)) & 1
            yes[:, i] = np.diff(np.concatenate([[0], np.cumsum(has)])[first])
        return np.diff(first), yes

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n, yes = self.counts(texts)
        own = np.maximum((yes - n[:, None] * self.chance) / (1 - self.chance), 0.0)
        best = own.argmax(axis=1)
        total = own.sum(axis=1)
        score = np.where(total > 0, own[np.arange(len(own)), best] / np.maximum(total, 1e-300), 1 / len(self.languages))
        return [self.languages[i] for i in best], score


def learn(rows: DataFrame, store: Store, lang_col: str = "lang", text_col: str = "text") -> Filters | None:
    """Filters from all rows with a text and a language; none if there is no gram."""
    given = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = store.put(given.mapInArrow(_held, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    languages = sorted(totals, key=lambda x: (-totals[x], x))
    number = F.create_map(*[F.lit(v) for i, x in enumerate(languages) for v in (x, i)])[F.col("lang")]
    whole = F.create_map(*[F.lit(v) for x in languages for v in (x, float(totals[x]))])[F.col("lang")]
    part = counted.select("gram", number.alias("at"), (F.col("n") / whole).alias("share")).where(F.col("share") >= FLOOR)
    most = part.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("at", "share")).alias("langs"))
    own = most.select("gram", F.explode("langs").alias("x"), "most").where(F.col("x.share") >= SHARE * F.col("most")).select("gram", F.col("x.at").alias("at"))
    own = store.put(own, "own")
    largest = own.groupBy("at").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    slots = 1 << math.ceil(math.log2(largest * SLOTS_PER_GRAM))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % _BITS)
    by_gram = own.groupBy("gram", F.floor(F.col("at") / _BITS).cast("int").alias("part")).agg(F.bit_or(bit).alias("bits"))
    table = by_gram.mapInArrow(_placed(slots), "slot long, part int, bits long").groupBy("slot", "part").agg(F.bit_or("bits").alias("bits")).toArrow()
    masks = np.zeros((slots, -(-len(languages) // _BITS)), np.int64)
    masks[table.column("slot").to_numpy(), table.column("part").to_numpy()] = table.column("bits").to_numpy()
    store.drop(counted, own)
    return Filters(tuple(languages), masks)


def _decided(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filters.value
        for batch in batches:
            for a, b in slices(batch.column(2)):
                texts, readable = batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a).to_pylist()
                langs, scores = held.decide([t if r else "" for t, r in zip(texts.to_pylist(), readable)])
                langs = [x if r else UNKNOWN for x, r in zip(langs, readable)]
                scores = np.where(readable, scores, 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 1)), pa.array(langs, pa.string()), pa.array(scores)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(spark: SparkSession, rows: DataFrame, filters: Filters | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for rows ``(doc_id, held_out, text)``."""
    if filters is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("readable")
    sent = spark.sparkContext.broadcast(filters)
    return rows.select("doc_id", "held_out", "text", readable).mapInArrow(_decided(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(ident: Column, parts: int = 4, at: int = 2) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % parts == at


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Languages of all rows, learned from those that are not held out; a null id counts as the empty text."""
    spark = documents.sparkSession
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(spark, rows, learn(rows.where("NOT held_out"), Store(spark, "language")))
