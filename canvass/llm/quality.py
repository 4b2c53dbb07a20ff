"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Words are runs of characters other than space and ``\\t \\n \\v \\f \\r``.  Each rule says whether it
rejects a text.  What a rule costs and rejects is measured on ``SAMPLE_ROWS`` rows; then
a CASE tries the rules by rejections per second, and the rules after the first hit are not
computed.  The order decides the time a run takes and which of several rules is named; whether a
document is kept depends on no sample.

A null text is an empty text, and fails the rule on words.  Repeated rows are judged alike.
Columns other than the text are passed on untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.fuzzy_lines import bind
from canvass.llm.store import Store

BLANK = "[\\x20\\x09-\\x0D]+"
#: Rows on which cost and selectivity are measured.
SAMPLE_ROWS = 500
WINDOW = 5


def words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK))


def word_chars(w: Column) -> Column:
    return F.char_length(F.array_join(w, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def _full_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bind(_full_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words(w: Column) -> Column:
    """Words within windows of five that occur twice or more in the text."""
    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        twice = bind(ranked, lambda r: F.filter(
            F.transform(r, lambda e, i: F.when((F.get(r, i - 1)["h"] == e["h"]) | (F.get(r, i + 1)["h"] == e["h"]), e["at"])),
            lambda at: at.isNotNull()))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        # Each repeated window adds the words that the one before did not reach.
        return F.aggregate(F.sort_array(twice), start, lambda s, at: F.struct(
            at.alias("last"), (s["n"] + F.least(F.lit(WINDOW), at - s["last"])).alias("n")), lambda s: s["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    counted = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(w) >= WINDOW, counted).otherwise(F.lit(0).cast("long"))


#: Name and condition of each rule: true if it rejects the text.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda t: F.size(words(t)) < 10,
    "repeated_words": lambda t: bind(words(t), lambda w: 100 * repeat_words(w) > 20 * F.size(w)),
    "symbols": lambda t: symbols(t) > F.size(words(t)),
    "repeated_lines": lambda t: bind(_full_lines(t), lambda x: 2 * F.size(F.array_distinct(x)) < F.size(x)),
    "word_length": lambda t: bind(words(t), lambda w: (2 * word_chars(w) < 3 * F.size(w)) | (word_chars(w) > 25 * F.size(w))),
}


def cascade(documents: DataFrame, text_col: str = "text") -> list[str]:
    """Rule names by rejections per second on a sample."""
    store = Store(documents.sparkSession, "quality")
    sample = store.put(documents.select(F.col(text_col).alias("text")).limit(SAMPLE_ROWS), "sample")
    worth = {}
    for name, rule in RULES.items():
        begun = time.perf_counter()
        rejected = sample.agg(F.count_if(rule(F.col("text")))).first()[0]
        worth[name] = (rejected + 1) / (time.perf_counter() - begun)
    store.drop(sample)
    return sorted(RULES, key=lambda name: -worth[name])


def rejected_by(text: Column, order: list[str]) -> Column:
    """Name of the first rule of ``order`` that rejects the text, or null."""
    out = F.when(RULES[order[0]](text), order[0])
    for name in order[1:]:
        out = out.when(RULES[name](text), name)
    return out


def keep_good(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that no rule rejects."""
    order = cascade(documents, text_col)
    return documents.where(rejected_by(F.col(text_col), order).isNull())


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, and the verdict of the cascade, for each document."""
    order = [name for name in cascade(documents, text_col) if name not in ("few_words", "repeated_words")]
    text = F.col("text")
    counts = bind(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("c", counts)
    failed = (F.col("c.n_words") < 10) | (100 * F.col("c.n_repeat_words") > 20 * F.col("c.n_words"))
    return rows.select(
        "doc_id", "c.n_words", "c.word_chars", symbols(text).alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"),
        "c.n_repeat_words", failed.alias("base_failed"),
        F.when(failed, False).otherwise(rejected_by(text, order).isNull()).alias("kept"))
