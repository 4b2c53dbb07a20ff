"""Fuzzy line deduplication over a corpus, with DataFrame functions only.

A line is compared trimmed and in lower case; lines without a visible character are left alone.

* Equal lines form one class.
* A class's signature: of its 5-character shingles, the same that are verified, the one with the smallest hash is kept
  under each of ``PARTS * SAMPLES`` orders, a MinHash sample.  The orders are rotations of two hashes, each with its
  quarters in four different places.  The four samples of a rotation make a bucket key; no sample is in two keys.
  At a similarity of exactly 0.8 one pair in 1,500 shares no key, whatever the length, far fewer above.
* A class's sketch has eight bits of each sample, and the keys are made of these.  A candidate pair with fewer equal ones than
  similar lines have but once in a million is no candidate; texts are fetched for the others only.
* In each bucket all lines meet one leader; where the others do not end up in one component, their pairs from different
  components are candidates too, each under the first key that they share.  So no pair that shares a key is left out,
  unless its sketches tell that it cannot be similar.
* Candidates are verified exactly: Jaccard similarity of the sets of 5-character shingles (a
  shorter line is one shingle), by their 64-bit hashes, of at least ``percent``.
* Classes are joined to components; one line of each component stays: the first by document
  id, then line number.  All its other occurrences go.

Results: a null text stays null; a document that loses all lines keeps an empty text.  Rows equal
in id and text count as one document and are treated alike.  Other columns are passed on,
whatever their names, except those that start with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.linking import link
from canvass.llm.sieve import bitmap, marked
from canvass.llm.store import Store

#: Samples are taken from two hashes, ``SAMPLES`` from each.
SHINGLE, SAMPLES, PARTS, TOGETHER = 5, 28, 2, 4
#: Rotations of a hash, and samples in a number of a sketch: 56 bits, so that sums of its bytes do not overflow.
SEVEN, TURN = 7, 9
#: Shingles of a line whose samples are taken together.
BLOCK = 8
BLANKS = " \t\r\x0b\x0c"


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def plain(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def shingles(line: Column) -> Column:
    """Hashes of the distinct 5-character shingles of a plain line."""
    def cut(wide: Column) -> Column:
        last = F.greatest(F.floor(F.octet_length(wide) / 2).cast("int") - SHINGLE, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(wide, i * 2 + 1, F.lit(2 * SHINGLE)))))

    # Two bytes a character, so that a shingle is cut out without walking along the line.
    return bind(F.encode(line, "UTF-16BE"), cut)


def _occurrences(texts: DataFrame) -> DataFrame:
    rows = texts.select("__doc", "__text_hash", F.posexplode(lines(F.col("__text"))).alias("__line", "__raw"))
    return rows.select("__doc", "__text_hash", "__line", plain(F.col("__raw")).alias("__plain")).where("__plain <> ''")


def _identity(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(17), line).alias("h2")]


def _signatures(texts: DataFrame) -> DataFrame:
    """``(h1, h2, s0, s1, ...)``, identity and sketch, for each class of equal lines."""
    # One text of each class moves, and the samples of a line are taken where it is.
    own = _occurrences(texts).select(*_identity("__plain"), "__plain").groupBy("h1", "h2").agg(F.first("__plain").alias("plain"))
    # Two bytes a character, so that a shingle is cut out without walking along the line.
    wide = own.select("h1", "h2", F.encode("plain", "UTF-16BE").alias("w"))
    last = F.greatest(F.expr(f"length(w) div 2 - {SHINGLE}"), F.lit(0).cast("long"))
    # A row for each block of shingles, whose samples are found before they meet those of the line; the last shingle fills up the last block.
    at = wide.withColumn("last", last).select("h1", "h2", "w", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(BLOCK).cast("long"))).alias("i"))
    places = [F.least(F.col("i") + r, F.col("last")) for r in range(BLOCK)] if BLOCK > 1 else [F.col("i")]
    hashed = at.select("h1", "h2", *[F.xxhash64(F.substring("w", (i * 2 + 1).cast("int"), F.lit(2 * SHINGLE))).alias(f"a{r}") for r, i in enumerate(places)])
    hashed = hashed.select("*", *[F.xxhash64(f"a{r}").alias(f"b{r}") for r in range(BLOCK)])

    def least(p: int, q: int, j: int) -> Column:
        order = F.lit(q - 4 * (q > 1)).cast("long") * F.lit(1 << 62).cast("long")
        own = [_turned(F.col(f"{'ab'[p]}{r}"), j).bitwiseXOR(order) for r in range(BLOCK)]
        return F.least(*own) if BLOCK > 1 else own[0]

    samples = hashed.groupBy("h1", "h2").agg(*[
        F.min(least(p, q, j)).alias(f"k{SAMPLES * p + SEVEN * q + j}") for p in range(PARTS) for q in range(TOGETHER) for j in range(SEVEN)])
    return samples.select("h1", "h2", *[c.alias(s) for p in range(PARTS) for c, s in zip(_sketch(SAMPLES * p), _names(p), strict=True)])


def _turned(h: Column, j: int) -> Column:
    return F.shiftleft(h, TURN * j).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN * j)) if j else h


def _sketch(begin: int = 0) -> list[Column]:
    """Eight bits of each of ``SAMPLES`` samples, ``SEVEN`` samples in a number."""
    def number(begin: int) -> Column:
        eights = [F.shiftleft(F.col(f"k{begin + i}").bitwiseAND(F.lit(0xFF).cast("long")), 8 * i) for i in range(SEVEN)]
        return reduce(Column.bitwiseOR, eights)

    return [number(begin + k) for k in range(0, SAMPLES, SEVEN)]


def _names(part: int) -> list[str]:
    return [f"s{TOGETHER * part + i}" for i in range(TOGETHER)]


#: The sketch of the samples from one hash, and of all.
SKETCH, WHOLE = _names(0), [s for p in range(PARTS) for s in _names(p)]


def _keys() -> Column:
    """Bucket keys of a sketch: a place, the samples at this place of the four numbers of a part, and the number of both."""
    def key(part: int, j: int) -> Column:
        own = [F.shiftleft(F.shiftright(F.col(s), 8 * j).bitwiseAND(F.lit(0xFF).cast("long")), 8 * i) for i, s in enumerate(_names(part))]
        return reduce(Column.bitwiseOR, own, F.lit((SEVEN * part + j) << 32).cast("long"))

    return F.array(*[key(p, j) for p in range(PARTS) for j in range(SEVEN)])


def least_equal(percent: int, samples: int = SAMPLES) -> int:
    """Equal samples that all but one in a million pairs of this similarity have."""
    share, sum_, least = percent / 100, 0.0, 0
    while sum_ <= 1e-6 and least <= samples:
        sum_ += comb(samples, least) * share**least * (1 - share) ** (samples - least)
        least += 1
    return least - 1


#: The top bit of each byte of a number.
_TOP = 0x80808080808080


def _differing(name: str, other: str) -> Column:
    """The top bit of each byte that is not the same in two numbers."""
    low, x = F.lit(_TOP - 0x01010101010101).cast("long"), F.col(name).bitwiseXOR(F.col(other + name))
    return ((x.bitwiseAND(low) + low).bitwiseOR(x)).bitwiseAND(F.lit(_TOP).cast("long"))


def near_enough(percent: int, other: str = "x_", sketch: list[str] = SKETCH) -> Column:
    """Whether two sketches, the second one in columns with ``other`` before their names, agree in enough samples."""
    samples = SEVEN * len(sketch)
    return reduce(Column.__add__, [F.bit_count(_differing(s, other)) for s in sketch]) <= samples - least_equal(percent, samples)


def first_common(key: Column, other: str = "x_") -> Column:
    """Whether two sketches under a common key share no key before it."""
    number = F.shiftright(key, 32)
    same = [reduce(Column.bitwiseOR, [_differing(s, other) for s in _names(p)]).bitwiseXOR(F.lit(_TOP).cast("long")) for p in range(PARTS)]
    # Of each part, the same keys whose numbers are smaller.
    before = [F.when(number >= SEVEN * (p + 1), F.lit(_TOP).cast("long")).when(number < SEVEN * p, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), (8 * (number - SEVEN * p)).cast("int")) - 1) for p in range(PARTS)]
    return reduce(Column.__and__, [x.bitwiseAND(y) == 0 for x, y in zip(same, before, strict=True)])


def _texts_of(texts: DataFrame, wanted: DataFrame, store: Store) -> DataFrame:
    """``(id, plain)`` of the wanted lines ``(id, __doc, __text_hash, __line)``."""
    per_doc = wanted.groupBy("__doc", "__text_hash").agg(F.collect_list(F.struct("id", "__line")).alias("want"))
    per_doc = store.put(per_doc, "wanted")
    bits = store.put(bitmap(per_doc.select("__doc")), "bits")
    near = marked(texts, "__doc", bits).where("__hit").select("__doc", "__text_hash", "__text")
    rows = near.withColumnsRenamed({"__doc": "d", "__text_hash": "t"}).join(
        per_doc, F.col("d").eqNullSafe(F.col("__doc")) & (F.col("t") == F.col("__text_hash"))).dropDuplicates(["d", "t"])
    cut = bind(F.struct(lines(F.col("__text")).alias("lines"), "want"), lambda s: F.transform(
        s["want"], lambda w: F.struct(w["id"].alias("id"), plain(F.get(s["lines"], w["__line"])).alias("plain"))))
    return rows.select(F.inline(cut))


def removed_lines(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(__doc, __text_hash, removed)``: line numbers, from 0, that go; documents without any are left out."""
    store = Store(documents.sparkSession, "lines")
    texts = documents.select(
        F.col(id_col).alias("__doc"), F.xxhash64(text_col).alias("__text_hash"), F.col(text_col).alias("__text")).where("__text IS NOT NULL")
    found = store.put(_occurrences(texts).select(*_identity("__plain"), "__doc", "__text_hash", "__line"), "found")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("__doc", "__text_hash", "__line")).alias("first"), F.count("*").alias("times"))
    classes = store.put(first.join(_signatures(texts), ["h1", "h2"]).withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select(F.explode(_keys()).alias("key"), "id")
    sketches, near = classes.select("id", *WHOLE), near_enough(percent, sketch=WHOLE)

    def lines_of(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id", "left_semi").select("id", "first.*")
        return store.put(_texts_of(texts, wanted, store).withColumn("n", F.size(shingles(F.col("plain")))), "plain")

    def admissible(pairs: DataFrame) -> DataFrame:
        first, second = (sketches.withColumnsRenamed({"id": i} | {s: x + s for s in WHOLE}) for i, x in (("a", ""), ("b", "x_")))
        return pairs.join(first, "a").join(second, "b").where(near).select("a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        held = lines_of(store.put(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "named"))
        both = pairs.join(held.select(F.col("id").alias("a"), F.col("plain").alias("pa"), F.col("n").alias("na")), "a").join(
            held.select(F.col("id").alias("b"), F.col("plain").alias("pb"), F.col("n").alias("nb")), "b")
        # A set cannot be as similar to a much larger one; that spares most pairs the comparison.
        both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        sets = F.struct(shingles(F.col("pa")).alias("x"), shingles(F.col("pb")).alias("y"))
        sizes = bind(sets, lambda s: F.struct(
            (F.size(s["x"]) + F.size(s["y"])).alias("all"), F.size(F.array_intersect(s["x"], s["y"])).alias("common")))
        # One expression, as a filter on a computed column would be computed for each use.
        return both.where(bind(sizes, lambda z: 100 * z["common"] >= percent * (z["all"] - z["common"]))).select("a", "b")

    roots = store.put(link(members, verify, None, near & first_common(F.col("key")), store, admissible, sketches), "roots")
    joined = classes.join(roots, F.col("id") == F.col("node"), "left").select(
        "h1", "h2", "id", "first", "times", F.coalesce("root", "id").alias("root"), F.col("node").isNotNull().alias("linked"))
    joined = store.put(joined.where("linked OR times > 1"), "joined")
    heads = store.put(joined.where("linked").groupBy("root").agg(F.min("first").alias("head")), "heads")
    keeps = joined.join(heads, "root", "left").select("h1", "h2", F.coalesce("head", "first").alias("keep"))
    keeps = store.put(keeps, "keeps")
    gone = found.join(keeps, ["h1", "h2"]).where(~F.struct("__doc", "__text_hash", "__line").eqNullSafe(F.col("keep")))
    return gone.groupBy("__doc", "__text_hash").agg(F.collect_set("__line").alias("removed"))


def dedup_lines(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with the repeated lines cut out, and ``n_lines``, ``n_removed`` (columns of these names are replaced)."""
    store = Store(documents.sparkSession, "lines-out")
    gone = store.put(removed_lines(documents, percent, id_col, text_col).withColumnRenamed("removed", "__removed"), "removed")
    bits = store.put(bitmap(gone.select("__doc")), "bits")
    rows = marked(documents.withColumn("__t", F.xxhash64(text_col)).withColumn("__d", F.col(id_col)), id_col, bits)
    hit = rows.where("__hit").join(gone, F.col("__d").eqNullSafe(F.col("__doc")) & (F.col("__t") == F.col("__text_hash")), "left")
    total = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines(F.col(text_col)))).cast("long")
    lost = F.coalesce(F.size("__removed"), F.lit(0)).cast("long")
    cut = bind(lines(F.col(text_col)), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__removed")), lambda i: F.get(x, i)), "\n"))
    hit = hit.withColumns({"__total": total, "__lost": F.when(F.col("__removed").isNull(), 0).otherwise(lost).cast("long"),
                           "__new": F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(cut)})
    missed = rows.where("NOT __hit").withColumns({"__total": total, "__lost": F.lit(0).cast("long"), "__new": F.col(text_col)})
    kept = [F.col("__new").alias(c) if c == text_col else F.col(c) for c in documents.columns if c not in ("n_lines", "n_removed")]
    counts = [F.col("__total").alias("n_lines"), F.col("__lost").alias("n_removed")]
    return hit.select(*kept, *counts).unionByName(missed.select(*kept, *counts))
