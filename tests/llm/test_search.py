"""Ranked search, language identification and the prefix trie, against brute force on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from canvass.llm import language, prefix_trie, ranked
from canvass.llm.store import Store

TERM = re.compile(ranked.TERM)
WORD = re.compile(prefix_trie.WORD)
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# --- ranked search


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def best_documents(docs, items, k=10):
    """Brute force over (doc_id, text) and (item_id, text)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, mine in wanted.items():
        scored = []
        for doc, c in held:
            m = 10 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in mine if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc, s))
        out += [(item, r, doc, s) for r, (_, _, doc, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def search_tables():
    draw = random.Random(3)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)] + ["Été", "ÉTÉ", "x_y", "A1b2", "日本"]

    def prose(n):
        return draw.choice([" ", "-", "\n"]).join(draw.choice(vocabulary) for _ in range(n))

    copy = prose(30)
    docs = [(i, prose(int(draw.paretovariate(0.6)) % 300 + 1)) for i in range(300)]
    docs += [(1000 + i, copy) for i in range(60)] + [(5, copy), (5, copy), (None, copy), (2000, None), (2001, ""), (2002, "!?\x00\x7f"), (2003, "w1 " * 4000)]
    items = [(i, prose(8)) for i in range(30)] + [(40, copy), (40, "w1 w2"), (None, prose(5)), (41, None), (42, "..."), (43, "absent words"), (44, "w1 w1 W1")]
    return docs, items


@pytest.mark.parametrize("packet, dealt, pairs, tile", [(ranked.PACKET, ranked.DEALT, ranked.PAIRS, ranked.TILE), (50, 200, 16, 64)])
def test_search_against_brute_force(spark, monkeypatch, packet, dealt, pairs, tile):
    for name, value in (("PACKET", packet), ("DEALT", dealt), ("PAIRS", pairs)):
        monkeypatch.setattr(ranked, name, value)
    docs, items = search_tables()
    left = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in docs], "doc_id long, text string, n long, m long, part string").repartition(5)
    right = spark.createDataFrame([(i, t, 1, 0) for i, t in items], "item_id long, text string, rank int, item int")
    found = [tuple(r) for r in ranked.top_documents(left, right).collect()]
    assert sorted(found, key=str) == best_documents(docs, items)


def test_search_tiles_and_sums():
    """Small tiles and integer sums give the scores of one dense product."""
    import pyarrow as pa

    docs, items = search_tables()
    texts = pa.array([t or "" for _, t in docs[:40]])
    words, first = ranked.terms_of(texts)
    batch = ranked._packet(20, pa.array(range(40), pa.int64()), words, first)
    wanted = sorted({t for _, x in items for t in terms(x)})
    pairs = sorted({(i, wanted.index(t)) for i, (_, x) in enumerate(items) for t in terms(x)})
    block = ranked._Block(wanted, *np.array(pairs).T, len(items))

    class Sent:
        value = block

    hit = next(ranked._matched(Sent)(iter([batch])))
    weight = np.arange(1, len(wanted) + 1)
    everyone = np.arange(len(items))

    def table(tile, exact):
        old = ranked.TILE, ranked.EXACT
        ranked.TILE, ranked.EXACT = tile, exact
        try:
            out = np.zeros((40, len(items)), np.int64)
            for a, chosen, scores in ranked._Packet(hit, 0).scores(block, weight, everyone):
                out[a:a + len(scores), chosen] = scores
            return out
        finally:
            ranked.TILE, ranked.EXACT = old

    whole = table(1 << 22, 1 << 18)
    assert (table(64, 1 << 18) == whole).all() and (table(1 << 22, 0) == whole).all()
    assert (ranked._Packet(hit, 0).bounds(block, weight) >= whole.max(axis=0)).all()


def test_index_saved_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three three")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "three"), ("b", "four")], "item_id string, text string")
    store = Store(spark, "t")
    ranked.build_index(docs, store).save(str(tmp_path / "index"))
    index = ranked.load_index(spark, str(tmp_path / "index"))
    assert [tuple(r)[:3] for r in ranked.search(index, items, 10, store).collect()] == [("a", 1, 2)]
    assert ranked.top_documents(docs.limit(0), items).count() == 0
    assert ranked.top_documents(docs, items.limit(0)).count() == 0
    assert ranked.top_documents(docs.where("false"), items).columns == ["item_id", "rank", "doc_id", "score"]


# --- languages


def test_grams():
    code, first = language.grams(["Ab  c", "", "7!", "é"])
    read = [tuple(chr((int(c) >> s) & 0x1FFFFF) for s in (42, 21, 0)) for c in code]
    assert ["".join(x) for x in read] == [" ab", "ab ", "b c", " c ", " é "]
    assert first.tolist() == [0, 4, 4, 4, 5]


def test_filter_answers_like_sets():
    """Every gram of a language is found; unknown ones about as often as the chance says."""
    draw = np.random.default_rng(5)
    slots, own = 1 << 12, [draw.integers(0, 1 << 62, n).astype(np.uint64) for n in (500, 200)]
    masks = np.zeros((slots, 1), np.int64)
    for i, gram in enumerate(own):
        for place in language._slots(gram, slots):
            np.bitwise_or.at(masks[:, 0], place, 1 << i)
    filters = language.Filters(("x", "y"), masks)

    def yes(gram, i):
        got = np.full(len(gram), -1)
        for place in language._slots(gram, slots):
            got &= masks[place, 0]
        return (got >> i) & 1

    assert yes(own[0], 0).all() and yes(own[1], 1).all()
    other = draw.integers(0, 1 << 62, 200_000).astype(np.uint64)
    for i in (0, 1):
        assert abs(yes(other, i).mean() - filters.chance[i]) < 0.1 * filters.chance[i] + 1e-4


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language.identify(docs.withColumn("bits", docs["lang"]).withColumn("held_out", docs["lang"])).toPandas()
    truth = docs.toPandas().set_index("doc_id")
    assert sorted(out.doc_id) == sorted(truth.index)
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    right = out.lang_pred.to_numpy() == truth.lang.loc[out.doc_id].to_numpy()
    assert right[out.held_out].mean() > 0.97 and out.score.between(0, 1).all()


def test_languages_of_odd_rows(spark):
    rows = [(i, ["the cat and the dog", "der hund und die katze"][i % 2] + f" {i}", ["en", "de"][i % 2]) for i in range(40)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 !?", "de"), (103, "THE DOG", None), (104, "日本語", None), (None, "die katze", None), (7, "und die", "xx"),
           (105, "die katze " * 20_000, None)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    out = {r["doc_id"]: r for r in language.identify(frame).collect()}
    assert [out[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and out[100]["score"] == 0.0
    assert out[103]["lang_pred"] == "en" and out[105]["lang_pred"] == "de" and out[None]["lang_pred"] == "de"
    assert out[104]["lang_pred"] in ("en", "de")
    assert language.identify(frame.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(frame.where("lang IS NULL")).collect()} == {"und"}


def test_many_languages(spark):
    """More languages than a mask has bits."""
    draw = random.Random(2)
    alphabet = {f"l{i:03d}": [chr(0x4E00 + 40 * i + j) for j in range(40)] for i in range(70)}
    rows = [(10 * i + j, " ".join("".join(draw.choices(a, k=5)) for _ in range(30)), x) for i, (x, a) in enumerate(alphabet.items()) for j in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.identify(frame).collect()}
    held = [(i, x) for i, _, x in rows if out[i]["held_out"]]
    assert held and np.mean([out[i]["lang_pred"] == x for i, x in held]) > 0.95


# --- prefix trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
        ends[whole[c]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    parents = {p[:-1] for p in members if p}
    for p, m in members.items():
        if p:
            children[p[:-1]] += 1
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in parents
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items())


def conversations():
    draw = random.Random(8)

    def talk(conv, n, texts=4):
        return [(conv, t, draw.choice(["user", "assistant"]), f"text {draw.randrange(texts)} \t x") for t in range(n)]

    rows = [r for c in range(0, 90) if c != 40 for r in talk(c, draw.randrange(1, 7))]
    rows += [r for c in range(200, 230) for r in [(c, t, "user", "same turn") for t in range(3)]]
    rows += talk(300, 300, 1) + talk(301, 70, 1) + [(c, t, "user", "deep") for c in (320, 321, 322) for t in range(40)]
    rows += [(-7, 0, "user", "negative"), (-27, 0, None, None), (None, 0, "user", "nobody's"), (400, None, "user", "first"), (400, 1, "user", "a"), (400, 1, "user", "a"),
             (401, 0, "a", "bc"), (402, 0, "ab", "c"), (420, 0, "", ""), (421, 0, None, "")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("band, bits", [(16, 12), (2, 1), (3, 0)])
def test_trie_against_brute_force(spark, monkeypatch, band, bits):
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", bits)
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place long, node string").repartition(4)
    out = prefix_trie.prefix_trie(frame, band=band)
    found = sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())
    assert found == trie_by_hand(rows)


def test_empty_trie(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(frame).count() == 0
