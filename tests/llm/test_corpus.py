"""Operators over a whole corpus, against brute force: near copies, lines, repeats, leaks, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canvass.llm import decontaminate, fuzzy_lines, near_dup, recompress, substrings
from canvass.llm.linking import components
from canvass.llm.queries import QUERIES
from canvass.llm.store import Store
from canvass.llm.words import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, id string, key string, n long, __x string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", 1, "c") for i, t in texts], DOCS)


def prose(draw, n):
    return [draw.choice(["The", "of", "and"]) if draw.random() < 0.2 else f"w{draw.randrange(4000)}" for _ in range(n)]


def changed(draw, words, times):
    out = list(words)
    for _ in range(times):
        out[draw.randrange(len(out))] = f"edit{draw.randrange(10**6)}"
    return out


def corpus():
    """A group of copies, a crowd of half-similar texts, a shared passage, a repeated line, and odd texts."""
    draw = random.Random(9)
    base, passage, other = prose(draw, 150), prose(draw, 50), prose(draw, 400)
    docs = [" ".join(base)] * 25
    docs += [" ".join(changed(draw, base, 1 + i % 6)) for i in range(60)]
    docs += [" ".join(prose(draw, 60) + passage + prose(draw, 60)) for _ in range(10)]
    docs += [" ".join(changed(draw, other, 2)) for _ in range(5)] + [" ".join(other).upper()]
    docs += ["\n".join([" ".join(prose(draw, 20)), "All rights reserved.", " all rights reserved.\r", " ".join(prose(draw, 30))]) for _ in range(10)]
    docs += [None, "", " \n\t ", "one", "One", "one two three", "a " * 90, "a b " * 60, " ".join(passage[:34]), " ".join(passage[:35]), "x" * 5000, "é " * 40]
    return list(enumerate(docs, 1)) + [(None, "null id text here with words"), (3, docs[2])]


@pytest.fixture(scope="module")
def texts():
    return corpus()


def find(parents, x):
    while parents[x] != x:
        parents[x] = parents[parents[x]]
        x = parents[x]
    return x


def shingle_set(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(sets, percent):
    parents = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(parents, i), find(parents, j)))
                parents[y] = x
    return {i: find(parents, i) for i in sets}


def test_near_duplicates(spark, texts):
    sets = {i: shingle_set(t) for i, t in texts if i is not None}
    roots = linked(sets, 85)
    got = near_dup.near_duplicates(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), roots[r.doc_id], roots[r.doc_id] == r.doc_id)
    assert near_dup.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_keep_one(spark, texts):
    roots = linked({i: shingle_set(t) for i, t in texts if i is not None}, 80)
    got = near_dup.keep_one(frame(spark, texts))
    assert Counter(r.doc_id for r in got.collect()) == Counter({i for i, r in roots.items() if i == r} | {None})
    assert got.columns == frame(spark, texts).columns


def test_sketch_limit_spares_similar_sets():
    draw = np.random.default_rng(1)
    for _ in range(200):
        common = draw.integers(0, 2**63, 170, dtype=np.uint64)
        own = [np.unique(np.concatenate([common, draw.integers(0, 2**63, 15, dtype=np.uint64)])) for _ in range(2)]
        a, b = near_dup.odd_sketch(near_dup.minhash(own))
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= near_dup.sketch_limit(85)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges, Store(spark, "test")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def char_set(line):
    return {line[j:j + 5] for j in range(len(line) - 4)} if len(line) >= 5 else {line}


def deduped(texts):
    first = {}
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            plain = line.strip(" \t\r\x0b\x0c").lower()
            if plain:
                first.setdefault(plain, (i, k))
    roots = linked({n: char_set(p) for n, p in enumerate(first)}, 80)
    names = list(first)
    head = {}
    for n, r in roots.items():
        place = first[names[n]]
        rank = (place[0] is not None, place[0] or 0, place[1])
        head[r] = min(head.get(r, (rank, place)), (rank, place))
    keep = {p: head[roots[n]][1] for n, p in enumerate(names)}
    out = []
    for i, t in texts:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if not (p := x.strip(" \t\r\x0b\x0c").lower()) or keep[p] == (i, k)]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_signatures_do_not_depend_on_blocks(spark, monkeypatch):
    """Lines of any length, whose last block is whole or not, have the same samples with blocks of one shingle and of eight."""
    lines = ["x", "abcd", "abcde", "ünïcödé \U0001f600 line"] + ["".join(chr(97 + i * k % 26) for i in range(k)) for k in range(6, 40)]
    texts = spark.createDataFrame([(1, 2, "\n".join(lines))], "__doc long, __text_hash long, __text string")

    def signatures(block):
        monkeypatch.setattr(fuzzy_lines, "BLOCK", block)
        return sorted(map(tuple, fuzzy_lines._signatures(texts).collect()))

    want = signatures(1)
    assert len(want) == len(set(lines)) and signatures(8) == want and signatures(3) == want


def test_lines(spark, texts):
    got = fuzzy_lines.dedup_lines(frame(spark, texts))
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == Counter(deduped(texts))
    assert fuzzy_lines.dedup_lines(frame(spark, texts).limit(0)).count() == 0


def test_lines_with_a_column_of_the_same_name(spark):
    rows = spark.createDataFrame([(1, "one line of text\nanother", "x"), (2, "one line of text", "y"), (3, None, "z")], "doc_id long, text string, removed string")
    got = sorted(map(tuple, fuzzy_lines.dedup_lines(rows).select("doc_id", "text", "removed", "n_removed").collect()))
    assert got == [(1, "one line of text\nanother", "x", 0), (2, "", "y", 1), (3, None, "z", 0)]


def test_keep_one_keeps_other_texts_of_an_id(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, words), (1, words), (1, words + " and more of it"), (2, words)], "doc_id long, text string")
    assert sorted(r.text for r in near_dup.keep_one(rows).collect()) == sorted([words, words + " and more of it"])


def edited_lines(kind, number):
    """Pairs of similar lines without a word in common with other pairs."""
    draw, letters = random.Random(21), "abcdefghijklmnopqrstuvwxyz"
    out = []
    for _ in range(number):
        size = {"12-13": 12, "12-14": 12}.get(kind) or int(kind)
        line = "".join(draw.choice(letters) for _ in range(size))
        at = size // 2
        out.append((line, line + "!?"[:int(kind[3:]) - 12] if "-" in kind else line[:at] + "#" + line[at + 1:]))
    return out


def found_share(spark, pairs):
    docs = [(k, f"{a}\n{b}") for k, (a, b) in enumerate(pairs)]
    return sum(r.n_removed for r in fuzzy_lines.dedup_lines(frame(spark, docs)).collect()) / len(pairs)


def test_short_and_edited_lines_meet(spark):
    named = [("read more", "read more."), ("click here", "click here!")]
    assert found_share(spark, named) == 1
    for kind in ("12-13", "50"):
        assert found_share(spark, edited_lines(kind, 400)) >= 0.995


def test_similar_lines_in_a_crowd_of_half_similar_ones(spark):
    """Every line has half of a common text, so buckets are mixed; the similar pairs among them are all found."""
    draw, letters = random.Random(31), "abcdefghijklmnopqrstuvwxyz"
    common = "".join(draw.choice(letters) for _ in range(150))
    docs = []
    for k in range(250):
        own = common + "".join(draw.choice(letters) for _ in range(80))
        # Single changes all over the line: 0.8 or little more of the short shingles stay, half of the long ones.
        other = "".join("#" if i % 47 == 20 else c for i, c in enumerate(own))
        docs.append((k, f"{own}\n{other}"))
    assert all(100 * len(x & y) >= 80 * len(x | y) for x, y in (map(char_set, t.split("\n")) for _, t in docs))
    got = fuzzy_lines.dedup_lines(frame(spark, docs))
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == Counter(deduped(docs))


def test_lines_that_only_share_a_key_are_not_compared(spark, monkeypatch):
    """A sixth of the shingles in common makes shared keys, but few candidates."""
    draw, letters, asked = random.Random(41), "abcdefghijklmnopqrstuvwxyz", []
    common = "".join(draw.choice(letters) for _ in range(36))
    docs = [(k, common + "".join(draw.choice(letters) for _ in range(84))) for k in range(400)]
    docs += [(400 + k, docs[k][1] + "!") for k in range(20)]
    link = fuzzy_lines.link

    def counted(members, verify, *others):
        def seen(pairs):
            asked.append(pairs.count())
            return verify(pairs)

        return link(members, seen, *others)

    monkeypatch.setattr(fuzzy_lines, "link", counted)
    got = fuzzy_lines.dedup_lines(frame(spark, docs))
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == Counter(deduped(docs))
    assert 20 <= sum(asked) < 200


def test_lines_meet_under_one_of_their_common_keys(spark, monkeypatch):
    """However many keys two lines share, one candidate comes of them, and none is lost by that."""
    draw, letters, seen = random.Random(47), "abcdefghijklmnopqrstuvwxyz", []
    line = "".join(draw.choice(letters) for _ in range(120))
    docs = [(k, line[:4 * k] + "#" + line[4 * k + 1:]) for k in range(25)]
    link = fuzzy_lines.link

    def watched(members, verify, refine, fits, store, admissible, details, *others):
        own = members.join(details, "id").localCheckpoint()
        other = own.select(*[F.col(c).alias(f"x_{c}") for c in own.columns])
        pairs = own.join(other, (F.col("key") == F.col("x_key")) & (F.col("id") < F.col("x_id")))
        sharing = {(r.id, r.x_id) for r in pairs.where(fuzzy_lines.near_enough(80)).select("id", "x_id").collect()}
        seen.extend([own.count(), sharing, [(r.id, r.x_id) for r in pairs.where(fits).select("id", "x_id").collect()]])
        return link(members, verify, refine, fits, store, admissible, details, *others)

    monkeypatch.setattr(fuzzy_lines, "link", watched)
    assert fuzzy_lines.dedup_lines(frame(spark, docs)).agg(F.sum("n_removed")).first()[0] == len(docs) - 1
    keyed, sharing, met = seen
    assert keyed <= 14 * len(docs)
    assert len(met) == len(set(met)) and set(met) == sharing


def test_sketches_tell_equal_samples(spark):
    draw = random.Random(43)
    rows = []
    for equal in range(fuzzy_lines.SAMPLES + 1):
        a = [draw.randrange(-2**63, 2**63) for _ in range(fuzzy_lines.SAMPLES)]
        same = set(draw.sample(range(fuzzy_lines.SAMPLES), equal))
        rows.append((equal, a, [x if i in same else x ^ draw.randrange(1, 256) for i, x in enumerate(a)]))
    both = spark.createDataFrame(rows, "equal int, a array<long>, b array<long>")
    for side, x in (("a", ""), ("b", "x_")):
        own = both.select("*", *[F.col(side)[i].alias(f"k{i}") for i in range(fuzzy_lines.SAMPLES)])
        both = own.select(*both.columns, *[c.alias(x + s) for c, s in zip(fuzzy_lines._sketch(), fuzzy_lines.SKETCH)])
    least = fuzzy_lines.least_equal(80)
    assert 8 <= least <= 14
    assert sorted(r.equal for r in both.where(fuzzy_lines.near_enough(80)).collect()) == list(range(least, fuzzy_lines.SAMPLES + 1))


def repeats_removed(texts, size):
    docs = [WORD.findall(t or "") for _, t in texts]
    seen = Counter(tuple(w[k:k + size]) for w in docs for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(texts, docs, strict=True):
        gone = {j for k in range(len(w) - size + 1) if seen[tuple(w[k:k + size])] > 1 for j in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_repeats(spark, texts):
    got = substrings.remove_repeats(frame(spark, texts)).collect()
    assert Counter(map(tuple, got)) == Counter(repeats_removed(texts, 35))
    assert substrings.remove_repeats(frame(spark, texts).limit(0)).count() == 0


def test_repeats_of_few_words(spark):
    """Few different words: runs, periods and overlaps of all kinds."""
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choice("ab") if i % 2 else draw.choice("abcdef") for _ in range(draw.randrange(120)))) for i in range(120)]
    got = substrings.remove_repeats(frame(spark, docs), size=12).collect()
    assert Counter(map(tuple, got)) == Counter(repeats_removed(docs, 12))


def test_equal_windows_take_equal_anchors():
    draw = random.Random(5)
    common = [draw.choice("abcdefgh") for _ in range(40)]
    docs = [" ".join(prose(draw, draw.randrange(30)) + common + prose(draw, draw.randrange(30))) for _ in range(50)]
    w = words_of(pa.array(docs))
    g = recompress.groups(w, 35)
    seen = {}
    for key, b, e in zip(g.key.tolist(), g.begin.tolist(), g.end.tolist()):
        for at in range(b, e):
            assert seen.setdefault(tuple(w.code[at:at + 35].tolist()), key) == key


def test_leaks(spark, texts):
    draw = random.Random(8)
    items = [(k, " ".join(prose(draw, n)), "z") for k, n in enumerate((14, 25, 40, 59, 3, 1))] + [(90, "", "z"), (91, None, "z"), (92, "Zz!", "z")]
    docs = list(texts)
    for k, text, _ in items[:5]:
        docs.append((1000 + k, " ".join(prose(draw, 50)) + ".\n" + text.upper().replace(" ", " , ", 2) + "\n" + " ".join(prose(draw, 20))))
    docs.append((2000, " ".join(prose(draw, 30) + changed(draw, items[3][1].split(), 1) + prose(draw, 30))))
    docs.append((2001, " ".join(items[3][1].split()[:30])))
    bench = spark.createDataFrame(items[:5] + items[6:], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert set(got) == {(1000 + k, k) for k in range(5)} | {(2000, 3)}
    assert all(got[1000 + k, k].similarity == 1 and got[1000 + k, k].first_word == 50 for k in range(5))
    assert 0.8 <= got[2000, 3].similarity < 1
    clean = decontaminate.without_leaks(frame(spark, docs), bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in docs if i not in {1000, 1001, 1002, 1003, 1004, 2000})
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.leaks(frame(spark, docs).limit(0), bench).count() == 0


def test_leaks_of_repeated_items_in_any_blocks(spark, monkeypatch):
    draw = random.Random(12)
    own, shared = prose(draw, 60), prose(draw, 30)
    items = [(1, " ".join(own)), (2, " ".join(own).upper())] + [(k, " ".join(prose(draw, 12) + shared)) for k in range(3, 9)]
    docs = [(1, " ".join(prose(draw, 20) + own[:30] + ["edited"] + own[31:] + prose(draw, 20)))]
    for k in range(3, 9):
        words = items[k - 1][1].split()
        docs.append((k, " ".join(prose(draw, 20) + words[:20] + ["edited"] + words[21:] + prose(draw, 20))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (decontaminate.BLOCK_BYTES, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found.append({(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(frame(spark, docs), bench).collect()})
    assert found[0] == found[1]
    assert found[0][1, 1] == found[0][1, 2] == round(51 / 61, 9)


def test_every_pair_within_the_radius_is_found():
    draw = random.Random(1)
    words = [prose(draw, 20) for _ in range(40)]
    index = decontaminate.Index(list(range(40)), [" ".join(w) for w in words])
    near = words_of(pa.array([" ".join(changed(draw, words[i % 40], i // 40)) for i in range(400)]), "plain")
    prints = decontaminate.simhash(near, near.first[:-1], near.counts)
    window, item = index.candidates(prints, near.counts)
    got = set(zip(window.tolist(), item.tolist()))
    for v in range(400):
        for i in range(40):
            close = int(np.bitwise_count(prints[v] ^ index.print[i]).sum()) <= decontaminate.RADIUS and near.counts[v] == index.size[i]
            assert ((v, i) in got) == close


def test_pipeline(spark, sf_dir):
    from test_texts import brute_quality
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = [(i, t) for i, t in docs if brute_quality(t)[-1]]
    kept = [(i, t) for i, t, _, _ in deduped(kept)]
    roots = linked({i: shingle_set(t) for i, t in kept}, 80)
    kept = [(i, t) for i, t in kept if roots[i] == i]
    items = [" ".join(re.sub(r"[^\w\s]|_", " ", r.text.lower()).split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not any(f" {x} " in " " + " ".join(re.sub(r"[^\w\s]|_", " ", t.lower()).split()) + " " for x in items)]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in kept:
        ids = sp.encode(t, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def test_each_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
