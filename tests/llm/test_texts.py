"""Operators on single texts and rows: shards, main text, chat, pieces, rules, scores."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
import sentencepiece
import public_tokenizers
from pyspark.sql import functions as F

from canvass.llm import attention, chat, lm_score, main_text, pieces, quality, shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, shard string, __x string"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in texts], schema)


ODD = [(1, "a b c"), (2, None), (3, ""), (4, " \n\t"), (5, "a b c"), (None, "null id"), (7, "é日😀 \\ < >"), (8, "w " * 5000), (9, "x" * 20000), (5, "a b c")]


def test_shards(spark):
    rows = frame(spark, ODD + [(100 + i, f"text {i % 7}") for i in range(200)]).drop("__x")
    got = shards.shards(rows, 8, seed=5).collect()
    assert len(got) == len(ODD) + 200
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id and r.doc_id >= 100]
    assert order != sorted(order)
    assert shards.shards(rows.limit(0), 8).count() == 0


def test_write_shards(spark, tmp_path):
    rows = frame(spark, [(i, f"t{i}") for i in range(40)]).select("doc_id", "text")
    shards.write_shards(rows, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id for r in back.collect()} == set(range(40)) and back.where("shard = 3").count() == 10


PAGES = {
    "<html><body><nav><a href=x>menu</a></nav><div class='ad-box'>Buy, buy, buy, now</div><article><h1>Head &amp; more</h1><p>One, two.<p>Three <b>bold</b>er"
    "<br>line</p><aside>side</aside></article><div id=comments><p>Nice, very nice, really</p></div><footer>(c)</footer></body>":
        "Head & more One, two. Three bolder line",
    "<body><header><h1>Site</h1></header><div id='main-content'><h2>T</h2><p>" + "long text, with commas, " * 9 + "</p><ul><li>item one</li><li>item two</li></ul>"
    "<form><p>your mail, please</p></form></div><div class=sidebar><p>" + "linked, " * 20 + "</p></div>":
        "T " + ("long text, with commas, " * 9).strip() + " item one item two",
    "<p>bare &lt;p&gt;, text &am": "bare <p>, text &am",
    "<script>var t='<p>no</p>'</script><style>p{}</style><p>yes<!-- no --></p><p hidden>no</p><p style='display: none'>no</p>": "yes",
    "plain only": "plain only", "": "", " \n ": "", "<div><": "<", "<!DOCTYPE html><html><head><title>T</title></head><body></body></html>": "",
}


def test_main_text():
    for page, text in PAGES.items():
        assert main_text.main_text(page) == text
    assert main_text.main_text(None) == ""
    assert main_text.main_text("<p>" + "a " * 100_000 + "</p>") == ("a " * 100_000).strip()


def test_unwanted_elements_without_end_tags():
    real = "Real text, with commas, " * 9
    text = real.strip()
    assert main_text.main_text(f'<article><p class="share">Share<p>{real}</article>') == text
    assert main_text.main_text(f'<article><ul><li class="share">Share<li>{real}</ul></article>') == text
    assert main_text.main_text(f'<table><tr><td class="share">Share<td>{real}<tr class="promo"><td>Buy<tr><td>{real}</table>') == f"{text} {text}"
    assert main_text.main_text(f'<article><div><div class="share">Share<div>deep</div></div>{real}<span class="share">x<span>y</span>z</span></div></article>') == text
    assert main_text.main_text(f'<article><p>{real}<span class="share">Share<p>{real}</article>') == f"{text} {text}"
    assert main_text.main_text(f'<article><p>one <span class="share">Share<b>now</b></span> two, {real}</p></article>') == f"one two, {text}"
    assert main_text.main_text(f'<html><head><meta charset=x><title>t</title><body><p>{real}') == text


@pytest.mark.parametrize("name", "post-comments article-comments page-footer entry-footer content-sidebar main-nav page-header story-share".split())
def test_parts_named_after_the_article(name):
    real = "Real text, with commas, " * 9
    page = f'<div class="content"><p>{real}</p><div class="{name}"><p>{"Other text, with commas, " * 9}</p></div></div>'
    assert main_text.main_text(page) == real.strip()


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "entry-header", "no-comments", "widget post-content", "postBody"])
def test_names_of_what_holds_the_article(name):
    real = "Real text, with commas, " * 9
    assert main_text.main_text(f'<div class="{name}"><p>{real}</p></div>') == real.strip()


def test_broken_and_foreign_markup():
    real = "Real text, with commas, " * 9
    text = real.strip()
    assert main_text.main_text(f'<article><svg width=3 /><p>{real}<svg><path d=1/><title>T</title></svg><svg><g><p>{real}</article>') == f"{text} {text}"
    assert main_text.main_text(f"<article><p title=it's>{real}</p><p>it's {real}</p></article>") == f"{text} it's {text}"
    assert main_text.main_text(f'<article><p title="open>{real}</p><p>{real}</p></article>') == f"{text} {text}"
    assert main_text.main_text(f'<article><p title="a > b">{real}<a class="share" href=x>Share</a></p></article>') == text
    assert main_text.main_text(f"<article><p>1 < 2, {real}</p></article>") == f"1 < 2, {text}"


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>a" * 80_000, "<form>" + "<b><i></u>" * 100_000, "<ul>" + "<div><li>" * 60_000, '<a x=">" ' * 120_000 + "y='",
                                  "<!--" * 250_000, "<script>" * 120_000])
def test_time_grows_with_the_page(page):
    started = time.process_time()
    main_text.main_text(page)
    assert time.process_time() - started < 10


def test_extract_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a  b</p>", 1), (2, None, None, 2), (1, "u", "<p>a  b</p>", 1)], "page_id long, url string, html string, text long")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in main_text.extract(rows).collect() if r.page_id == 1)
    assert got == [(1, "u", "a b", 3)] * 2
    assert main_text.extract(rows.limit(0)).count() == 0


def test_extract_synthetic_pages(spark, sf_dir):
    for r in main_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_chat_round_trip(spark):
    tricky = ["\\### Assistant: </turn> ok", "<turn user>\\l\\b\\g", "", None, "é\n</turn>\n", "\\" * 7 + "<" * 3]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "c") for i, t in enumerate(tricky)]
    rows += [(2, 5, "a>b<", "x", "c"), (2, 5, None, "x", "c"), (2, None, "assistant", "first", "c"), (None, 1, "assistant", "n", "c"), (None, 1, "assistant", "n", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df).withColumns({
        "back": chat.read_back(F.col("formatted")), "learned": chat.masked_text(F.col("formatted"), F.col("loss"))})
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(r[2], r[3] or "") for r in rows[:6]]
    assert got[1].learned == "".join(r[3] or "" for r in rows[:6] if r[2] == "assistant")
    assert [(t.role, t.text) for t in got[2].back] == [("assistant", "first"), ("", "x"), ("a>b<", "x")]
    assert got[None].learned == "nn" and got[None].n_turns == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <this>", None, 0), ("image", None, "i.png", 2), ("audio", None, "a.wav", 3), ("document", None, "d.pdf", None), ("text", "end", None, 0)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, c array<{chat.PART}>")
    r = chat.format_conversations(df, content=F.col("c")).first()
    assert r.formatted == "<turn user>see \\lthis><image><audio><document>end</turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 512), ("audio", "a.wav", 75), ("document", "d.pdf", 500)]
    assert all(r.formatted[a.start:].startswith(f"<{a.kind}>") for a in r.attachments) and r.n_attachment_tokens == 1087


def test_chat_parts_of_other_kinds(spark):
    parts = [("video", None, "v.mp4", 7), ("text", "a", None, 0), (None, "b", "x", None), (None, None, None, None), ("image", None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, c array<{chat.PART}>")
    r = chat.format_conversations(df, content=F.col("c")).first()
    assert r.formatted == "<turn assistant><other>a<other><other><image></turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("video", "v.mp4", 7), ("other", "x", 1), ("other", None, 1), ("image", None, 256)]
    assert all(r.formatted[a.start:].startswith("<image>" if a.kind == "image" else "<other>") for a in r.attachments)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_pieces_like_the_library(library):
    model = pieces.PieceModel(public_tokenizers.path(pieces.MODEL))
    draw = random.Random(4)
    texts = ["", " ", "   ", "▁", "a▁b  ▁▁ c", "\n\n", "\t x\r\n", "<s></s><unk><0x41>", "日本語 текст 😀😀 ﬁ\x00", "x" * 300 + "  " * 40 + "é" * 100, "aaaa bbbb" * 50, "�"]
    texts += ["".join(draw.choice(" ab▁theinon\n\té日😀ing.,") for _ in range(draw.randint(0, 300))) for _ in range(500)]
    ids, begins, ends, first = model.encode(texts)
    decoded = model.decode(ids, first).to_pylist()
    for i, text in enumerate(texts):
        own = slice(first[i], first[i + 1])
        want = library.encode(text, add_eos=True)
        assert ids[own].tolist() == want and decoded[i] == library.decode(want)
        # The spans lie one after the other and cover the text.
        spans = list(zip(begins[own].tolist(), ends[own].tolist(), strict=True))
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0 and spans[-1][1] == len(text.encode())


def test_bytes_that_are_no_character(library):
    model = pieces.PieceModel(public_tokenizers.path(pieces.MODEL))
    import numpy as np
    ids = np.array([3 + 0xE6, 3 + 0x97, 1526, 3 + 0xFF])
    assert model.decode(ids, np.array([0, 4])).to_pylist() == [library.decode(ids.tolist())]


def test_character_map_longest_prefix():
    # A double array for the keys "a" -> "x" and "ab" -> "yz", built by hand.
    units = [0] * 1024
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = (a ^ 512) << 10 | 1 << 8 | ord("a")
    units[512] = 1 << 31 | 0
    b = 512 ^ ord("b")
    units[b] = (b ^ 768) << 10 | 1 << 8 | ord("b")
    units[768] = 1 << 31 | 2
    blob = len(units) * 4
    m = pieces.CharacterMap(blob.to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"x\0yz\0")
    assert m.normalise("aabcé") == ("xyzcé", [(0, 1), (1, 3), (1, 3), (3, 4), (4, 6)])


def test_piece_rows(spark, library):
    got = pieces.digests(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for i, t in ODD:
        ids = library.encode(t or "", add_eos=True)
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert row in [tuple(r) for r in got]
    assert pieces.digests(frame(spark, ODD).limit(0)).count() == 0


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    hit = {j for k in range(len(words) - 4) if grams[tuple(words[k:k + 5])] > 1 for j in range(k, k + 5)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 10 or 100 * len(hit) > 20 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    chars = sum(map(len, words))
    kept = not (failed or symbols > n or 2 * len(set(full)) < len(full) or 2 * chars < 3 * n or chars > 25 * n)
    return n, chars, symbols, len(full) - len(set(full)), len(hit), failed, kept


QUALITY = ODD + [
    (20, "one two three four five six seven eight nine ten eleven"), (21, "a b c d e f a b c d e g " + "u v w x y z k l m n o p q r s t " * 1),
    (22, "\n".join(["same line here"] * 9 + ["p q r s t u v"])), (23, "## ** $$ %% && || << >> " * 2 + "q w e r t y u i o p a s"), (24, "a " * 11),
    (25, "\x0b\x0cone\rtwo\u00a0three four five six seven eight nine ten eleven twelve\x1f"), (26, " ".join(f"w{i}" for i in range(3000)))]


def test_quality_against_brute_force(spark):
    got = quality.measured(frame(spark, QUALITY)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute_quality(t)) for i, t in QUALITY), key=str)
    assert quality.measured(frame(spark, QUALITY).limit(0)).count() == 0


def test_cascade_order_does_not_matter(spark):
    docs = frame(spark, QUALITY)
    names = list(quality.RULES)
    for order in (names, names[::-1]):
        kept = docs.where(quality.rejected_by(F.col("text"), order).isNull()).select("doc_id").collect()
        assert Counter(r.doc_id for r in kept) == Counter(i for i, t in QUALITY if brute_quality(t)[-1])
    assert set(quality.cascade(docs)) == set(names)
    assert quality.keep_good(docs).columns == docs.columns


def test_scores(spark):
    draw = random.Random(2)
    docs = ODD + [(i, " ".join(draw.choice(["the", "Cat", "sat", "mat", f"r{i}"]) for _ in range(60))) for i in range(50, 90)]
    got = lm_score.score(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = [(i, WORD.findall((t or "").translate(fold)) + ["\n"]) for i, t in docs]
    away = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs}
    c = Counter(w for i, ws in words if not away[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, away[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in words)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_score.score(frame(spark, docs).limit(0)).count() == 0


def plain_log_probabilities(p, ids):
    """Log probability of each id of one text: every id in one window, one softmax at a time."""
    import numpy as np
    out = []
    for step in range(1 + max(0, -(-(len(ids) - attention.LENGTH) // attention.STRIDE))):
        at = step * attention.STRIDE
        seen = [ids[i - 1] if i else attention.END for i in range(at, min(at + attention.LENGTH, len(ids)))]
        for j in range(len(out) - at, len(seen)):
            h = p["E"][seen[: j + 1]]
            weights = (h @ p["k"]) @ (h[j] @ p["q"]) * attention.WIDTH ** -0.5 + p["near"][j - np.arange(j + 1)]
            weights = np.exp(weights - weights.max())
            z = h[j] + (weights / weights.sum()) @ (h @ p["v"])
            group, member = ids[at + j] % attention.CLASSES, ids[at + j] // attention.CLASSES
            total = 0.0
            for logits, picked in ((p["u"] @ z + p["a"], group), (p["w"][group::attention.CLASSES] @ z + p["c"][group::attention.CLASSES], member)):
                total += logits[picked] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
            out.append(total)
    return out


@pytest.mark.parametrize("scale", [1, 40])
def test_scores_of_given_parameters(spark, monkeypatch, scale):
    """Large parameters have logits whose exponentials do not exist."""
    import numpy as np
    import public_tokenizers
    vector = attention.flat(attention.fresh(9)) * np.float32(3 * scale)
    vector += np.random.default_rng(1).normal(0, 0.3, len(vector)).astype(np.float32)
    monkeypatch.setattr(lm_score, "train", lambda *a: vector)
    draw = random.Random(8)
    docs = [(i, " ".join(draw.choice(["the", "Cat", "sat", "matting", f"r{i}"]) for _ in range(5 * i % 47))) for i in range(30)]
    got = {r.doc_id: r.score for r in lm_score.score(frame(spark, docs)).collect()}
    p = {k: v.astype(np.float64) for k, v in attention.shaped(vector).items()}
    coder = attention.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    split = {i: t.lower().split() + ["\n"] for i, t in docs}
    counts = Counter(w for i, t in split.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in split.items():
        ids, first, _ = coder.encode([[w.encode() for w in t[:-1]]])
        logs = np.add.reduceat(plain_log_probabilities(p, ids.tolist()), first)
        want = sum(math.log10(0.75 * (counts[w] + 0.5) / (total + 0.5 * (distinct + 1)) + 0.25 * math.exp(x)) for w, x in zip(t, logs))
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 1 << 14)
    monkeypatch.setattr(lm_score, "FAN", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, eight = ({r.doc_id: r for r in lm_score.score(docs.repartition(n)).collect()} for n in (1, 8))
    assert one == eight and len(one) == docs.count()


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = lm_score.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert len(rows) > 100 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_learns_from_every_id_of_each_training_text():
    import pyarrow as pa
    import public_tokenizers
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["the", "Cat", "mat", f"long{i}" * 20]) for _ in range(300 * i)) for i in range(5)] + [None]
    coder = attention.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    _, target, scored = lm_score._lessons(coder, pa.array(texts))
    code, first, _ = coder.encode(lm_score._split(pa.array(texts)))
    assert target[scored].tolist() == code.tolist()
    assert (target[scored] == attention.END).sum() == len(texts)


def test_each_round_trains_on_all_lessons(monkeypatch):
    """The number of windows that weigh a task's parameters is that of all windows of the training texts."""
    import public_tokenizers
    from types import SimpleNamespace
    import pyarrow as pa
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids, texts = list(range(20)), ["some words of a text " * 40] * 20
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([ids]), pa.array([texts])], names=["chunk", "ids", "texts"])
    monkeypatch.setattr(lm_score.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    learn = [t for i, t in zip(ids, texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    want = len(lm_score._lessons(attention.Coder(path), pa.array(learn))[0])
    for number in range(lm_score.ROUNDS):
        out, = lm_score._trained(path, SimpleNamespace(value=attention.flat(attention.fresh())), number)(iter([batch]))
        assert out.column("weight").to_pylist() == [want]


def test_rounds_and_scores_read_no_text(monkeypatch):
    """Chunks hold subword ids; neither rounds nor scores encode again, and words are told apart by their ids."""
    import numpy as np
    import public_tokenizers
    from types import SimpleNamespace
    import pyarrow as pa
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids, texts = list(range(20)), [f"The words of text{i} " * 40 for i in range(18)] + ["", None]
    table = pa.table({"chunk": [0] * 20, "h": ids, "doc_id": ids, "text": texts})
    packed = lm_score._packed(path)(table)
    counted, = lm_score._counted(iter(packed.select(["chunk", "learn", "code"]).to_batches()))
    want = Counter(w for i, t in zip(ids, texts) if zlib.crc32(str(i).encode()) % 5 != 1 for w in (t or "").lower().split() + ["\n"])
    assert sorted(counted.column("n").to_pylist()) == sorted([want[w] for w in {w for t in texts for w in (t or "").lower().split() + ["\n"]}])
    monkeypatch.setattr(lm_score.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    vector = attention.flat(attention.fresh())
    raw = pa.table({"chunk": [0], "ids": [ids], "texts": [texts]})
    train = lambda path, rows: next(lm_score._trained(path, SimpleNamespace(value=vector), 0)(iter(rows.to_batches())))
    first = train(path, raw)
    monkeypatch.setattr(attention, "coder", None)
    assert train(None, packed.select(["chunk", "learn", "sizes", "code"])).equals(first)
    known = pa.table({"chunk": [0] * counted.num_rows, "word": counted.column("word"), "c": counted.column("n")})
    got = lm_score._scored(SimpleNamespace(value=vector), 100, 10)(packed, known)
    assert got.column("doc_id").to_pylist() == ids and got.column("n_tokens").to_pylist() == [len((t or "").split()) + 1 for t in texts]
    assert np.isfinite(got.column("score").to_numpy()).all()


def test_windows_score_each_id_once():
    import numpy as np
    sizes = [1, 2, 15, 16, 17, 28, 29, 100]
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.arange(first[-1])
    x, target, scored = attention.windows(ids, first)
    assert target[scored].tolist() == ids.tolist()
    starts = set(first[:-1].tolist())
    for s, t, m in zip(x, target, scored):
        assert all(a == b - 1 or b in starts for a, b, k in zip(s.tolist(), t.tolist(), m) if k)


def test_attention_gradient_and_learning():
    import numpy as np
    draw = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in attention.fresh().items()}
    x, t = draw.integers(0, attention.END, (3, attention.LENGTH)), draw.integers(0, attention.END, (3, attention.LENGTH))
    mask = draw.random(x.shape) < 0.7
    _, g = attention.gradient(p, x, t, mask)
    for key, spot in (("q", (1, 2)), ("k", (3, 4)), ("v", (0, 5)), ("near", (2,)), ("u", (int(t[mask][0]) % attention.CLASSES, 3)), ("E", (int(x[0, 0]), 1))):
        up, down = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in p.items()}
        up[key][spot] += 1e-5
        down[key][spot] -= 1e-5
        slope = (attention.gradient(up, x, t, mask)[0] - attention.gradient(down, x, t, mask)[0]) / 2e-5
        assert slope == pytest.approx(g[key][spot], rel=1e-3, abs=1e-7)
    teacher = attention.Trainer(attention.fresh())
    everything = np.ones_like(mask)
    losses = [teacher.step(x, t, everything) for _ in range(60)]
    assert losses[-1] < 0.5 * losses[0]
    inner = attention.log_probabilities(teacher.p, x, t, everything)
    assert -inner.mean() == pytest.approx(attention.gradient(teacher.p, x, t, everything)[0], rel=1e-3)
