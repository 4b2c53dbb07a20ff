"""Subword pieces of a public piece model with source spans, and texts back from piece ids.

Encoding normalises a text by the longest matching prefix in the model's compiled character
map (a double array of states), keeping for each output character the source bytes it came
from.  Then the pair of neighbours with the best score is merged until none is in the vocabulary;
characters without a piece fall back to bytes.  Each piece is projected to its source bytes.

Merges never cross the start of a blank run, nor a character that only occurs alone in the
vocabulary; so the text is cut there, and what lies between is encoded once and remembered.

A null text is empty.  An empty text has the end id only.  Repeated rows are encoded alike.
Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from canvass.llm.words import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Remembered segments; beyond that the memory starts anew.
MEMORY = 600_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """Longest-prefix replacement through a compiled double-array trie."""

    def __init__(self, blob: bytes):
        self.units, self.texts = np.zeros(0, np.uint32), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4:4 + size], np.uint32)
            self.texts = blob[4 + size:]
        self._units = self.units.tolist()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        units, found = self._units, None
        if not units:
            return None
        place = self._offset(units[0])
        for k in range(at, len(data)):
            place ^= data[k]
            if place >= len(units) or units[place] & 0x800000FF != data[k]:
                break
            unit = units[place]
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                begin = units[place] & 0x7FFFFFFF
                found = k + 1 - at, self.texts[begin:self.texts.index(b"\0", begin)]
        return found

    def normalise(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The replaced text, and for each of its characters the source bytes."""
        data = text.encode()
        out, spans, at = [], [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, data[at:at + size]
            put = hit[1].decode("utf-8", "replace")
            out.append(put)
            spans.extend([(at, at + hit[0])] * len(put))
            at += hit[0]
        return "".join(out), spans


class PieceModel:
    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("a model that keeps blanks and marks the first word is expected")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, USER, UNUSED)}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.end = self.ids["</s>"]
        self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)]
        raw = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else
               " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.is_byte = np.array([p.type == BYTE for p in proto.pieces])
        self.sizes = np.array([len(r) for r in raw])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        joined = {c for p in self.score if len(p) > 1 for c in p}
        inner = "".join(re.escape(c) for c in sorted(joined - {MARK}))
        self.cut = re.compile(f"[ {MARK}]*[{inner}]+|[ {MARK}]+|[^{inner} {MARK}]")
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.id_list, self.size_list, self.begin_list = array("i"), array("q"), array("q", [0])

    def merged(self, marks: str) -> list[str]:
        """Pieces of one segment: always the best pair, on ties the leftmost."""
        parts, score = list(marks), self.score
        if len(parts) > 200:
            return self._merged_long(parts)
        none = float("-inf")
        pairs = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > none:
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score.get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = score.get(parts[at] + parts[at + 1], none)
        return parts

    def _merged_long(self, parts: list) -> list[str]:
        score, n = self.score, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                both = parts[i] + parts[j]
                if (s := score.get(both)) is not None:
                    heapq.heappush(queue, (-s, i, both))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _learn(self, segment: str) -> int:
        """Number under which the segment's ids and source sizes are remembered."""
        plain, narrow = segment.replace(" ", MARK), segment.isascii()
        at = 0
        for piece in self.merged(plain):
            size = len(piece) if narrow else len(segment[at:at + len(piece)].encode())
            at += len(piece)
            ident = self.ids.get(piece)
            if ident is None or piece not in self.score:
                raw = piece.encode()
                fallback = [self.bytes[b] for b in raw]
                if None in fallback:
                    self.id_list.append(self.unknown)
                    self.size_list.append(size)
                else:
                    self.id_list.extend(fallback)
                    # The bytes of one character share its span: the first one covers it.
                    self.size_list.extend([size] + [0] * (len(raw) - 1))
            else:
                self.id_list.append(ident)
                self.size_list.append(size)
        self.begin_list.append(len(self.id_list))
        self.known[segment] = out = len(self.begin_list) - 2
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, span begins, span ends of all texts, and the first place of each text; each text ends with the end id."""
        if len(self.known) > MEMORY:
            self.reset()
        known, learn, cut = self.known, self._learn, self.cut.findall
        numbers: list[int] = []
        counts, aligned = [], []
        for text in texts:
            if self.map._units and text:
                text, spans = self.map.normalise(text)
                aligned.append(spans)
            segments = cut(" " + text) if text else ()
            numbers.extend([known[s] if s in known else learn(s) for s in segments])
            counts.append(len(segments))
        begin = np.array(self.begin_list, np.int64)
        seg = np.array(numbers, np.int64)
        sizes = begin[seg + 1] - begin[seg]
        seg_first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(begin[seg] - seg_first[:-1], sizes) + np.arange(seg_first[-1])
        ids, source = np.array(self.id_list, np.int32)[at], np.array(self.size_list, np.int64)[at]
        first = seg_first[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        ends = np.cumsum(source)
        base = np.repeat(np.concatenate([[0], ends])[first[:-1]], np.diff(first))
        ends = ends - base
        # The mark before the first word has no source.
        begins, ends = np.maximum(ends - source - 1, 0), np.maximum(ends - 1, 0)
        if self.map._units:
            begins, ends = self._project(begins, ends, first, texts, aligned)
        n, texts_n = len(ids), len(texts)
        places = np.arange(n) + np.repeat(np.arange(texts_n), np.diff(first))
        full = np.full(n + texts_n, self.end, np.int32)
        full[places] = ids
        lo, hi = np.zeros(n + texts_n, np.int32), np.zeros(n + texts_n, np.int32)
        lo[places], hi[places] = begins, ends
        stops = first[1:] + np.arange(texts_n)
        lengths = np.zeros(texts_n, np.int64)
        some = np.flatnonzero(np.diff(first))
        lengths[some] = ends[first[1:][some] - 1]
        lo[stops] = hi[stops] = lengths
        return full, lo, hi, first + np.arange(texts_n + 1)

    def _project(self, begins, ends, first, texts, aligned):
        """Spans in the normalised text to spans in the source."""
        rows = iter(aligned)
        begins, ends = begins.copy(), ends.copy()
        for d, text in enumerate(texts):
            if not text:
                continue
            spans = next(rows)
            plain = self.map.normalise(text)[0]
            char = np.repeat(np.arange(len(plain)), [len(c.encode()) for c in plain])
            a, b = slice(first[d], first[d + 1]), len(text.encode())
            lo = np.array([s[0] for s in spans] + [b])
            hi = np.array([0] + [s[1] for s in spans])
            char = np.append(char, len(plain))
            covered = ends[a] > begins[a]
            last = np.where(covered, char[np.maximum(ends[a] - 1, 0)] + 1, 0)
            begins[a], ends[a] = lo[char[begins[a]]], np.where(covered, hi[last], lo[char[begins[a]]])
        return begins, ends

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Texts of id rows [first[i], first[i + 1])."""
        sizes = self.sizes[ids].copy()
        starts = self.starts[ids].copy()
        # The mark of the first piece is not part of the text.
        heads = first[:-1][np.diff(first) > 0]
        drop = heads[(sizes[heads] > 0) & (self.flat[np.minimum(starts[heads], len(self.flat) - 1)] == 0x20) & ~self.is_byte[ids[heads]]]
        starts[drop] += 1
        sizes[drop] -= 1
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        offsets = ends[first]
        raw = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([_lenient(b.as_py()) for b in raw], pa.string())


def _lenient(raw: bytes) -> str:
    """Bytes that are no character become one replacement character each."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


@lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, lo, hi, first = m.encode([t.as_py() or "" for t in batch.column(1).slice(a, b - a)])
                places = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), *(pa.ListArray.from_arrays(places, pa.array(x)) for x in (ids, lo, hi)), m.decode(ids, first),
                ], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return run


def encode_decode(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, begins, ends, decoded)``: piece ids with an end id, source byte spans, and the text from the ids."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string"
    return rows.mapInArrow(_coded(path or public_tokenizers.path(MODEL)), schema)


def digests(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the encoded and decoded texts."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode_decode(documents, path, id_col, text_col).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
