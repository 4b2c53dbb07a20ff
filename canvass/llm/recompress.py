"""Recompression of word sequences: equal sequences get equal symbols, away from their ends.

A sequence of words is rewritten in rounds.  The first names runs of one word, the others name
pairs: each symbol is a left or a right one, by a hash of its name and the round, and a left one
followed by a right one becomes one symbol.  A name is the fingerprint of what it stands
for, so it is the same everywhere without a table of names.  Symbols of ``LONG`` words or more
are finished.

With each symbol goes its *evidence*: the range of words that decided it.  Wherever these words
stand, this symbol comes out.  A finished symbol is an anchor of all windows that contain its
evidence; each window takes the one with the least fingerprint.  So equal windows take equal
anchors.  A window without any anchor is its own anchor, so nothing is missed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from canvass.llm.words import U64, Words, mix

LONG, ROUNDS = 4, 6
_NONE = U64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Symbols:
    """Symbols of some texts in order: name, words [start, end), evidence [lo, hi), number of the text."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    text: np.ndarray

    def take(self, keep: np.ndarray) -> Symbols:
        return Symbols(*(x[keep] for x in (self.name, self.start, self.end, self.lo, self.hi, self.text)))


def _name_runs(words: Words) -> Symbols:
    n, text = len(words.code), words.text
    same = (words.code[1:] == words.code[:-1]) & (text[1:] == text[:-1])
    start = np.flatnonzero(np.concatenate([[True], ~same])[:n])
    end = np.append(start[1:], n)[: len(start)]
    size = (end - start).astype(U64)
    # That a run ends shows only by the word beside it, or by the end of the text (one place further).
    return Symbols(np.where(size > 1, mix(words.code[start] + size), words.code[start]), start, end, start - 1, end + 1, text[start])


def _name_pairs(s: Symbols, number: int) -> Symbols:
    n = len(s.name)
    side = mix(s.name ^ U64(0x51ED270B * number + 7)) >> U64(63)
    free = s.end - s.start < LONG
    linked = s.text[1:] == s.text[:-1]
    pair = np.zeros(n, bool)
    pair[:-1] = linked & free[1:] & free[:-1] & (side[:-1] == 0) & (side[1:] == 1)
    right = np.zeros(n, bool)
    right[1:] = pair[:-1]
    alone = free & ~pair & ~right
    # What stays alone does so because of its neighbour on the side it looks to.
    back, ahead = alone & (side == 1), alone & (side == 0)
    lo, hi = s.lo.copy(), s.hi.copy()
    before = np.concatenate([s.start[:1] - 1, np.where(linked, s.lo[:-1], s.start[1:] - 1)])[:n]
    after = np.concatenate([np.where(linked, s.hi[1:], s.end[:-1] + 1), s.end[-1:] + 1])[:n]
    lo[back] = np.minimum(lo, before)[back]
    hi[ahead] = np.maximum(hi, after)[ahead]
    name, end = s.name.copy(), s.end.copy()
    at = np.flatnonzero(pair)
    name[at] = mix(s.name[at] * U64(0xC2B2AE3D27D4EB4F) + mix(s.name[at + 1] + U64(number)))
    end[at] = s.end[at + 1]
    lo[at], hi[at] = np.minimum(lo[at], s.lo[at + 1]), np.maximum(hi[at], s.hi[at + 1])
    return Symbols(name, s.start, end, lo, hi, s.text).take(~right)


def parse(words: Words, rounds: int = ROUNDS) -> Symbols:
    s = _name_runs(words)
    for r in range(1, rounds + 1):
        s = _name_pairs(s, r)
    return s


@dataclass
class Groups:
    """Windows in groups that took the same anchor: starts [begin, end) in words, anchor key, key of all words the group spans."""

    key: np.ndarray
    whole: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray


def groups(words: Words, size: int) -> Groups:
    """All windows of ``size`` words, grouped by anchor."""
    n = len(words.code)
    at = words.windows(size)
    if not len(at):
        return Groups(*(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64)))
    text = words.text
    first, last = words.first[:-1][text], words.first[1:][text]
    s = parse(words)
    s = s.take((s.end - s.start >= LONG) & (s.hi - s.lo <= size))
    s = s.take((s.lo >= first[s.start]) & (s.hi <= last[s.start]))
    key = mix(words.spans(s.lo, s.hi) + (s.start - s.lo).astype(U64) + U64(64) * (s.end - s.start).astype(U64))
    low, high = np.maximum(s.hi - size, first[s.start]), np.minimum(s.lo, last[s.start] - size)
    best = np.full(n, _NONE, U64)
    winner = np.full(n, n, np.int64)
    order = np.arange(len(key))
    steps = int((high - low).max()) + 1 if len(low) else 0
    for j in range(steps):
        i = np.flatnonzero(low + j <= high)
        np.minimum.at(best, low[i] + j, key[i])
    for j in range(steps):
        i = np.flatnonzero(low + j <= high)
        i = i[best[low[i] + j] == key[i]]
        np.minimum.at(winner, low[i] + j, order[i])
    own, who = best[at], winner[at]
    bare = own == _NONE
    own[bare] = words.spans(at[bare], at[bare] + size)
    fresh = np.ones(len(at), bool)
    fresh[1:] = bare[1:] | bare[:-1] | (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(at)) - 1
    b, e = at[begin], at[end] + 1
    return Groups(own[begin], words.spans(b, e - 1 + size), b, e, text[b])
