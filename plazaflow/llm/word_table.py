"""A table from words to token ids in flat numpy arrays.

Words are found by two 64-bit polynomial hashes with different odd bases, which one pass of cumulative sums
over a text's bytes gives for all its words at once, and by their length; a word that is found is held to its bytes, eight at
a time, so that no two words are ever taken for one another. Words longer than ``LONGEST`` bytes are not kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LONGEST = 48
#: Bytes that are hashed at once; tables of powers are as long.
PIECE = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int, held: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if len(held.get(base, ())) < n:
        factors = np.full(max(n, PIECE + 1), base, np.uint64)
        factors[0] = 1
        held[base] = np.cumprod(factors)
    return held[base][:n]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The hashes of data[starts:ends]."""
    out = []
    for base in BASES:
        inverse = pow(base, -1, 1 << 64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data)))])
        out.append((total[ends] - total[starts]) * _powers(inverse, len(data) + 1)[starts])
    return out


class Lanes:
    """Reads the words of ``data`` eight bytes at a time, as longs whose bytes beyond the word are zero."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(LONGEST + 8, np.uint8)])
        self.at = np.ndarray((len(data) + LONGEST,), "<u8", padded.data, strides=(1,))

    def lane(self, j: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Bytes 8 j to 8 j + 7 of words that are longer than 8 j."""
        unused = np.maximum(0, 8 * (j + 1) - length).astype(np.uint64) * np.uint64(8)
        return self.at[start + 8 * j] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> unused)


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data`` between ASCII white space."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


WHITE = b" \t\n\x0b\x0c\r"


def cut_between_words(text: bytes) -> list[bytes]:
    """Pieces of ``PIECE`` bytes at most, but for words that are longer, each of which is a piece of its own."""
    out = []
    while len(text) > PIECE:
        at = max(text.rfind(c, 0, PIECE) for c in (WHITE[i : i + 1] for i in range(len(WHITE)))) + 1
        if not at:  # the piece starts with a long word
            found = [i for c in range(len(WHITE)) if (i := text.find(WHITE[c : c + 1])) >= 0]
            at = min(found, default=len(text))
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


class WordTable:
    """encode_words: ids of each word of a list, as (flat ids, number of ids of each). most: words kept."""

    def __init__(self, encode_words: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode_words, self.most, self.n, self.n_ids = encode_words, most, 0, 0
        self.slots = np.full(1 << max(4, (2 * most - 1).bit_length()), -1, np.int32)
        self.shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
        self.check = np.zeros((most, 2), np.uint64)
        self.length = np.zeros(most, np.int32)
        self.bytes = np.zeros((LONGEST // 8, most), np.uint64)
        self.first = np.zeros(most, np.int64)
        self.count = np.zeros(most, np.int32)
        self.ids = np.zeros(4 * most, np.uint32)

    def _same(self, entry: np.ndarray, lanes: Lanes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether entries hold the words, whose lengths are theirs."""
        out = np.ones(len(entry), bool)
        at = np.arange(len(entry))
        for j in range(LONGEST // 8):
            at = at[length[at] > 8 * j]
            if not len(at):
                break
            out[at] &= self.bytes[j, entry[at]] == lanes.lane(j, start[at], length[at])
        return out

    def _find(self, h: list[np.ndarray], length: np.ndarray, lanes: Lanes, start: np.ndarray) -> np.ndarray:
        out = np.full(len(length), -1, np.int64)
        at = (h[0] >> self.shift).astype(np.int64)
        left = np.flatnonzero(length <= LONGEST)
        while len(left):
            entry = self.slots[at[left]]
            left, entry = left[entry >= 0], entry[entry >= 0]
            same = (self.check[entry, 0] == h[0][left]) & (self.check[entry, 1] == h[1][left]) & (self.length[entry] == length[left])
            hit = np.flatnonzero(same)
            same[hit] = self._same(entry[hit], lanes, start[left[hit]], length[left[hit]])
            out[left[same]] = entry[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        return out

    def _add(self, h: list[np.ndarray], length: np.ndarray, lanes: Lanes, start: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """Keep words, all different and new, as far as there is room."""
        first = np.cumsum(count) - count
        ok = np.flatnonzero(length <= LONGEST)[: self.most - self.n]
        ok = ok[: int(np.searchsorted(np.cumsum(count[ok]), len(self.ids) - self.n_ids, "right"))]
        if not len(ok):
            return
        new = np.arange(self.n, self.n + len(ok))
        self.check[new, 0], self.check[new, 1], self.length[new], self.count[new] = h[0][ok], h[1][ok], length[ok], count[ok]
        for j in range(LONGEST // 8):
            long = length[ok] > 8 * j
            self.bytes[j, new[long]] = lanes.lane(j, start[ok[long]], length[ok[long]])
        self.first[new] = self.n_ids + np.cumsum(count[ok]) - count[ok]
        got = flat[ragged(first[ok], count[ok])]
        self.ids[self.n_ids : self.n_ids + len(got)] = got
        self.n, self.n_ids = self.n + len(ok), self.n_ids + len(got)
        at = (h[0][ok] >> self.shift).astype(np.int64)
        left = np.arange(len(ok))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = new[free]  # of several that want a slot the last gets it
            left = left[self.slots[at[left]] != new[left]]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, by pieces of ``PIECE`` bytes at most that end between words."""
        parts = [cut_between_words(t) for t in texts]
        flat = [p for ps in parts for p in ps]
        done: list[np.ndarray] = []
        lo = 0
        while lo < len(flat):
            hi, size = lo + 1, len(flat[lo])
            while hi < len(flat) and size + len(flat[hi]) + 1 <= PIECE:
                size, hi = size + len(flat[hi]) + 1, hi + 1
            if size > PIECE:  # a word longer than that
                done.append(self.encode_words([flat[lo].strip(WHITE)])[0])
            else:
                done += self._encode(flat[lo:hi])
            lo = hi
        out, at = [], 0
        for ps in parts:
            out.append(done[at] if len(ps) == 1 else np.concatenate(done[at : at + len(ps)]))
            at += len(ps)
        return out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        starts, ends = spans(data)
        limits = np.cumsum([len(t) + 1 for t in texts])
        h, length, lanes = hashes(data, starts, ends), ends - starts, Lanes(data)
        entry = self._find(h, length, lanes, starts)
        missing = np.flatnonzero(entry < 0)
        first, count, ids = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), self.ids
        known = np.flatnonzero(entry >= 0)
        first[known], count[known] = self.first[entry[known]], self.count[entry[known]]
        if len(missing):
            # equal words once; long ones each for itself
            key = np.zeros(len(missing), [("a", np.uint64), ("b", np.uint64), ("n", np.int64)])
            key["a"], key["b"] = h[0][missing], h[1][missing]
            key["n"] = np.where(length[missing] <= LONGEST, length[missing], -1 - np.arange(len(missing)))
            _, one, of = np.unique(key, return_index=True, return_inverse=True)
            # a word of the same hashes that is another is one of its own, and is not kept
            short = np.flatnonzero(key["n"] >= 0)
            a, b = missing[short], missing[one[of[short]]]
            other = np.zeros(len(short), bool)
            for j in range(LONGEST // 8):
                at = np.flatnonzero(length[a] > 8 * j)
                other[at] |= lanes.lane(j, starts[a[at]], length[a[at]]) != lanes.lane(j, starts[b[at]], length[b[at]])
            apart = short[other]
            of[apart] = len(one) + np.arange(len(apart))
            rep = np.concatenate([missing[one], missing[apart]])
            raw = data.tobytes()
            flat, n = self.encode_words([raw[i:j] for i, j in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)])
            first[missing], count[missing] = (len(ids) + np.cumsum(n) - n)[of], n[of]
            ids = np.concatenate([ids, flat])
            kept, known = slice(len(one)), int(n[: len(one)].sum())
            rep = rep[kept]
            self._add([x[rep] for x in h], length[rep], lanes, starts[rep], flat[:known], n[kept])
        out = ids[ragged(first, count)]
        total = np.concatenate([[0], np.cumsum(count)])
        bounds = total[np.searchsorted(starts, limits)]
        return np.split(out, bounds[:-1]) if len(texts) else []


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, and so on for each."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + count, count)
