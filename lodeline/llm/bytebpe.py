"""Byte-level BPE over whole batches of texts, without regular expressions.

A batch is joined into one array of code points and every step is an array operation over it:

1. a table maps each code point to its class (letter, number, white space, other);
2. the pre-token boundaries of the public pattern
   ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` come from the
   transitions between neighbouring classes. The only unbounded memory the pattern needs is where the
   current run began; it is carried by a running maximum, an associative scan (as the composition of the
   transition functions "a run starts at i" / "keep the run" is);
3. equal slices are found by a rolling hash (prefix sums), compared symbol by symbol so that a hash collision
   cannot change a result, and only the distinct ones of a batch go to the cached pair merging.

Documents never mix: a document's first symbol always starts a slice and nothing looks across its ends.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pandas as pd

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points with Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe in a contraction, in the pattern's order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Longest array worked on at once, in symbols; a longer text is an array of its own.
CHUNK = 1 << 20
#: Entries after which the cache of merged slices starts anew (it only saves time).
CACHE = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[list(WHITE_SPACE)] = SPACE
        _classes = t
    return _classes


def starts_of(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which a slice starts. cp: code points; first: True at each document's first symbol."""
    n = len(cp)
    cls = class_table()[cp]
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(run)
    run_start = np.zeros(n, np.int64)
    run_start[at] = at
    np.maximum.accumulate(run_start, out=run_start)
    white = cls == SPACE
    # Each run starts a slice, but a single blank before it (in the same document) is part of that slice.
    start = run.copy()
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (cp[:-1] == 32) & ~first[1:]
    start[run & blank_before & ~white] = False
    # The last white space before something else stands alone or joins what follows.
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start[last] = True
    # Contractions: an apostrophe that is a run by itself, not after a blank, and letters that follow it.
    quote = np.flatnonzero((cp == 39) & run & ~blank_before)
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        left = np.ones(len(quote), bool)
        for suffix in CONTRACTIONS:
            ok = left & (quote + len(suffix) < n)
            for j, ch in enumerate(suffix):
                p = np.minimum(quote + 1 + j, n - 1)
                ok &= (cp[p] == ord(ch)) & ~first[p] & (run_start[p] == quote + 1)
            q = quote[ok]
            start[q + 1] = False
            after = q + 1 + len(suffix)
            start[after[after < n]] = True
            left &= ~ok
    return np.flatnonzero(start)


class ByteBPE:
    """ids by the vocabulary file of ranks at ``path`` (base64 bytes and id per line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self._cache: dict[str, tuple[int, ...]] = {}
        self._pow = np.ones(1, np.uint64)
        self._inv = np.ones(1, np.uint64)

    # -- merging one slice ------------------------------------------------------------------------------

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the neighbours of lowest rank, leftmost first, until none can be merged; O(n log n)."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # a part is piece[i:end[i]]; a dead part has end 0
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]  # where the right part starts
            if not j or j >= n or end[j] != e:
                continue
            end[i], end[j] = e, 0
            if e < n:
                prev[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _merged(self, s: str) -> tuple[int, ...]:
        got = self._cache.get(s)
        if got is None:
            if len(self._cache) >= CACHE:
                self._cache.clear()
            got = self._cache[s] = self.merge(s.encode("utf-8"))
        return got

    # -- batches ----------------------------------------------------------------------------------------

    def _powers(self, n: int) -> None:
        if len(self._pow) < n:
            for name, r in (("_pow", _R), ("_inv", _R_INV)):
                p = np.full(n, r, np.uint64)
                p[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(p))

    def _chunk(self, text: str, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, number of ids of each). No text is empty."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(cp)
        doc_end = np.cumsum(lens)
        first = np.zeros(n, bool)
        first[0] = True
        first[doc_end[:-1]] = True
        s = starts_of(cp, first)
        e = np.append(s[1:], n)
        self._powers(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            # +1, so that no symbol counts as nothing
            np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * self._pow[:n], out=sums[1:])
            h = (sums[e] - sums[s]) * self._inv[s]
        code, _ = pd.factorize(h)
        m = int(code.max()) + 1
        rep = np.empty(m, np.int64)
        rep[code[::-1]] = np.arange(len(s) - 1, -1, -1)
        size = e - s
        where = np.repeat(s[rep[code]] - s, size) + np.arange(n)
        if not (np.array_equal(size, size[rep[code]]) and np.array_equal(cp[where], cp)):  # a collision: exact, slower
            code, names = pd.factorize(np.array([text[a:b] for a, b in zip(s, e)], dtype=object))
            m = len(names)
            rep = np.empty(m, np.int64)
            rep[code[::-1]] = np.arange(len(s) - 1, -1, -1)
        merged = [self._merged(text[a:b]) for a, b in zip(s[rep].tolist(), e[rep].tolist())]
        each = np.fromiter(map(len, merged), np.int64, m)
        flat = np.fromiter((i for x in merged for i in x), np.int32, int(each.sum()))
        begin = np.cumsum(each) - each
        k = each[code]
        upto = np.cumsum(k)
        ids = flat[np.repeat(begin[code] - (upto - k), k) + np.arange(int(upto[-1]))]
        last = upto[np.searchsorted(s, doc_end) - 1]
        return ids, np.diff(last, prepend=0)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text); a null or empty text has none."""
        lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        counts = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        full = np.flatnonzero(lens)
        i = 0
        while i < len(full):
            j, total = i + 1, int(lens[full[i]])
            while j < len(full) and total + lens[full[j]] <= CHUNK:
                total += int(lens[full[j]])
                j += 1
            now = full[i:j]
            ids, counts[now] = self._chunk("".join([texts[x] for x in now]), lens[now])
            parts.append(ids)
            i = j
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts

    def offsets(self, ids: list[int]) -> list[int]:
        """The byte (of the text in UTF-8) at which each id begins."""
        size = [len(self.bytes_of[i]) for i in ids]
        return [int(x) for x in np.cumsum([0, *size])[:-1]]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8")
