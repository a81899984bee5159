"""FM-index over a delimited list of words, in both reading directions, searched for one-error neighbours.

The text is ``$w1$w2$...$wn$``.  ``Direction`` is the index of one reading direction: its suffixes in order, the character
before each (the BWT), and ranks over it.  An interval of suffix ranks stands for all places where the string read so far
occurs, and reading one more character maps it to the interval of the longer string.  ``neighbours`` runs the two search
schemes that cover every single error: the left half matched exactly and the error taken in the right half (read left to
right), or the right half matched exactly and the error taken in the left half (read right to left).  Whole words are
sought, so both schemes start at a delimiter and end at one, and each is read in one direction: its half first, the other
after it.  All queries advance together, one character a step, as arrays.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

DELIMITER = 0


def encode(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (1.., by place in the sorted alphabet) of all words in one array, and where each word starts (one more at the end)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    at = np.searchsorted(alphabet, points)
    known = (at < len(alphabet)) & (alphabet[np.minimum(at, len(alphabet) - 1)] == points) if len(alphabet) else np.zeros(len(points), bool)
    return np.where(known, at + 1, len(alphabet) + 1), starts  # a character the index lacks has a code that never occurs


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Ranks of the cyclic suffixes, by doubling the compared length until all differ or the whole text is compared."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < n:
        key = rank * (n + 1) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank = new
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class Direction:
    """One reading direction.  ``text`` ends in a delimiter; strings grow at their front."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, sigma: int):
        self.n, self.sigma = len(text), sigma
        order = _suffix_order(text)
        self.bwt = np.roll(text, 1)[order]
        self.owner = owner[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 2))))  # suffixes that begin with a smaller character
        # places of each character in the BWT, all in one sorted array: a rank is one binary search
        self.places = np.sort(self.bwt.astype(np.int64) * (self.n + 1) + np.arange(self.n))

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after reading the characters ``c``; the count of c before a place, plus the smaller characters, is its rank."""
        base = c * (self.n + 1)
        return np.searchsorted(self.places, base + lo), np.searchsorted(self.places, base + hi)

    def branch(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (number of the interval, character) for every character but the delimiter that can be read next."""
        width = hi - lo
        narrow = np.flatnonzero(width <= self.sigma)
        total = int(width[narrow].sum())
        at = np.repeat(narrow, width[narrow])
        place = np.arange(total) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow]) + np.repeat(lo[narrow], width[narrow])
        key = np.unique(at * (self.sigma + 2) + self.bwt[place])
        wide = np.flatnonzero(width > self.sigma)
        if len(wide):
            key = np.concatenate([key, (wide[:, None] * (self.sigma + 2) + np.arange(1, self.sigma + 1)[None, :]).ravel()])
        i, c = np.divmod(key, self.sigma + 2)
        return i[c > 0], c[c > 0]


class WordIndex:
    def __init__(self, words: list[str]):
        self.words = words
        self.alphabet = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32))
        self.codes, self.starts = encode(words, self.alphabet)

    @cached_property
    def leftward(self) -> Direction:
        """Strings read from right to left: w1 $ w2 $ ...; the last delimiter is also the one before w1."""
        return self._direction(self.codes)

    @cached_property
    def rightward(self) -> Direction:
        """Strings read from left to right: each word reversed in its place."""
        length = np.diff(self.starts)
        return self._direction(self.codes[self.starts[1:].repeat(length) - 1 - (np.arange(len(self.codes)) - self.starts[:-1].repeat(length))])

    def _direction(self, codes: np.ndarray) -> Direction:
        n, length = len(self.words), np.diff(self.starts)
        owner = (np.repeat(np.arange(n), length + 1) + 1) % n  # of a delimiter: the word at whose edge a search ends there
        text = np.zeros(len(codes) + n, dtype=np.int64)
        text[np.arange(len(codes)) + np.repeat(np.arange(n), length)] = codes
        return Direction(text, owner, len(self.alphabet))

    def neighbours(self, queries: list[str], forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``queries``, place in the words) with exactly one error, found by one of the two schemes.

        ``forward``: the left half agrees; else the right half agrees and the left one does not hold the word too (that
        pair belongs to the first scheme), so the two calls share no pair.
        """
        codes, starts = encode(queries, self.alphabet)
        d = self.rightward if forward else self.leftward
        m = np.diff(starts)
        half = m // 2 if forward else m - m // 2  # length of the exact part in reading order

        def read(q: np.ndarray, i: np.ndarray) -> np.ndarray:
            """The i-th character of a query in reading order, the delimiter after the last."""
            at = starts[q] + i if forward else starts[q + 1] - 1 - i
            return np.where(i < m[q], codes[np.clip(at, 0, max(len(codes) - 1, 0))], DELIMITER)

        q = np.arange(len(queries))
        # all places after a delimiter (before one, in the other direction)
        lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), d.first[1], dtype=np.int64)
        i = np.zeros(len(q), dtype=np.int64)
        exact, erring = [], []
        while len(q):  # no error yet
            ready = i >= half[q]
            if ready.any():
                r = np.flatnonzero(ready)
                b, c = d.branch(lo[r], hi[r])
                b = r[b]
                l2, h2 = d.step(c, lo[b], hi[b])
                ok = h2 > l2
                b, c, l2, h2 = b[ok], c[ok], l2[ok], h2[ok]
                own, inside = read(q[b], i[b]), i[b] < m[q[b]]
                s = inside & (c != own)
                erring.append((q[b][s], i[b][s] + 1, l2[s], h2[s]))  # replaced
                erring.append((q[b], i[b], l2, h2))  # a further character in the word
                r = r[i[r] < m[q[r]]]
                erring.append((q[r], i[r] + 1, lo[r], hi[r]))  # a character missing in the word
            go = i < m[q]
            q, i, lo, hi = q[go], i[go], lo[go], hi[go]
            lo, hi = d.step(read(q, i), lo, hi)
            go = hi > lo
            q, i, lo, hi = q[go], i[go] + 1, lo[go], hi[go]
            erring, exact = self._advance(d, read, m, erring, exact)
        while erring and any(len(e[0]) for e in erring):
            erring, exact = self._advance(d, read, m, erring, exact)
        if not exact:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(exact))
        a, b = np.divmod(pairs, max(1, len(self.words)))
        if len(a):
            if not forward:
                keep = [not self.words[y].startswith(queries[x][: len(queries[x]) // 2]) for x, y in zip(a.tolist(), b.tolist())]
                a, b = a[np.array(keep, dtype=bool)], b[np.array(keep, dtype=bool)]
        return a, b

    def _advance(self, d: Direction, read, m: np.ndarray, erring: list, exact: list) -> tuple[list, list]:
        """One exact step of all states that have spent their error; those that read the closing delimiter are results."""
        if not erring:
            return erring, exact
        q, i, lo, hi = (np.concatenate(x) for x in zip(*erring))
        if not len(q):
            return [], exact
        lo, hi = d.step(read(q, i), lo, hi)
        end, ok = i >= m[q], hi > lo
        done = np.flatnonzero(end & ok)
        if len(done):
            width = hi[done] - lo[done]
            at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[done], width)
            exact.append(np.repeat(q[done], width) * len(self.words) + d.owner[at])
        go = ok & ~end
        return [(q[go], i[go] + 1, lo[go], hi[go])], exact
