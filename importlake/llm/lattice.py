"""Word lattices over a fixed piece vocabulary, for whole batches of words at once."""

from __future__ import annotations

import numpy as np

SPACE = "▁"
MOST = 64  # letters of the longest piece, and of the longest word that is solved in a table
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Pieces:
    """The vocabulary as sorted hashes for each piece length."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = min(MOST, max((len(p) for p in pieces), default=1))
        by: dict[int, list[tuple[int, int]]] = {}
        for k, p in enumerate(pieces):
            if 0 < len(p) <= MOST:
                h = np.zeros(1, np.uint64)
                for ch in p:
                    h = h * PRIME + np.uint64(ord(ch) + 1)
                by.setdefault(len(p), []).append((int(_mix(h)[0]), k))
        self.by = {}
        for n, rows in by.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            assert len(np.unique(hashes)) == len(hashes), "two pieces of one length share a hash"
            near = np.zeros(1 << 18, bool)  # most substrings are no piece, and end at one look-up here
            near[(hashes >> np.uint64(46)).view(np.int64)] = True
            self.by[n] = (hashes, np.array([r[1] for r in rows], np.int32), near)

    def spots(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For words of one length (a row of code points each): by (start, end), the rows where a piece fits there, and the pieces."""
        n, out = codes.shape[1], {}
        letters = np.ascontiguousarray(codes.T).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            for start in range(n):
                h = np.zeros(len(codes), np.uint64)
                for end in range(start + 1, min(n, start + self.longest) + 1):
                    h *= PRIME
                    h += letters[end - 1]
                    if end - start in self.by:
                        hashes, ids, near = self.by[end - start]
                        m = _mix(h)
                        rows = np.flatnonzero(near[(m >> np.uint64(46)).view(np.int64)])
                        if len(rows):
                            m = m[rows]
                            at = np.minimum(np.searchsorted(hashes, m), len(hashes) - 1)
                            hit = hashes[at] == m
                            if hit.any():
                                out[start, end] = rows[hit], ids[at[hit]]
        return out

    def find(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """By (start, end), the piece of each row that fits there, or -1."""
        out = {}
        for place, (rows, ids) in self.spots(codes).items():
            out[place] = got = np.full(len(codes), -1, np.int32)
            got[rows] = ids
        return out


class Edges:
    """The vocabulary by hashes of its pieces and of their beginnings, for words of any lengths side by side.

    A place is followed only while a piece begins like the letters from there on, which most places leave after a few.
    """

    def __init__(self, pieces: Pieces):
        self.longest, self.by = pieces.longest, pieces.by
        self.begins = np.zeros((self.longest + 1, 1 << 20), bool)
        for _, codes in by_length([p for p in pieces.pieces if len(p) <= MOST]):
            h = np.zeros(len(codes), np.uint64)
            for n in range(1, codes.shape[1] + 1):
                h = h * PRIME + (codes[:, n - 1].astype(np.uint64) + np.uint64(1))
                self.begins[n, (_mix(h) >> np.uint64(44)).view(np.int64)] = True

    def of(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, lengths, pieces) of the pieces that fit into ``codes``; ``left``: the letters from each place to the end of its word."""
        letters, at, h = codes.astype(np.uint64) + np.uint64(1), np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        places, lengths, found = [at[:0]], [at[:0]], [np.zeros(0, np.int32)]
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at = at[inside]
            h = h[inside] * PRIME + letters[at + (n - 1)]
            m = _mix(h)
            alive = self.begins[n][(m >> np.uint64(44)).view(np.int64)]
            at, h, m = at[alive], h[alive], m[alive]
            if not len(at):
                break
            if n in self.by:
                hashes, ids, near = self.by[n]
                rows = np.flatnonzero(near[(m >> np.uint64(46)).view(np.int64)])
                m = m[rows]
                k = np.minimum(np.searchsorted(hashes, m), len(hashes) - 1)
                hit = hashes[k] == m
                places.append(at[rows[hit]])
                lengths.append(np.full(int(hit.sum()), n))
                found.append(ids[k[hit]])
        return np.concatenate(places), np.concatenate(lengths), np.concatenate(found)


def by_letters(words: list[str], block: int = 1 << 17):
    """Blocks of (positions in ``words``, their lengths, code points of all one after the other), the longest words first; empty ones are left out."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
    number = sizes[order].cumsum() // block
    for at in np.split(order, np.flatnonzero(np.diff(number)) + 1) if len(order) else []:
        yield at, sizes[at], np.frombuffer("".join([words[k] for k in at.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)


def by_length(words: list[str], block: int = 4096):
    """Blocks of (positions in ``words``, code points), each of words of one length."""
    order: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        order.setdefault(len(w), []).append(k)
    for n, at in order.items():
        if n:
            rows = max(1, min(block, block * MOST // n))
            for i in range(0, len(at), rows):
                part = at[i : i + rows]
                yield np.array(part), np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
