"""Suffix automata of reference shards, over word symbols.

A shard holds the fragments that share one anchor; its automaton accepts every
substring of the fragments seen so far.  Fragments stream through it in the
order of their documents: the matching statistic at a place is the length of the
longest match that ends there, and where it reaches the window's length, the
window occurs in an earlier document.
"""

from __future__ import annotations

import numpy as np

from .repeats import windows_twice


class SuffixAutomaton:
    """Generalised online suffix automaton (Blumer et al.) of sequences of words."""

    __slots__ = ("length", "link", "next")

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def add(self, sequence: list) -> None:
        length, link, nxt = self.length, self.link, self.next
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._clone(last, c, q)
                continue
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            nxt.append({})
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        new = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        nxt.append(dict(nxt[q]))
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matching(self, sequence: list) -> list[int]:
        """For each place, the length of the longest substring that ends there and was added."""
        length, link, nxt = self.length, self.link, self.next
        state, n, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(c)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def match_words(kind, anchor: np.ndarray, body: np.ndarray, at: np.ndarray, size: np.ndarray, n: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks of the windows of each distinct fragment that occur in a fragment of a smaller document.

    Fragments come with their earliest document.  An anchor with one fragment
    has nothing to match, and a fragment whose windows' hashes occur once neither.
    The automaton compares the words themselves.
    """
    mask = np.zeros(len(anchor), np.uint64)
    need = np.flatnonzero(windows_twice(kind, body, at, size, n))
    order = need[np.lexsort((doc[need], anchor[need]))]
    a = anchor[order]
    bounds = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else np.zeros(1, np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo < 2:
            continue
        shard, waiting, held = SuffixAutomaton(), [], None
        for j in order[lo:hi].tolist():
            words = body[at[j] : at[j] + size[j]].tobytes().split()
            if doc[j] != held:  # what the same document holds is no earlier document
                for w in waiting:
                    shard.add(w)
                waiting, held = [], doc[j]
            m = 0
            if len(shard.length) > 1:
                for k, found in enumerate(shard.matching(words)):
                    if found >= kind.length:
                        m |= 1 << (k - kind.length + 1)
            mask[j] = m
            if m != (1 << int(n[j])) - 1:  # a fragment whose windows all occur adds nothing
                waiting.append(words)
    return mask
