"""Suffix arrays of shards by Larsson-Sadakane refinement, and their merging.

A shard is a few megabytes of fragments.  Suffixes are sorted by their first
eight bytes, then groups of equal suffixes alone are refined by the rank of the
suffix that follows, doubling the sorted length each round, until all differ or
``limit`` bytes are sorted.  Common prefixes of neighbours are read for all suffixes
at once from the ranks of each round; Kasai's recurrence would take them one by one.
"""

from __future__ import annotations

import numpy as np

from .repeats import windows_twice

#: Bytes of fragments in one suffix array.
SHARD = 2 << 20


def suffix_array(text: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffix array, [(h, rank of each suffix by h bytes)...]) of fragments joined in ``text``.

    ``ends`` gives for each place where its fragment ends; a suffix never
    crosses that, and a shorter one sorts before its extensions.
    """
    n = len(text)
    left = ends - np.arange(n)
    # eight bytes and how many of them are real
    key = np.zeros(n, np.uint64)
    for k in range(8):
        byte = np.zeros(n, np.uint64)
        byte[: n - k] = text[k:] if k else text
        key = (key << np.uint64(8)) | np.where(left > k, byte, np.uint64(0))
    order = np.argsort(key, kind="stable")
    k, short = key[order], np.minimum(left, 8)[order]
    if (short < 8).any():  # zero bytes and missing bytes differ
        order = order[np.lexsort((short, k))]
        k, short = key[order], np.minimum(left, 8)[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (short[1:] != short[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, h = [(8, rank.copy())], 8
    while 2 * h <= limit:
        tie = np.ones(n, bool)
        tie[:-1] &= first[1:] != first[:-1]
        tie[1:] &= first[1:] != first[:-1]
        at = np.flatnonzero(~tie)
        if len(at):
            sa = order[at]
            follow = np.where(left[sa] > h, rank[np.minimum(sa + h, n - 1)] + 1, 0)
            by = np.lexsort((follow, first[at]))
            sa, follow, group = sa[by], follow[by], first[at][by]
            order[at] = sa
            fresh = np.ones(len(at), bool)
            fresh[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
            first[at] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            rank[sa] = first[at]
        h *= 2
        levels.append((h, rank.copy()))
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]], ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it, up to twice the sorted length."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = order[:-1].copy(), order[1:].copy()
    stop_a, stop_b = ends[a], ends[b]
    total = np.zeros(n - 1, np.int64)
    for h, rank in reversed(levels):
        ok = (a + h <= stop_a) & (b + h <= stop_b)
        ok &= rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
        a, b, total = a + h * ok, b + h * ok, total + h * ok
    for _ in range(7):
        ok = (a < stop_a) & (b < stop_b)
        ok &= text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)]
        a, b, total = a + ok, b + ok, total + ok
    lcp[1:] = total
    return lcp


def _shard(kind, body, at, n, doc, start):
    """Sorted distinct windows of one shard found twice or bordering others: (strings, earliest, members...)."""
    size = n + kind.length - 1
    ends = np.cumsum(size)
    base = ends - size
    place = np.arange(int(ends[-1])) - np.repeat(base, size) + np.repeat(at, size)
    text = body[place]
    end_of = np.repeat(ends, size)
    order, levels = suffix_array(text, end_of, 1 << kind.length.bit_length())
    lcp = common_prefixes(order, levels, end_of, text)
    whole = end_of[order] - order >= kind.length
    fragment = np.repeat(np.arange(len(n)), size)[order]
    # suffixes too short to hold a window sort before their extensions and break no run of equal windows
    group = np.cumsum(lcp < kind.length)
    keep = whole
    return order[keep], group[keep], fragment[keep], base, text


def match_bytes(kind, anchor: np.ndarray, body: np.ndarray, at: np.ndarray, size: np.ndarray, n: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks of the windows of each distinct fragment with an equal window at an earlier place.

    Earlier is a smaller document, or the same row (document and tag) and a smaller start.
    """
    mask = np.zeros(len(anchor), np.uint64)
    if not len(anchor):
        return mask
    need = np.flatnonzero(windows_twice(kind, body, at, size, n))
    need = need[np.lexsort((start[need], tag[need], doc[need], anchor[need]))]
    if not len(need):
        return mask
    # shards end between anchors unless one anchor's fragments exceed a shard
    shard_of = np.cumsum(size[need]) // SHARD
    first_of_anchor = np.concatenate([[True], anchor[need][1:] != anchor[need][:-1]])
    lead = np.maximum.accumulate(np.where(first_of_anchor, np.arange(len(need)), 0))
    length_of_anchor = np.bincount(lead, weights=size[need], minlength=len(need))[lead]
    shard_of = np.where(length_of_anchor <= SHARD, shard_of[lead], shard_of)
    bounds = np.flatnonzero(np.concatenate([[True], shard_of[1:] != shard_of[:-1], [True]]))
    shards = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        f = need[lo:hi]
        order, group, fragment, base, text = _shard(kind, body, at[f], n[f], doc[f], start[f])
        owner = f[fragment]
        offset = order - base[fragment]
        by = np.lexsort((start[owner] + offset, tag[owner], doc[owner], group))
        group, owner, offset, order = group[by], owner[by], offset[by], order[by]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        # rows that repeat a doc_id are not earlier than each other
        d, t = doc[owner], tag[owner]
        least = d[np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))] if len(group) else d
        first[1:] |= (d[1:] == least[1:]) & (t[1:] != t[:-1])
        later = ~first
        np.bitwise_or.at(mask, owner[later], np.uint64(1) << offset[later].astype(np.uint64))
        shards.append({"lo": lo, "hi": hi, "anchors": (anchor[f[0]], anchor[f[-1]]), "first": np.flatnonzero(first), "owner": owner, "offset": offset, "order": order, "text": text})
    # shards of one anchor: the first windows of each are searched in the sorted windows of the others
    for i, s in enumerate(shards):
        j = i + 1
        while j < len(shards) and shards[j]["anchors"][0] == s["anchors"][1]:
            _merge(kind, s, shards[j], doc, tag, start, mask)
            j += 1
            if shards[j - 1]["anchors"][1] != s["anchors"][1]:
                break
    return mask


def _strings(kind, s):
    if "strings" not in s:
        at = s["order"][s["first"]]
        view = np.lib.stride_tricks.sliding_window_view(s["text"], kind.length)
        s["strings"] = np.ascontiguousarray(view[at]).view(f"S{kind.length}").ravel()
    return s["strings"]


def _merge(kind, a, b, doc, tag, start, mask):
    """Binary search of one shard's distinct windows in another's; of equals the later is marked."""
    x, y = _strings(kind, a), _strings(kind, b)
    if not len(x) or not len(y):
        return
    order = np.argsort(x, kind="stable")
    lo, hi = np.searchsorted(x[order], y, "left"), np.searchsorted(x[order], y, "right")
    for k in range(int((hi - lo).max())):  # more than one only for rows that repeat a doc_id
        hit = np.flatnonzero(lo + k < hi)
        p, q = a["first"][order[lo[hit] + k]], b["first"][hit]
        da, db, same = doc[a["owner"][p]], doc[b["owner"][q]], tag[a["owner"][p]] == tag[b["owner"][q]]
        sa, sb = start[a["owner"][p]] + a["offset"][p], start[b["owner"][q]] + b["offset"][q]
        q = q[(db > da) | ((db == da) & same & (sb > sa))]
        np.bitwise_or.at(mask, b["owner"][q], np.uint64(1) << b["offset"][q].astype(np.uint64))
        p = p[(da > db) | ((da == db) & same & (sa > sb))]
        np.bitwise_or.at(mask, a["owner"][p], np.uint64(1) << a["offset"][p].astype(np.uint64))
