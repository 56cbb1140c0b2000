"""Deep-shallow sorting of byte strings of one width.

Multikey quicksort orders them to a shallow depth; groups that are still equal there, and
small ones, are ordered by a blind trie, which looks at one bit per branch and compares a
string in full only once.
"""

from __future__ import annotations

import numpy as np

WORD = 8  # bytes that quicksort looks at together
SHALLOW = 5  # words after which a group is left to the trie
SMALL = 48  # strings, up to which a group goes to the trie at once


def deep_shallow(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` (strings by bytes) within ``groups`` (sorted numbers), and the LCPs.

    ``lcp[i]`` is how many bytes the i-th string in order shares with the one before it, -1
    where a group begins.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // WORD) * WORD), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.arange(n)
    starts = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)) if n else np.zeros(0, int)
    todo = [(lo, hi, 0) for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), n])]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= SMALL or depth >= min(SHALLOW, words.shape[1]):
            part = order[lo:hi]
            order[lo:hi] = part[blind_trie([padded[i].tobytes() for i in part.tolist()])]
            continue
        part = order[lo:hi]
        look = words[part, depth]
        pivot = np.sort(look[[0, len(look) // 2, -1]])[1]
        less, more = look < pivot, look > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        same = padded[order[1:]] == padded[order[:-1]]
        shared = np.where(same.all(1), width, same.argmin(1))
        lcp[1:] = np.where(groups[order[1:]] == groups[order[:-1]], np.minimum(shared, width), -1)
    return order, lcp


def blind_trie(strings: list[bytes]) -> list[int]:
    """Places of the strings (all of one length) in sorted order; equal ones stay in order."""
    keys = [int.from_bytes(s, "big") for s in strings]
    if len(keys) == 2:
        return [0, 1] if keys[0] <= keys[1] else [1, 0]
    # A branch is [bit, child, child] with the bit counted from the end; a leaf is a list
    # of the places of one string, under a negative bit.
    root = [-1, [0]]
    for place in range(1, len(keys)):
        key = keys[place]
        node = root
        while node[0] >= 0:
            node = node[1 + (key >> node[0] & 1)]
        differ = key ^ keys[node[1][0]]
        if not differ:
            node[1].append(place)
            continue
        bit = differ.bit_length() - 1
        above, side, node = None, 0, root
        while node[0] > bit:
            above, side = node, 1 + (key >> node[0] & 1)
            node = node[side]
        leaf = [-1, [place]]
        branch = [bit, node, leaf] if key >> bit & 1 else [bit, leaf, node]
        if above is None:
            root = branch
        else:
            above[side] = branch
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node[0] < 0:
            out += node[1]
        else:
            todo += [node[2], node[1]]
    return out
