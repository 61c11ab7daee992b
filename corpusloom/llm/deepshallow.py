"""Deep-shallow ordering of byte strings of one width.

Multikey quicksort orders the strings to a shallow depth, eight bytes a character: a segment is split around a pivot into
less, equal and greater, and the equal part goes on with the next character. Groups that are still equal there have long
common prefixes; a blind trie orders each. It branches on the first byte in which strings differ and skips what they
share, so that each insertion compares one string once.
"""

from __future__ import annotations

import numpy as np

#: Eight-byte characters that quicksort looks at, and the length of segments that are sorted directly.
SHALLOW, DIRECT = 3, 64


def as_words(rows: np.ndarray) -> np.ndarray:
    """The rows of bytes as big-endian 64-bit characters, filled up with zeros."""
    n, width = rows.shape
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    full[:, :width] = rows
    return full.view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray, depth: int) -> np.ndarray:
    """An order of the rows by their first depth characters."""
    out = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        low, high, at = todo.pop()
        part = out[low:high]
        if at == depth or high - low < 2:
            continue
        if high - low <= DIRECT:
            out[low:high] = part[np.lexsort([words[part, k] for k in range(depth - 1, at - 1, -1)])]
            continue
        key = words[part, at]
        pivot = np.partition(key[:: max(1, len(key) // 999)], len(key[:: max(1, len(key) // 999)]) // 2)[len(key[:: max(1, len(key) // 999)]) // 2]
        less, same = key < pivot, key == pivot
        more = ~(less | same)
        a, b = int(less.sum()), int(same.sum())
        out[low:high] = np.concatenate([part[less], part[same], part[more]])
        todo += [(low, low + a, at), (low + a, low + a + b, at + 1), (low + a + b, high, at)]
    return out


class BlindTrie:
    """Orders distinct strings. A node is [depth of the byte it branches on, children by that byte]; a leaf a number."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]], next(iter(node[1].values())))
        other = self.strings[node]
        differ = next(k for k, (a, b) in enumerate(zip(s, other, strict=True)) if a != b)
        parent, byte, node = None, -1, self.root
        while not isinstance(node, int) and node[0] < differ:
            parent, byte = node, s[node[0]]
            node = node[1][byte]
        if not isinstance(node, int) and node[0] == differ:
            node[1][s[differ]] = i
            return
        made = [differ, {other[differ]: node, s[differ]: i}]
        if parent is None:
            self.root = made
        else:
            parent[1][byte] = made

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def distinct_rows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): the row that stands for each distinct row, and for each row the number of its distinct row."""
    with np.errstate(over="ignore"):
        code = np.zeros(len(words), np.uint64)
        for k in range(words.shape[1]):
            code = (code ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
    by = np.argsort(code, kind="stable")
    new = np.ones(len(words), bool)
    new[1:] = (words[by[1:]] != words[by[:-1]]).any(1)
    of = np.empty(len(words), np.int64)
    of[by] = np.cumsum(new) - 1
    return by[new], of


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of rows of bytes: order sorts them, and common[i] is how many bytes the i-th in order shares with
    the one before it (0 for the first). Equal rows stand together."""
    n, width = rows.shape
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = as_words(rows)
    first, of = distinct_rows(words)
    order = first[multikey_quicksort(words[first], min(SHALLOW, words.shape[1]))]
    shallow = min(SHALLOW, words.shape[1])
    edge = np.flatnonzero(np.concatenate(([True], (words[order[1:], :shallow] != words[order[:-1], :shallow]).any(1), [True])))
    sizes = np.diff(edge)
    if shallow < words.shape[1]:
        two = edge[:-1][sizes == 2]
        a, b = words[order[two]], words[order[two + 1]]
        at = (a != b).argmax(1)
        wrong = two[a[np.arange(len(two)), at] > b[np.arange(len(two)), at]]
        order[wrong], order[wrong + 1] = order[wrong + 1], order[wrong].copy()
        for low, size in zip(edge[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            part = order[low : low + size]
            order[low : low + size] = part[BlindTrie([rows[i].tobytes() for i in part]).order()]
    # Distinct rows may appear twice where their hashes met by turns; equal neighbours then share all their bytes.
    differ = rows[order[1:]] != rows[order[:-1]]
    lead = np.where(differ.any(1), differ.argmax(1), width) if len(order) > 1 else np.empty(0, np.int64)
    rank = np.empty(len(first), np.int64)
    rank[of[order]] = np.arange(len(order))
    full = np.argsort(rank[of], kind="stable")
    ranks = rank[of][full]
    common = np.zeros(n, np.int64)
    step = np.diff(ranks)
    common[1:] = np.where(step == 0, width, lead[ranks[1:] - 1] if len(lead) else width)
    return full, common
