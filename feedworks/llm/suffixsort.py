"""Deep-shallow sorting of byte strings.

Multikey quicksort, eight bytes a step, orders strings up to a shallow depth.
Groups that still agree there share long prefixes, on which quicksort would
compare the same bytes over and over; a blind trie orders each of them instead,
comparing a string with one other only.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32
WORD = 8
END = -1


def _words(strings: list[bytes], depth: int) -> np.ndarray:
    """The bytes from ``depth`` on as big-endian words; zeros after the end."""
    cut = b"".join(s[depth : depth + WORD].ljust(WORD, b"\0") for s in strings)
    return np.frombuffer(cut, ">u8").astype(np.uint64)


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    low, high = start, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _shallow_groups(strings: list[bytes], key: np.ndarray, shallow: int) -> list[np.ndarray]:
    """Indices in order, as groups that agree in ``key`` and ``shallow`` bytes."""
    columns = [key] + [_words(strings, d) for d in range(0, shallow, WORD)]
    done: list[np.ndarray] = []
    todo = [(np.arange(len(strings)), 0)]
    while todo:
        rows, level = todo.pop()
        if level == len(columns) or len(rows) == 1:
            done.append(rows)
            continue
        values = columns[level][rows]
        pivot = values[len(values) // 2]
        less, more = values < pivot, values > pivot
        # Last in, first out: the smallest part is taken up next.
        for part, deeper in ((more, level), (~(less | more), level + 1), (less, level)):
            if part.any():
                todo.append((rows[part], deeper))
    return done


class _Node:
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int):
        self.depth = depth
        self.children: dict[int, object] = {}
        self.leaf = -1


def blind_trie_order(strings: list[bytes], rows: list[int], depth: int) -> tuple[list[int], list[int]]:
    """``rows`` in order of their strings, and the common prefix of each with the
    one before. All strings agree in ``depth`` bytes, or end there together."""
    root: object = [rows[0]]

    def byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else END

    for row in rows[1:]:
        own = strings[row]
        node = root
        while isinstance(node, _Node):
            child = node.children.get(byte(own, node.depth))
            node = next(iter(node.children.values())) if child is None else child
        other = strings[node[0]]
        shared = common_prefix(own, other, min(depth, len(own), len(other)))
        if shared == len(own) == len(other):
            node.append(row)
            continue
        parent, node = None, root
        while isinstance(node, _Node) and node.depth < shared:
            parent, node = node, node.children[byte(own, node.depth)]
        if isinstance(node, _Node) and node.depth == shared:
            node.children[byte(own, shared)] = [row]
            continue
        split = _Node(shared)
        split.children[byte(other, shared)] = node
        split.children[byte(own, shared)] = [row]
        if parent is None:
            root = split
        else:
            parent.children[byte(own, parent.depth)] = split
    order: list[int] = []
    prefix: list[int] = []
    stack = [(root, END)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, _Node):
            for i, key in reversed(list(enumerate(sorted(node.children)))):
                stack.append((node.children[key], node.depth if i else shared))
        else:
            order += node
            prefix += [shared] + [len(strings[node[0]])] * (len(node) - 1)
    return order, prefix


def deep_shallow_sort(strings: list[bytes], key: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, string), and the length of the prefix each string shares
    with the one before it; -1 where the key differs."""
    order: list[int] = []
    prefix: list[int] = []
    for rows in _shallow_groups(strings, key.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), shallow):
        if len(rows) == 1:
            part, shared = [int(rows[0])], [END]
        else:
            # Padding hides where short strings end, so agreement up to the
            # shallow depth is taken as known only for strings that reach it.
            known = min(shallow, min(len(strings[r]) for r in rows))
            part, shared = blind_trie_order(strings, rows.tolist(), known)
        if order and key[order[-1]] == key[part[0]]:
            shared[0] = common_prefix(strings[order[-1]], strings[part[0]])
        order += part
        prefix += shared
    return np.array(order, np.int64), np.array(prefix, np.int64)
