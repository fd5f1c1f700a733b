"""Deep-shallow sorting of byte strings: multikey quicksort first, blind tries below.

Strings are split by their first ``SHALLOW`` words of eight bytes with ternary
partitions. Groups that still share all of these have long common prefixes; a
blind trie orders each: it keeps only branching depths and branching bytes, so
an insertion compares one string with one other.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 2


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """``members`` (indices into ``strings``) in the order of their strings; equal strings stay together."""
    root = [members[0]]  # a leaf is the list of members that share one string
    for i in members[1:]:
        s, size = strings[i], len(strings[i])
        node = root
        while isinstance(node, _Node):  # blind: only the branching bytes are looked at
            byte = s[node.depth] if node.depth < size else -1
            node = node.children[byte] if byte in node.children else next(iter(node.children.values()))
        other = strings[node[0]]
        shared = common_prefix(s, other)
        if shared == size == len(other):
            node.append(i)
            continue
        parent, node = None, root
        while isinstance(node, _Node) and node.depth < shared:
            parent, branch = node, s[node.depth]
            node = node.children[branch]
        mine = s[shared] if shared < size else -1
        if isinstance(node, _Node) and node.depth == shared:
            node.children[mine] = [i]
            continue
        fork = _Node(shared, {other[shared] if shared < len(other) else -1: node, mine: [i]})
        if parent is None:
            root = fork
        else:
            parent.children[branch] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.children[b] for b in sorted(node.children, reverse=True)]
        else:
            out += node
    return out


def deep_shallow_order(strings: list[bytes], groups: list[int]) -> np.ndarray:
    """Order of the strings inside each group; ``groups`` has where each group starts, and the end."""
    width = 8 * SHALLOW
    heads = np.frombuffer(b"".join([s[:width].ljust(width, b"\0") for s in strings]), ">u8").reshape(-1, SHALLOW)
    out: list[int] = []
    # Groups wait on a stack, the next one to be written on top.
    stack = [(np.arange(a, b), 0) for a, b in zip(groups[-2::-1], groups[:0:-1], strict=True)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2:
            out += rows.tolist()
        elif depth == SHALLOW:
            out += blind_trie_order(strings, rows.tolist())
        else:
            words = heads[rows, depth]
            pivot = words[len(words) // 2]
            same = words == pivot
            if same.all():
                stack.append((rows, depth + 1))
                continue
            below = words < pivot
            stack += [(part, deeper) for part, deeper in ((rows[~(same | below)], depth), (rows[same], depth + 1), (rows[below], depth)) if len(part)]
    return np.array(out, np.int64)


def prefix_lengths(strings: list[bytes], order: np.ndarray, starts: set[int]) -> np.ndarray:
    """Common prefix of each string in ``order`` with the one before it; 0 where a group starts."""
    at = order.tolist()
    return np.array([0 if k in starts else common_prefix(strings[at[k - 1]], strings[i]) for k, i in enumerate(at)], np.int64)
