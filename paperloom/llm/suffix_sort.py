"""Deep-shallow sorting of byte strings.

Multikey quicksort orders strings by words of eight bytes to a shallow depth. Groups that still agree there share a long
prefix; a blind trie orders each: it branches on the first byte in which strings differ and stores no text, so placing a
string costs one walk down and one comparison with the string it ends at.
"""

from __future__ import annotations

#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 16


def common_prefix(a: bytes, b: bytes) -> int:
    """Number of leading bytes in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def blind_trie_order(strings: list[bytes], ids: list[int]) -> tuple[list[int], list[int]]:
    """``ids`` in the order of their strings, and the common prefix of each with the one before (0 for the first)."""
    # a node: [depth, children by byte, any leaf below]; a leaf: [-1, ids of equal strings, own id]
    root = [-1, [ids[0]], ids[0]]
    for i in ids[1:]:
        s, node = strings[i], root
        while node[0] >= 0:
            node = node[1].get(_byte(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[2]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node[1].append(i)
            continue
        leaf, above, node = [-1, [i], i], None, root
        while 0 <= node[0] < same:
            above, node = node, node[1][_byte(s, node[0])]
        if node[0] == same:
            node[1][_byte(s, same)] = leaf
            continue
        fork = [same, {_byte(other, same): node, _byte(s, same): leaf}, i]
        if above is None:
            root = fork
        else:
            above[1][_byte(s, above[0])] = fork
    order, lcps, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if node[0] < 0:
            for k, i in enumerate(node[1]):
                order.append(i)
                lcps.append(len(strings[i]) if k else shared)
        else:
            first, *rest = sorted(node[1])
            stack.extend((node[1][c], node[0]) for c in reversed(rest))
            stack.append((node[1][first], shared))
    return order, lcps


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Indices of ``strings`` in order, and the common prefix of each string with the one before (0 for the first)."""
    order: list[int] = []
    lcps: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if not group:
            continue
        if len(group) == 1 or depth >= shallow:
            part, shared = ([group[0]], [0]) if len(group) == 1 else blind_trie_order(strings, group)
            shared[0] = common_prefix(strings[order[-1]], strings[part[0]]) if order else 0
            order += part
            lcps += shared
            continue
        word = {i: strings[i][depth : depth + 8] for i in group}
        pivot = word[group[len(group) // 2]]
        less, same, more = [], [], []
        for i in group:
            (same if word[i] == pivot else less if word[i] < pivot else more).append(i)
        stack += [(more, depth), (same, depth + 8 if len(pivot) == 8 else shallow), (less, depth)]
    return order, lcps
