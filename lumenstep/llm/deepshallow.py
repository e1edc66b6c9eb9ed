"""Deep-shallow string sorting: multikey quicksort to a shallow depth, blind tries for what is still tied there."""

from __future__ import annotations

SHALLOW = 32
_STEP = 8


def common(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix, known to be at least low."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Trie:
    """A blind trie of strings that share a prefix: inner nodes know the place of the first difference and the byte
    there (-1 where the string ends); leaves know places of equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node, path = self.root, []
        while isinstance(node, tuple):
            path.append(node)
            at, child = node
            byte = s[at] if at < len(s) else -1
            node = child[byte] if byte in child else next(iter(child.values()))
        other = self.strings[node[0]]
        at = common(s, other)
        if at == len(s) == len(other):
            node.append(k)
            return
        # walk again to where the string leaves the trie
        node, above, edge = self.root, None, None
        while isinstance(node, tuple) and node[0] < at:
            above, edge = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][edge]
        byte = s[at] if at < len(s) else -1
        if isinstance(node, tuple) and node[0] == at:
            node[1][byte] = [k]
            return
        split = (at, {other[at] if at < len(other) else -1: node, byte: [k]})
        if above is None:
            self.root = split
        else:
            above[1][edge] = split

    def ordered(self) -> tuple[list[int], list[int]]:
        """Places in order, and the common prefix of each with the one before."""
        out: list[int] = []
        lcp: list[int] = []
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, tuple):
                at, child = node
                for n, byte in enumerate(sorted(child, reverse=True)):
                    stack.append((child[byte], shared if n == len(child) - 1 else at))
            else:
                size = len(self.strings[node[0]])
                out += node
                lcp += [shared] + [size] * (len(node) - 1)
        return out, lcp


def sort(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of the strings, and the common prefix of each with the one before (0 for the first)."""
    out: list[int] = []
    lcp: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) > 1 and depth < SHALLOW:
            keys = {k: strings[k][depth : depth + _STEP] for k in part}
            pivot = keys[part[len(part) // 2]]
            less, same, more = [], [], []
            for k in part:
                (less if keys[k] < pivot else more if keys[k] > pivot else same).append(k)
            ended = len(pivot) < _STEP
            if more:
                stack.append((more, depth))
            if ended and same:  # equal to their ends
                stack.append((same, SHALLOW + len(strings[same[0]])))
            elif same:
                stack.append((same, depth + _STEP))
            if less:
                stack.append((less, depth))
            continue
        if len(part) == 1:
            own, shared = part, [0]
        else:
            trie = _Trie(strings)
            for k in part:
                trie.add(k)
            own, shared = trie.ordered()
        if out:
            shared[0] = common(strings[out[-1]], strings[own[0]])
        out += own
        lcp += shared
    return out, lcp
