"""A prefix tree over ordered token sets that finds all sets linked to a probe."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import numpy as np


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class _Node:
    __slots__ = ("segment", "children", "ends", "least", "most", "slack", "same")

    def __init__(self, segment: list[int], size: int, slack: int, item: int):
        self.segment, self.children, self.ends = segment, {}, []
        self.least = self.most = size  # of the sets that pass through
        self.slack = slack  # most of 100 + percent times the stored length, less percent times the size
        self.same = item  # stands for all below while they are one component, else -1


class PrefixTree:
    """Sets as ascending ranks in one global order; shared beginnings are stored once.

    A set's size may be more than its ranks, by elements that no other set has.
    Two sets link when 100 * intersection >= percent * union.
    """

    def __init__(self, forest: Forest, percent: int = 75):
        self.forest, self.percent = forest, percent
        self.top = _Node([], 0, 0, -1)

    def insert(self, ranks: list[int], size: int, item: int) -> None:
        node, at, end, root = self.top, 0, len(ranks), self.forest.root(item)
        slack = (100 + self.percent) * end - self.percent * size
        while at < end:
            child = node.children.get(ranks[at])
            if child is None:
                child = node.children[ranks[at]] = _Node(ranks[at:], size, slack, item)
                child.ends.append(item)
                return
            seg, k = child.segment, 1
            while k < len(seg) and at + k < end and seg[k] == ranks[at + k]:
                k += 1
            if k < len(seg):
                lower = child
                child = _Node(seg[:k], size, max(slack, lower.slack), lower.same)
                child.least, child.most = lower.least, lower.most
                lower.segment = seg[k:]
                child.children[seg[k]] = lower
                node.children[ranks[at]] = child
            child.least, child.most, child.slack = min(child.least, size), max(child.most, size), max(child.slack, slack)
            if child.same >= 0 and self.forest.root(child.same) != root:
                child.same = -1
            node, at = child, at + k
        node.ends.append(item)

    def probe(self, ranks: list[int], size: int, item: int, sizes: list[int]) -> Iterable[int]:
        """Link ``item`` to stored sets of other components; yields one of each it joins."""
        have, forest, percent = set(ranks), self.forest, self.percent
        whole, end = 100 + percent, len(ranks)
        stack = [(child, 0, 0) for child in self.top.children.values()]
        while stack:
            node, depth, shared = stack.pop()
            # overlap needed with a set of n elements: percent * (size + n) / whole
            if node.least * percent > size * 100 or size * percent > node.most * 100:
                continue
            if node.same >= 0 and forest.root(node.same) == forest.root(item):
                continue
            depth += len(node.segment)
            shared += len(have.intersection(node.segment))
            # the remaining length of the stored sets, then that of the probe
            if (shared - depth) * whole + node.slack < percent * size:
                continue
            left = end - bisect_right(ranks, node.segment[-1])
            if (shared + left) * whole < percent * (size + max(node.least, depth)):
                continue
            for other in node.ends:
                if 100 * shared >= percent * (size + sizes[other] - shared) and forest.join(item, other):
                    yield other
            stack.extend((child, depth, shared) for child in node.children.values())


def ranked(sets: list[np.ndarray]) -> list[list[int]]:
    """The sets, given as ascending keys of the global order, as ranks among the keys that occur."""
    ranks = np.unique(np.concatenate(sets), return_inverse=True)[1]
    return [x.tolist() for x in np.split(ranks, np.cumsum([len(s) for s in sets])[:-1])]


def spanning_links(sets: list[np.ndarray], sizes: list[int], labels: list, stored: list[bool], probing: list[bool], percent: int = 75) -> list[tuple[int, int]]:
    """Links that join the components of probing and stored sets, found through a tree.

    ``sets`` are ascending keys, ``sizes`` at least their lengths. Equal ``labels``
    count as joined already. Every pair of a probing and a stored set is decided,
    by its overlap or because both are already joined.
    """
    if not sets:
        return []
    forest, first = Forest(len(sets)), {}
    for i, label in enumerate(labels):
        forest.join(first.setdefault(label, i), i)
    ranks, out = ranked(sets), []
    tree = PrefixTree(forest, percent)
    both = all(stored) and all(probing)
    order = sorted(range(len(sets)), key=lambda i: (sizes[i], ranks[i]))
    if not both:
        for i in order:
            if stored[i]:
                tree.insert(ranks[i], sizes[i], i)
    for i in order:
        if probing[i]:
            out.extend((i, j) for j in tree.probe(ranks[i], sizes[i], i, sizes))
            if both:
                tree.insert(ranks[i], sizes[i], i)
    return out
