"""Merge trees, contour trees, persistence and simplification of a function on one graph.

Vertices are numbered by rank: 0 has the least (function value, id). Every tie is broken by the id, so results do not depend on the order of rows.
The merge follows Carr, Snoeyink and Axen, "Computing contour trees in all dimensions" (2003); persistence pairs follow the elder rule.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np


class DisjointSets:
    """Union by size with path halving."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> int:
        """The root of the union of the sets of a and b."""
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.parent[b] = a
            self.size[a] += self.size[b]
        return a


class Domain:
    """A graph whose vertices are ranks; ids[r] and f[r] belong to rank r."""

    def __init__(self, ids, f, edges):
        ids, f = np.asarray(ids), np.asarray(f, np.float64)
        order = np.lexsort((ids, f))
        self.ids, self.f, self.n = ids[order], f[order], len(ids)
        rank = {v: r for r, v in enumerate(self.ids.tolist())}
        pairs = {(min(a, b), max(a, b)) for a, b in ((rank[int(a)], rank[int(b)]) for a, b in edges) if a != b}
        self.edges = sorted(pairs)
        self.up, self.down = [[] for _ in range(self.n)], [[] for _ in range(self.n)]
        for a, b in self.edges:
            self.up[a].append(b)
            self.down[b].append(a)

    def components(self) -> int:
        sets = DisjointSets(self.n)
        for a, b in self.edges:
            sets.union(a, b)
        return len({sets.find(v) for v in range(self.n)})


def merge_tree(n: int, sweep, earlier) -> list[int]:
    """The parent of each vertex (-1 at the last): at each vertex of the sweep the components of its earlier neighbours hang their last vertex on it."""
    parent, sets, last = [-1] * n, DisjointSets(n), list(range(n))
    for v in sweep:
        for w in earlier[v]:
            a, b = sets.find(v), sets.find(w)
            if a != b:
                parent[last[b]] = v
                last[sets.union(a, b)] = v
    return parent


def join_tree(d: Domain) -> list[int]:
    return merge_tree(d.n, range(d.n - 1, -1, -1), d.up)


def split_tree(d: Domain) -> list[int]:
    return merge_tree(d.n, range(d.n), d.down)


def persistence_pairs(d: Domain) -> list[tuple[int, int, int, float, str]]:
    """(extremum, saddle, killed by, persistence, sweep) in ranks; the sweep "up" pairs minima, "down" maxima. The oldest of each component has no partner."""
    out = []
    for name, sweep, earlier, elder in (("up", range(d.n), d.down, min), ("down", range(d.n - 1, -1, -1), d.up, max)):
        sets, oldest = DisjointSets(d.n), list(range(d.n))
        for v in sweep:
            roots = {sets.find(w) for w in earlier[v]}
            if not roots:
                continue
            # In the order of age, the youngest first: each falls to the next older one.
            ages = sorted((oldest[r] for r in roots), reverse=elder is min)
            out += [(young, v, old, abs(float(np.float32(d.f[young]) - np.float32(d.f[v]))), name) for young, old in zip(ages, ages[1:])]
            root = v
            for r in roots:
                root = sets.union(root, r)
            oldest[root] = ages[-1]
    return out


def contour_tree(d: Domain) -> list[tuple[int, int]]:
    """Arcs (lower, higher) of the augmented contour tree."""
    return combine(join_tree(d), split_tree(d))


def combine(join: list[int], split: list[int]) -> list[tuple[int, int]]:
    """The same from the parents of the two merge trees, which are used up.

    Leaves are taken first come, first served, those of the start by rank. Merge trees of a domain
    with cycles may have no contour tree; then no leaf may be left, and the least vertex that has one child in either tree (or the least of all) is taken as a lower leaf.
    """
    parents, n = (join, split), len(join)
    if n and any(p.count(-1) != 1 for p in parents):
        raise ValueError("the domain has more than one component")
    children = [[0] * n for _ in range(2)]
    for count, parent in zip(children, parents, strict=True):
        for p in parent:
            if p >= 0:
                count[p] += 1
    alive, left, arcs = [True] * n, n, []
    ready = deque(v for v in range(n) if children[0][v] + children[1][v] == 1)

    def above(tree: int, v: int) -> int:
        """The nearest live ancestor, with the path to it shortened."""
        parent, path = parents[tree], []
        p = parent[v]
        while p >= 0 and not alive[p]:
            path.append(p)
            p = parent[p]
        for x in (v, *path):
            parent[x] = p
        return p

    while left > 1:
        if not ready:
            bare = [v for v in range(n) if alive[v] and not children[0][v] and not children[1][v]]
            live = [v for v in range(n) if alive[v]]
            ready.extend(bare or ([v for v in live if children[0][v] == 1 and children[1][v] == 1] or live)[:1])
        v = ready.popleft()
        if not alive[v]:
            continue
        tree = 0 if not children[0][v] else 1
        p = above(tree, v)
        if p < 0:
            tree = 1 - tree
            p = above(tree, v)
        arcs.append((p, v) if tree == 0 else (v, p))
        alive[v], left = False, left - 1
        children[tree][p] -= 1
        if children[0][p] + children[1][p] == 1:
            ready.append(p)
    return arcs


def node_class(up: int, down: int) -> str:
    """By the number of arcs upward and downward; every class but "ordinary" is critical."""
    if up == down == 1:
        return "ordinary"
    if up == 0:
        return "max" if down == 1 else "other"
    if down == 0:
        return "min" if up == 1 else "other"
    return "branch_up" if down == 1 else "branch_down" if up == 1 else "multibranch"


class Tree:
    """Arcs as up and down lists."""

    def __init__(self, d: Domain, arcs):
        self.d, self.up, self.down = d, [set() for _ in range(d.n)], [set() for _ in range(d.n)]
        for lo, hi in arcs:
            self.link(lo, hi)

    def link(self, lo: int, hi: int) -> None:
        self.up[lo].add(hi)
        self.down[hi].add(lo)

    def cut(self, lo: int, hi: int) -> None:
        self.up[lo].discard(hi)
        self.down[hi].discard(lo)

    def arcs(self) -> list[tuple[int, int]]:
        return sorted((lo, hi) for lo in range(self.d.n) for hi in self.up[lo])

    def is_extremum(self, v: int) -> bool:
        return len(self.up[v]) + len(self.down[v]) == 1 or self.d.n == 1

    def node_type(self, v: int) -> str:
        return node_class(len(self.up[v]), len(self.down[v]))

    def flatten_plateaus(self) -> None:
        """Around each extremum, re-link the connected vertices of its value as one chain by rank; what was above hangs on its top, what was below on its foot."""
        f = self.d.f
        for start in sorted(range(self.d.n), key=lambda v: self.d.ids[v]):
            if not self.is_extremum(start):
                continue
            level, queue = {start}, deque([start])
            while queue:
                v = queue.popleft()
                for w in self.up[v] | self.down[v]:
                    if f[w] == f[start] and w not in level:
                        level.add(w)
                        queue.append(w)
            if len(level) == 1:
                continue
            above = {w for v in level for w in self.up[v]} - level
            below = {w for v in level for w in self.down[v]} - level
            for v in level:
                for w in list(self.up[v]):
                    self.cut(v, w)
                for w in list(self.down[v]):
                    self.cut(w, v)
            chain = sorted(level)
            for lo, hi in zip(chain, chain[1:]):
                self.link(lo, hi)
            for w in above:
                self.link(chain[-1], w)
            for w in below:
                self.link(w, chain[0])


def build_tree(d: Domain) -> Tree:
    tree = Tree(d, contour_tree(d))
    tree.flatten_plateaus()
    return tree


def contract(tree: Tree) -> list[tuple[int, int, list[int]]]:
    """(lower critical, higher critical, members with both ends), one for each edge of the critical tree, by (lower, higher)."""
    out = []
    for lo in range(tree.d.n):
        if tree.node_type(lo) == "ordinary":
            continue
        for hi in sorted(tree.up[lo]):
            members = [lo, hi]
            while tree.node_type(members[-1]) == "ordinary":
                members += tree.up[members[-1]]
            out.append((lo, members[-1], members))
    return sorted(out)


def simplify(d: Domain, tau: float) -> Tree:
    """The contour tree of the tree's own arcs and, for each of their pairs of a persistence below tau, a shortcut from the extremum to the one that survives it."""
    tree = build_tree(d)
    own = domain_of(d, tree.arcs())
    cut = [(a, c) for a, _, c, persistence, _ in persistence_pairs(own) if persistence < tau]
    return build_tree(domain_of(d, [*tree.arcs(), *cut])) if cut else tree


def domain_of(d: Domain, edges) -> Domain:
    return Domain(d.ids, d.f, [(d.ids[a], d.ids[b]) for a, b in edges])


def hops(neighbours, start: int) -> dict[int, int]:
    """The predecessor of every vertex reachable from start, by breadth; of equally near ones the least."""
    before, queue = {start: -1}, deque([start])
    while queue:
        v = queue.popleft()
        for w in sorted(neighbours[v]):
            if w not in before:
                before[w] = v
                queue.append(w)
    return before


def trace(before: dict[int, int], end: int) -> list[int]:
    path = [end] if end in before else []
    while path and before[path[-1]] != -1:
        path.append(before[path[-1]])
    return path[::-1]


def flatten_view(d: Domain, tau: float) -> list[tuple[int, int, bool, int]]:
    """(lower, higher, flattened, vertex it lies level with) for every edge of the critical tree.

    The edges between an extremum and its saddle are flattened for each pair of a persistence below tau. Flattened edges that touch form a group; the group
    lies level with the vertex that remains when dead ends inside it are pruned: the one with an edge that stands.
    """
    edges = [(lo, hi) for lo, hi, _ in contract(build_tree(d))]
    around: dict[int, set[int]] = {}
    for lo, hi in edges:
        around.setdefault(lo, set()).add(hi)
        around.setdefault(hi, set()).add(lo)
    flat, sets = set(), DisjointSets(d.n)
    for extremum, saddle, _, persistence, _ in persistence_pairs(d):
        if persistence < tau and extremum in around and saddle in around:
            path = trace(hops(around, extremum), saddle)
            for a, b in zip(path, path[1:]):
                flat.add((min(a, b), max(a, b)))
                sets.union(a, b)
    standing = {v for e in edges if e not in flat for v in e}
    level: dict[int, int] = {}
    for v in sorted({v for e in flat for v in e}):
        root = sets.find(v)
        if root not in level or (v in standing and level[root] not in standing):
            level[root] = v
    return [(lo, hi, (lo, hi) in flat, level[sets.find(lo)] if (lo, hi) in flat else -1) for lo, hi in edges]


def binary_space_partition(edges, root: int):
    """(edge index, parent edge or -1, outer vertex, inner vertex, depth) for the edges of a tree, rooted at ``root``, parents before children."""
    around: dict[int, list[int]] = {}
    for i, (lo, hi) in enumerate(edges):
        around.setdefault(lo, []).append(i)
        around.setdefault(hi, []).append(i)
    out, stack = [], [(i, -1, root, 0) for i in reversed(around.get(root, []))]
    while stack:
        i, parent, outer, depth = stack.pop()
        inner = edges[i][0] + edges[i][1] - outer
        out.append((i, parent, outer, inner, depth))
        stack += [(j, i, inner, depth + 1) for j in reversed(around[inner]) if j != i]
    return out


def subtree_sums(partition, area) -> dict[int, float]:
    total = {i: float(area[i]) for i, *_ in partition}
    for i, parent, *_ in reversed(partition):
        if parent >= 0:
            total[parent] += total[i]
    return total


def cheapest_path(n: int, weighted, starts, ends) -> tuple[float, list[int]]:
    """Dijkstra from any of the starts to the nearest of the ends; weighted: (a, b, w). Ties go to the lesser vertex. (inf, []) without a path."""
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in weighted:
        around[a].append((b, w))
        around[b].append((a, w))
    best, before, goal = {s: 0.0 for s in starts}, {s: -1 for s in starts}, set(ends)
    heap, done = [(0.0, s) for s in sorted(starts)], set()
    heapq.heapify(heap)
    while heap:
        cost, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        if v in goal:
            return cost, trace(before, v)
        for w, step in around[v]:
            if w not in best or cost + step < best[w]:
                best[w], before[w] = cost + step, v
                heapq.heappush(heap, (best[w], w))
    return float("inf"), []
