"""Kernels against recorded fixtures, definitions and invariants."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contourlake.kernels.topology import Domain, Tree, binary_space_partition, build_tree, cheapest_path, contour_tree, contract, flatten_view, join_tree, persistence_pairs, simplify, split_tree, subtree_sums

SIX = ([10, 40, 70, 60, 80, 50], [(0, 1), (0, 3), (1, 2), (1, 4), (2, 5), (3, 4), (4, 5)])
PATH = ([1, 5, 2, 9, 3, 8, 4, 7, 6], [(i, i + 1) for i in range(8)])

# The vertices of the mesh fixture, named by their function values, and the neighbours of each.
MESH = {
    1: [2.1, 8, 9],
    2: [6, 4, 4.6, 5, 3, 4.9],
    2.1: [1, 3, 8, 9],
    3: [2, 5, 6.5, 9, 2.1, 8, 6.9, 4.9],
    4: [10, 6.1, 5, 4.6, 2, 6, 7],
    4.6: [2, 4, 5],
    4.9: [6, 2, 3, 6.9],
    5: [9, 6.5, 3, 2, 4.6, 4, 7.2, 10],
    6: [7, 4, 2, 4.9, 6.9, 8],
    6.1: [4, 8.3, 7.2],
    6.5: [5, 9, 3],
    6.9: [8, 6, 4.9, 3],
    7: [6, 4],
    7.2: [8.3, 5, 6.1],
    8: [1, 2.1, 3, 6.9, 6],
    8.3: [10, 7.2, 6.1],
    9: [1, 2.1, 3, 6.5, 5],
    10: [5, 8.3, 4],
}


def domain(fixture) -> Domain:
    f, edges = fixture
    return Domain(range(len(f)), f, edges)


def mesh() -> tuple[Domain, list[float]]:
    names = sorted(MESH)
    at = {v: i for i, v in enumerate(names)}
    return Domain(range(len(names)), names, [(at[a], at[b]) for a in MESH for b in MESH[a]]), names


def named(d: Domain, pairs):
    return sorted((int(d.ids[a]), int(d.ids[b])) for a, b in pairs)


def pairs_of(d: Domain, sweep: str):
    return sorted((int(d.ids[a]), int(d.ids[b]), int(d.ids[c]), p) for a, b, c, p, s in persistence_pairs(d) if s == sweep)


def test_six_vertices():
    d = domain(SIX)
    parents = lambda tree: {int(d.ids[v]): int(d.ids[p]) for v, p in enumerate(tree) if p >= 0}
    assert parents(join_tree(d)) == {4: 3, 2: 5, 3: 5, 5: 1, 1: 0}
    assert parents(split_tree(d)) == {0: 1, 1: 3, 3: 2, 5: 2, 2: 4}
    assert named(d, contour_tree(d)) == [(0, 1), (1, 3), (3, 4), (5, 2), (5, 3)]
    assert pairs_of(d, "up") == [(5, 2, 0, 20.0)]
    assert pairs_of(d, "down") == [(2, 5, 4, 20.0)]


def test_mesh():
    d, names = mesh()
    assert len(d.edges) == 40
    tree = build_tree(d)
    arcs = sorted((names[int(d.ids[a])], names[int(d.ids[b])]) for a, b in tree.arcs())
    assert arcs == sorted(
        [(1, 2.1), (2, 3), (2.1, 3), (3, 4), (4, 4.6), (4, 4.9), (4.6, 5), (4.9, 6), (5, 6.1), (5, 6.5), (6, 6.9), (6, 7), (6.1, 7.2), (6.5, 9), (6.9, 8), (7.2, 8.3), (8.3, 10)]
    )
    assert [names[v] for v in range(d.n) if tree.node_type(v) != "ordinary"] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    found = {(names[a], names[b], names[c], round(p, 6)) for a, b, c, p, _ in persistence_pairs(d)}
    assert found == {(2, 3, 1, 1), (7, 6, 8, 1), (9, 5, 10, 4), (8, 4, 10, 4)}


def test_path_and_its_simplification():
    d = domain(PATH)
    assert pairs_of(d, "up") == [(2, 1, 0, 3.0), (4, 3, 0, 6.0), (6, 5, 4, 4.0), (8, 7, 6, 1.0)]
    assert pairs_of(d, "down") == [(1, 2, 3, 3.0), (5, 4, 3, 5.0), (7, 6, 5, 3.0)]
    f = d.f
    assert all(f[a] < f[b] for a, b in build_tree(d).arcs())
    assert named(d, simplify(d, 2).arcs()) == [(0, 1), (2, 1), (2, 3), (4, 3), (4, 5), (6, 5), (6, 8), (8, 7)]
    assert named(d, simplify(d, 0).arcs()) == named(d, build_tree(d).arcs())


def test_degenerate_domains():
    one = Domain([7], [1.0], [])
    assert build_tree(one).arcs() == [] and persistence_pairs(one) == []
    with pytest.raises(ValueError):
        build_tree(Domain([0, 1], [1, 2], []))
    flat = Domain(range(5), [3.0] * 5, [(0, 2), (2, 4), (4, 1), (1, 3)])
    assert named(flat, build_tree(flat).arcs()) == [(0, 1), (1, 2), (2, 3), (3, 4)]  # one chain by id


def connected(n, extra):
    return st.tuples(
        st.lists(st.integers(0, 6), min_size=n, max_size=n),
        st.lists(st.integers(0, 10**6), min_size=n, max_size=n),
        st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=extra),
    )


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 14).flatmap(lambda n: connected(n, 8)))
def test_invariants(case):
    f, picks, more = case
    n = len(f)
    edges = [(i, picks[i] % i) for i in range(1, n)] + more
    d = Domain(range(n), f, edges)
    arcs = contour_tree(d)
    assert len(arcs) == n - 1 and all(a != b for a, b in arcs)
    tree = build_tree(d)
    assert len(tree.arcs()) == n - 1
    shuffled = Domain(list(range(n))[::-1], f[::-1], [(b, a) for a, b in edges[::-1]])
    assert named(shuffled, build_tree(shuffled).arcs()) == named(d, tree.arcs())
    # Pairs: one less than the extrema of each kind, and each as a brute-force count of components says.
    for sweep, near, sign in (("up", d.down, 1), ("down", d.up, -1)):
        births = [v for v in range(n) if not near[v]]
        own = [p for p in persistence_pairs(d) if p[4] == sweep]
        assert len(own) == len(births) - 1
        for extremum, saddle, killer, *_ in own:
            before = [v for v in range(n) if sign * v < sign * saddle]
            assert not joined(d, before, extremum, killer) and joined(d, [*before, saddle], extremum, killer)
    parts = contract(tree)
    partition = binary_space_partition([(a, b) for a, b, _ in parts], n - 1)
    assert sorted(p[0] for p in partition) == list(range(len(parts)))
    sums = subtree_sums(partition, [1.0] * len(parts))
    assert sum(sums[e] for e, parent, *_ in partition if parent < 0) == len(parts)
    assert {v for *_, m in parts for v in m} == set(range(n))
    assert all(level == -1 or flat for _, _, flat, level in flatten_view(d, 2))


def joined(d, allowed, a, b):
    allowed, seen, stack = set(allowed), {a}, [a]
    while stack:
        v = stack.pop()
        for w in d.up[v] + d.down[v]:
            if w in allowed and w not in seen:
                seen.add(w)
                stack.append(w)
    return b in seen


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 9)), max_size=14))
def test_cheapest_path(edges):
    cost, path = cheapest_path(7, edges, [0, 1], [5, 6])
    best = np.full((7, 7), np.inf)
    np.fill_diagonal(best, 0)
    for a, b, w in edges:
        best[a, b] = best[b, a] = min(best[a, b], w)
    for k, i, j in itertools.product(range(7), repeat=3):
        best[i, j] = min(best[i, j], best[i, k] + best[k, j])
    assert cost == best[np.ix_([0, 1], [5, 6])].min()
    assert (path == []) == np.isinf(cost)


def test_tree_node_types():
    d = domain(PATH)
    tree = Tree(d, d.edges)
    kinds = {int(d.ids[v]): tree.node_type(v) for v in range(d.n)}
    assert kinds == {0: "min", 1: "other", 2: "other", 3: "other", 4: "other", 5: "other", 6: "other", 7: "other", 8: "min"}
