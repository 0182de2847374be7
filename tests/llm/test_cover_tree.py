import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegrid.llm.components import components
from tidegrid.llm.cover_tree import CoverTree, dual_links, near_duplicate_links


def brute(rows, least=0.98):
    ok = [
        v is not None and l is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v, l in rows
    ]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    groups = defaultdict(list)
    for i, (_, v, l) in enumerate(rows):
        if ok[i]:
            groups[l, len(v)].append(i)
    for at in groups.values():
        m = np.array([np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in at])
        m /= np.linalg.norm(m, axis=1)[:, None]
        for a, b in np.argwhere(m @ m.T >= least - 1e-12):
            if a != b:
                links[at[a]] += 1
                parent[root(at[a])] = root(at[b])
    names = {}
    for i, (name, _, _) in enumerate(rows):
        r = root(i)
        if name is not None:
            names[r] = min(name, names.get(r, name))
    return Counter((n, links[i], names.get(root(i)), n is not None and n == names.get(root(i))) for i, (n, _, _) in enumerate(rows))


def found(df):
    return Counter(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def clustered(draw, n, dim, spread, centres):
    middle = draw.normal(size=(centres, dim))
    return middle[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, dim))


@pytest.mark.parametrize("spread,centres", [(0.001, 3), (0.1, 8), (0.15, 2), (5.0, 4)])
def test_dual_traversal_finds_exactly_the_threshold_pairs(spread, centres):
    draw = np.random.default_rng(int(spread * 1000))
    points = clustered(draw, 600, 16, spread, centres)
    points /= np.linalg.norm(points, axis=1)[:, None]
    weights = draw.integers(1, 4, 600)
    linked = points @ points.T >= 0.98
    np.fill_diagonal(linked, False)
    tree = CoverTree(points)
    whole = dual_links(tree, tree, weights, weights, 0.98, True)
    assert (whole.count == linked @ weights).all()
    a, b = CoverTree(points[:250]), CoverTree(points[250:])
    part = dual_links(a, b, weights[:250], weights[250:], 0.98, False)
    assert (part.count[:250] == linked[:250, 250:] @ weights[250:]).all()
    assert (part.count[250:] == linked[250:, :250] @ weights[:250]).all()
    for i, j in np.argwhere(linked):
        assert whole.label[i] == whole.label[j]


def test_levels_cover_their_points():
    tree = CoverTree((p := np.random.default_rng(1).normal(size=(500, 8))) / np.linalg.norm(p, axis=1)[:, None])
    todo = [tree.root]
    while todo:
        node = todo.pop()
        gap = np.linalg.norm(tree.rows[node.start : node.end] - tree.rows[node.start], axis=1)
        assert gap.max() <= node.radius + 1e-12
        if node.children:
            assert node.children[0].start == node.start
            assert sum(c.end - c.start for c in node.children) == node.end - node.start
        todo += node.children


SCHEMA = "vec_id long, embedding array<float>, label int, node int, cell string, weight int, pair int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "x", 2, 3) for i, v, l in rows], SCHEMA)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_random_vectors_with_odd_rows(spark, block_rows):
    draw = np.random.default_rng(block_rows)
    vectors = np.float32(clustered(draw, 240, 6, 0.08, 5)).tolist()
    rows = [(i, v, None if i % 29 == 0 else 1 if i % 3 else 2) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[3], 1) for i in range(40)]  # a group of copies
    rows += [(2000, [2 * x for x in vectors[3]], 1), (2001, [-x for x in vectors[3]], 1), (2002, vectors[3], None)]
    rows += [(3000, None, 1), (3001, [0.0] * 6, 1), (3002, [float("nan")] + [1.0] * 5, 1), (3003, [None] + [1.0] * 5, 1)]
    rows += [(3004, [float("inf")] + [1.0] * 5, 1), (3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [1.0, 2.0], 1)]
    rows += [(None, vectors[3], 1), (None, [9.0, 9.0, 1.0], 5), (None, [9.0, 9.0, 1.0], 5), (7, vectors[50], 1), (7, vectors[50], 1)]
    rows += [(4000, [1e-30] * 6, 4), (4001, [3e30] * 6, 4)]
    assert found(near_duplicate_links(frame(spark, rows), block_rows=block_rows, max_centres=5)) == brute(rows)


def test_empty_table(spark):
    assert near_duplicate_links(frame(spark, [])).count() == 0


@pytest.mark.parametrize("task_links", [0, 500_000])
def test_components_of_random_graphs(spark, task_links):
    draw = random.Random(2)
    for links in (
        [(draw.randrange(300), draw.randrange(300)) for _ in range(200)],
        [(i, i + 1) for i in range(100)],
        [(0, i) for i in range(1, 200)] + [(500, 500)],
        [],
    ):
        parent = {x: x for pair in links for x in pair}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        want = {(x, root(x)) for a, b in links if a != b for x in (a, b)}
        rows = spark.createDataFrame(links, "a long, b long").repartition(5)
        got = components(rows, task_links=task_links).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
