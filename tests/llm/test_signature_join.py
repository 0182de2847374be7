import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidegrid.llm.signature_join import bitmap, linked_pairs, shingle_components, spanning_pairs

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(rows, num=75, den=100):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    names = {}
    for x, (i, _) in zip(label, rows):
        if i is not None:
            names[x] = min(i, names.get(x, i))
    return Counter((i, len(s), names.get(x)) for x, s, (i, _) in zip(label, sets, rows))


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def random_sets(draw, many):
    sets = []
    for _ in range(many):
        x = draw.integers(0, 2**63, int(draw.integers(1, 400)), dtype=np.uint64)
        if sets and draw.random() < 0.6:
            b = sets[int(draw.integers(len(sets)))]
            x = np.concatenate([b[draw.random(len(b)) > draw.random() * 0.3], x[: int(len(x) * draw.random() * 0.3)]])
        if len(x := np.unique(x)):
            sets.append(x)
    return sets


def test_trees_lose_no_link():
    draw = np.random.default_rng(2)
    for _ in range(40):
        sets = random_sets(draw, int(draw.integers(2, 120)))
        sizes = np.array([len(s) for s in sets])
        true = {
            (j, i) for i in range(len(sets)) for j in range(i)
            if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (sizes[i] + sizes[j] - n)
        }
        links = linked_pairs(sets, 75, 100)
        assert {tuple(sorted(p)) for p in links} <= true

        def joined(pairs):
            label = list(range(len(sets)))
            for a, b in pairs:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
            return label

        assert joined(links) == joined(true)
        pools = joined(spanning_pairs([bitmap(s) for s in sets], sizes, 75, 100))
        assert all(pools[a] == pools[b] for a, b in true)


def near_copies(draw):
    rows, k = [], 0
    for _ in range(14):
        words = prose(draw, draw.choice([3, 5, 8, 40, 200])).split()
        for _ in range(draw.choice([1, 2, 9])):
            copy = list(words)
            for _ in range(draw.randrange(0, 4)):
                copy[draw.randrange(len(copy))] = f"edit{draw.randrange(10**6)}"
            text = draw.choice([" ", "\n", " \t"]).join(copy)
            rows.append((k, text.upper() if draw.random() < 0.2 and text.isascii() else text))
            k += 1
    return rows


@pytest.mark.parametrize("part,share", [(2048, 1 / 16), (4, 0.0), (2, 1.0)])
def test_near_copies(make_docs, part, share):
    """Also with blocks cut into tiny parts, by tasks or from the sample on."""
    rows = near_copies(random.Random(part))
    got = shingle_components(make_docs(rows).repartition(3), sample_share=share, part=part)
    assert found(got) == brute(rows)


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_one_large_group_with_outsiders(make_docs, share):
    """Near copies in many parts, and documents that share their passage but link to a few or none."""
    draw = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(70):
        copy = list(base)
        copy[draw.randrange(60)] = f"edit{k}"
        rows.append((k, " ".join(copy)))
    rows += [(100 + k, " ".join(base[: 30 + k] + [f"own{k}x{i}" for i in range(40)])) for k in range(8)]
    far = [*base[:52], *[f"far{i}" for i in range(8)]]
    rows += [(200, " ".join(far)), (201, " ".join([*far[:58], "y", "z"])), (202, " ".join([*base[:47], *[f"q{i}" for i in range(13)]]))]
    got = shingle_components(make_docs(rows).repartition(4), sample_share=share, part=5)
    assert found(got) == brute(rows)


def test_boilerplate_links_nothing_by_itself(make_docs):
    draw = random.Random(5)
    passage = prose(draw, 60)
    rows = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(100))) for i in range(40)]
    rows += [(100 + i, passage + f" {i}") for i in range(6)]
    assert found(shingle_components(make_docs(rows))) == brute(rows)


def test_awkward_rows(make_docs, awkward):
    rows = awkward + [(30, "a b c d e"), (31, "A B\nC d e"), (32, "a b c d"), (33, "a b c d"), (None, "a b c d e")]
    assert found(shingle_components(make_docs(rows).repartition(2))) == brute(rows)


def test_exactly_at_the_threshold(make_docs):
    words = [f"w{i}" for i in range(11)]  # 7 shingles; sharing 6 of 8 is 0.75
    rows = [(1, " ".join(words)), (2, " ".join([*words[:10], "other"])), (3, " ".join([*words[:9], "x", "y"]))]
    assert found(shingle_components(make_docs(rows))) == brute(rows)
    assert len({c for _, _, c in brute(rows)}) == 2


def test_empty_table(make_docs):
    assert shingle_components(make_docs([])).count() == 0
