import hashlib
import random
from collections import defaultdict

import pytest

from tidegrid.llm.trie_dedup import Trie, exact_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, largest=True):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = (max if largest else min)(named) if named else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        once = True
        for i in ids:
            kept = i == keep and once
            once = once and not kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("task_bytes", [1, 2000, 128 << 20])
def test_awkward_rows(make_docs, awkward, keep, task_bytes):
    docs = make_docs(awkward).repartition(3)
    assert found(exact_groups(docs, keep=keep, task_bytes=task_bytes)) == brute(awkward, keep == "largest")


def test_spilling_gives_the_same_groups(make_docs):
    draw = random.Random(3)
    rows = [(i, "shared beginning " * 20 + str(draw.randrange(60)) * draw.randrange(1, 4)) for i in range(700)]
    docs = make_docs(rows).repartition(4)
    assert found(exact_groups(docs, keep="largest", task_bytes=9000)) == brute(rows)


def test_empty_table(make_docs):
    assert exact_groups(make_docs([]), keep="largest").count() == 0


def test_unknown_keep(make_docs):
    with pytest.raises(ValueError):
        exact_groups(make_docs([]), keep="best")


def test_trie_holds_and_spills_whole_strings():
    draw = random.Random(1)
    for turn in range(150):
        trie, want = Trie(), {}
        for _ in range(draw.randint(1, 80)):
            key = bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 6)))
            node = trie.find(key)
            if node.value is None:
                node.value = [None, 0, 0]
            node.value[2] += 1
            want[key] = want.get(key, 0) + 1
        assert {k: v[2] for k, v in trie.entries()} == want
        first = trie.find(next(iter(want)))
        out = {k: v[2] for k, v in trie.spill(draw.randint(0, 20_000), first if turn % 2 else None)}
        left = {k: v[2] for k, v in trie.entries()}
        assert not set(out) & set(left) and out | left == want
        if turn % 2:
            assert first.value is not None
            assert all(trie.find(k).stub for k in out)
