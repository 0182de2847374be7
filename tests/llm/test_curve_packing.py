import itertools
import json
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm.curve_packing import Projection, hilbert_keys, load_encoder, pack_along_curve

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_touch(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(1 << (dims * bits)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_equal_documents_share_a_key():
    p = Projection()
    ids = np.arange(50, dtype=np.uint32)
    keys = p.keys(np.array([p.vector(ids), p.vector(ids[::-1])]))
    assert keys[0] == keys[1]


def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library_for_every_code_point():
    encode, slow = load_encoder(PATH), library()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 400):
        text = "".join(f"a{c}b 1{c}2 {c}! {c}{c}\n{c} {c}  x" for c in points[at : at + 400])
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_special_strings_are_coded_as_the_library_does():
    text = "x <|endoftext|> y<|endoftext|><|endoftext|>\n<|endoftext"
    assert load_encoder(PATH)(text).tolist() == library().encode(text, add_special_tokens=False).ids
    ordinary = library()
    ordinary.encode_special_tokens = True
    assert load_encoder(PATH, special=False)(text).tolist() == ordinary.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + " b", "\t " * 1_000_000, "z" * 2_000_000])
def test_long_runs(text):
    assert load_encoder(PATH)(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_run_by_the_library(tmp_path):
    described = json.load(open(PATH, encoding="utf-8"))
    described["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(described))
    want = Tokenizer.from_file(str(path)).encode("Hello there", add_special_tokens=False).ids
    assert load_encoder(str(path))("Hello there").tolist() == want


def check(rows, pieces, capacity):
    encode = library()
    whole = defaultdict(list)
    for i, t in rows:
        whole[i].append([*encode.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["tokens"], "<u4")
        assert len(ids) == p["length"] > 0
        by_doc[p["doc_id"]].append((p["start"], p["doc_tokens"], ids.tolist()))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, texts in whole.items():
        assert sum(len(x[2]) for x in by_doc[i]) == sum(map(len, texts))
        if len(texts) == 1:
            parts = sorted(by_doc[i])
            assert [x for _, _, ids in parts for x in ids] == texts[0]
            assert [p[0] for p in parts] == [0, *np.cumsum([len(p[2]) for p in parts])[:-1]]
            assert {p[1] for p in parts} == {len(texts[0])}
    for parts in by_sequence.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert total == capacity or total & (total - 1) == 0


def test_awkward_rows(make_docs, awkward):
    docs = make_docs(awkward).repartition(3)
    for capacity in (64, 2048):
        check(awkward, pack_along_curve(docs, PATH, capacity=capacity).collect(), capacity)


def test_empty_table(make_docs):
    assert pack_along_curve(make_docs([]), PATH).count() == 0


def test_copies_lie_side_by_side(make_docs):
    rows = [(i, f"words of kind {i % 5} " * (20 + i % 5)) for i in range(60)]
    pieces = pack_along_curve(make_docs(rows).repartition(4), PATH, capacity=128).collect()
    order = [p["doc_id"] % 5 for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
    assert sum(a != b for a, b in itertools.pairwise(order)) <= 4
