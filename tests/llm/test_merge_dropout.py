import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from tests.llm.conftest import prose
from tidegrid.llm.merge_dropout import Coder, decode_pieces, encode_pieces, load_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_without_dropout_the_library_agrees():
    library, coder = sentencepiece.SentencePieceProcessor(model_file=PATH), Coder(load_pieces(PATH), 0.0, 1, 4)
    draw = random.Random(2)
    texts = [prose(draw, n) for n in (1, 5, 300)] + ["", " ", "  a  b ", "\n\n", "a" * 500, "日本語 テキスト😀", "x\ty", "<0x41> <s>", "The" * 90]
    for text, ids in zip(texts, coder.encode(list(range(len(texts))), texts)):
        assert ids.tolist() == library.encode(text)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.9, 1.0])
def test_awkward_rows_decode_to_themselves(make_docs, awkward, rate):
    docs = make_docs(awkward)
    rows = decode_pieces(encode_pieces(docs, PATH, rate=rate), PATH).collect()
    assert sorted(map(repr, ((r["doc_id"], r["decoded"]) for r in rows))) == sorted(map(repr, awkward))
    assert all(r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None) for r in rows)


def test_segmentations_vary_by_seed_and_key_only():
    model, draw = load_pieces(PATH), random.Random(5)
    text = prose(draw, 400)
    one, again, other = (Coder(model, 0.3, seed, 4) for seed in (1, 1, 2))
    again.encode(list(range(9)), ["something before it"] * 9)
    a, b, c = (k.encode([77], [text])[0].tolist() for k in (one, again, other))
    assert a == b != c
    plain = Coder(model, 0.0, 1, 4).encode([77], [text])[0]
    assert len(plain) < len(a) and model.decode(a) == model.decode(c) == text
    by_variant = {one.variant(d): one.encode([d], [text])[0].tolist() for d in range(60)}
    assert len(by_variant) == 4 and len({tuple(x) for x in by_variant.values()}) == 4


def test_all_dropped_leaves_characters():
    model = load_pieces(PATH)
    ids = Coder(model, 1.0, 1, 1).encode([1], ["hello you"])[0]
    assert [model.bytes[i] for i in ids] == [b" ", b"h", b"e", b"l", b"l", b"o", b" ", b"y", b"o", b"u"]


@pytest.mark.parametrize("rate", [0.0, 0.2])
def test_lockstep_and_agenda_agree(rate):
    model, draw = load_pieces(PATH), random.Random(3)
    words = [" " + "".join(draw.choice("theanoingrxsq.é") for _ in range(draw.randint(1, 60))) for _ in range(300)]
    flat, counts = model.segment(words, 99, rate)
    limit = int(rate * 2**32)
    for word, end, n in zip(words, np.cumsum(counts), counts):
        symbols = model.symbol[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        key = xxhash.xxh64_intdigest(word, 99) if limit else 0
        merged = model._agenda(symbols, key, limit)
        assert model._spelled(merged, np.array([len(merged)]))[0].tolist() == flat[end - n : end].tolist()


def test_empty_table(make_docs):
    assert decode_pieces(encode_pieces(make_docs([]), PATH), PATH).count() == 0


def test_every_occurrence_and_every_document_has_draws_of_its_own():
    model = load_pieces(PATH)
    text = " ".join(["understanding"] * 400)
    coder = Coder(model, 0.1, 3, 4)
    ids = [c.tolist() for c in coder.encode(list(range(20)), [text] * 20)]
    assert len({tuple(x) for x in ids}) == 20  # copies differ by their ids
    cuts, plain = [], Coder(model, 0.0, 3, 4).encode([0], ["understanding"])[0].tolist()
    for piece in ids[0]:
        if model.bytes[piece][:1] == b" ":
            cuts.append([])
        cuts[-1].append(piece)
    assert len(cuts) == 400 and len({tuple(c) for c in cuts}) > 10 and plain in cuts
    assert all(model.decode(x) == text for x in ids)


@pytest.mark.parametrize("word", ["understanding", "z" * 90])
def test_remembered_occurrences_are_those_segmented_anew(word):
    model = load_pieces(PATH)
    text, n = " ".join([word, "and"] * 60), 120
    coder = Coder(model, 0.1, 3, 4)
    got = coder.encode([5], [text])[0].tolist()
    words = np.array([coder.known[" " + word], coder.known[" and"]] * 60)
    doc_key = np.array([xxhash.xxh64_intdigest("5", coder.keys[coder.variant(5)])], np.uint64)
    keys = coder._occurrence_keys(words, np.zeros(n, np.int64), doc_key)
    assert len(set(keys.tolist())) == n
    assert got == model.segment([" " + word, " and"] * 60, 0, 0.1, keys)[0].tolist()


@pytest.mark.parametrize("rate", [0.0, 0.1])
def test_every_code_point_comes_back(rate):
    model = load_pieces(PATH)
    coder = Coder(model, rate, 3, 4)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    for text, ids in zip(texts, coder.encode(list(range(len(texts))), texts)):
        assert b"".join(model.bytes[i] for i in ids.tolist()).decode()[1:] == text
    assert int(model.symbol.max()) < 1 << 21
