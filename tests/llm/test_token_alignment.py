"""Token alignment against counting by hand with the two libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tidegrid.llm import token_alignment as ta
from tidegrid.llm.queries import QUERIES

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def libraries():
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    return slow, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of_letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    """Per text: sizes, groups and links by walking over byte offsets; counts over all texts."""
    slow, pieces = libraries()
    letters = byte_of_letters()
    found = []
    for text in texts:
        a = b = []
        if text:
            whole = b" " + text.encode()
            code = slow.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(letters[c] for c in token)) for i, token in zip(code.ids, code.tokens)]
            b = []
            for i, piece in zip(pieces.encode(text), pieces.encode(text, out_type=str)):
                b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
            if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
                a = b = []
        ends = []
        for side in (a, b):
            at, places = 0, []
            for i, token in side:
                at += len(token)
                places.append((at, i))
            ends.append(places)
        links = [(j, i) for end, i in ends[0] for other, j in ends[1] if end == other] if len(a) < 3000 else [
            (j, i) for (end, i) in ends[0] for j in [dict(ends[1]).get(end)] if j is not None
        ]
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups, last = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for e, i in side if last < e <= cut) for side in ends))
            last = cut
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(link for _, _, _, links, _ in found for link in links)
    most = defaultdict(int)
    for (b, _), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(text.encode()).hexdigest() if text else "")
        for n_a, n_b, n_groups, links, text in found
    ], counts, most


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows(df):
    return sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS]) for r in df.collect())


def test_against_brute_force(spark, make_docs, awkward):
    draw = random.Random(3)
    texts = [(100 + i, prose(draw, 40)) for i in range(40)] + [
        (i, t if t is None or len(t) < 20_000 else t[:2000]) for i, t in awkward
    ] + [(200, "  lead"), (201, "x�y ﬁ①  z　"), (202, "\U0010ffff á"), (203, "<s> </s> <0x41>"), (204, " ")]
    found = ta.align_tokenizers(make_docs(texts).repartition(3), A, B, keep_groups=True)
    want, counts, most = brute([t for _, t in texts])
    assert rows(found.documents) == sorted((str(i), *w) for (i, _), w in zip(texts, want))
    assert {(r["b"], r["a"]): (r["n_links"], r["best"]) for r in found.pairs.collect()} == {
        k: (n, n == most[k[0]]) for k, n in counts.items()
    }
    kept = {r["doc_id"]: r for r in found.documents.collect()}
    assert hashlib.sha256(kept[100]["groups"].encode()).hexdigest() == kept[100]["groups_sha256"]


def test_slices_units_and_parts_change_nothing(spark, make_docs, monkeypatch):
    draw = random.Random(4)
    texts = [(i, prose(draw, 60)) for i in range(30)] + [(50, "a b " * 900), (51, "x" * 3000), (52, "▁ q" * 900)]
    whole = rows(ta.align_tokenizers(make_docs(texts).repartition(2), A, B).documents)
    small = [("UNIT_DOCS", 4), ("SLICE_CHARS", 500), ("MERGE_PAIRS", 40), ("BACK_RECORDS", 60)]
    for name, value in small:
        monkeypatch.setattr(ta, name, value)
    # The workers read the module's own values: the same steps by hand.
    known = ta.load(A, B)
    text = texts[0][1] * 20
    parts = [known.both([p])[0] for p in ta.slices(text, 300)]
    a, b = known.both([text])[0]
    assert len(parts) > 10 and np.concatenate([p[0] for p in parts]).tolist() == a.tolist()
    assert np.concatenate([p[1] for p in parts]).tolist() == b.tolist()
    assert rows(ta.align_tokenizers(make_docs(texts).repartition(2), A, B).documents) == whole


def test_runs_merge_to_counts():
    known, draw = ta.load(A, B), np.random.default_rng(1)
    blobs, want = {}, Counter()
    for _ in range(5):
        doc, a, b = draw.integers(0, 9, 500), draw.integers(0, 30, 500), draw.integers(0, 20, 500)
        want.update(zip(b.tolist(), a.tolist()))
        for radix, pairs, records, heads, tails in ta.runs_of(known, doc, a, b):
            assert ta.read_heads(heads).shape == (3, pairs) and ta.read_heads(heads)[2].sum() == records
            blobs.setdefault(radix, []).append(heads)
    got = {}
    for group in blobs.values():
        pairs = list(ta.merged(group))
        assert pairs == sorted(pairs)
        got.update({(k // known.size_a, k % known.size_a): n for k, n in pairs})
    assert got == want


def test_long_text_equals_its_short_form(spark, make_docs):
    text = prose(random.Random(5), 30_000)  # longer when repeated than one slice
    long = " ".join([text] * 8)
    assert len(long) > ta.SLICE_CHARS
    found = rows(ta.align_tokenizers(make_docs([(1, long)]), A, B).documents)[0]
    known = ta.load(A, B)
    one = ta.align(known, known.both([long]))
    assert found[1:4] == (one.n_a[0], one.n_b[0], one.n_groups[0])
    assert found[7] == hashlib.sha256(one.written[0][:-1]).hexdigest()
    counts = Counter(zip(one.link_b.tolist(), one.link_a.tolist()))
    assert found[6] == sum(n * n for n in counts.values())


def test_empty_table(spark, make_docs):
    found = ta.align_tokenizers(make_docs([]), A, B)
    assert found.documents.collect() == [] and found.pairs.collect() == []


@pytest.mark.parametrize("text", ["\n" * 2_000_000, " " * 2_000_000 + "x"])
def test_long_white_space(text):
    known = ta.load(A, B)
    assert known.both([text])[0] is not None


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = rows(QUERIES["op11_token_alignment"](spark, sf))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs]
    known = ta.load(A, B)
    found = ta.align(known, [known.both([t])[0] if t else None for _, t in docs])
    counts = Counter(zip(found.link_b.tolist(), found.link_a.tolist()))
    most = defaultdict(int)
    for (b, _), n in counts.items():
        most[b] = max(most[b], n)
    best, sums = np.zeros(len(docs), int), np.zeros(len(docs), int)
    for d, a, b in zip(found.doc.tolist(), found.link_a.tolist(), found.link_b.tolist()):
        best[d] += counts[b, a] == most[b]
        sums[d] += counts[b, a]
    want = sorted(
        (str(i), int(found.n_a[k]), int(found.n_b[k]), int(found.n_groups[k]), int(found.n_groups[k]), int(best[k]), int(sums[k]),
         hashlib.sha256(found.written[k][:-1]).hexdigest() if found.written[k] else "")
        for k, (i, _) in enumerate(docs)
    )
    assert got == want
