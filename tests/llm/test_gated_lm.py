import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidegrid.llm import gated_lm
from tidegrid.llm.gated_lm import CLASSES, GatedNetwork, Vocabulary, class_log10, language_model_scores, train_network

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sequences(seed=1, many=12):
    draw = np.random.default_rng(seed)
    return [draw.integers(0, CLASSES, n) for n in draw.integers(1, 90, many)]


def plain_log10(net, sequence):
    """One step after the other, in double precision."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    n, state, before, total = net.hidden, np.zeros(net.hidden), CLASSES, 0.0
    for target in sequence:
        x, pull = w["x"][before], state @ w["u"]
        z, r = (1 / (1 + np.exp(-(x[i * n : (i + 1) * n] + pull[i * n : (i + 1) * n]))) for i in (0, 1))
        state = (1 - z) * np.tanh(x[2 * n :] + r * pull[2 * n :]) + z * state
        logits = state @ w["o"] + w["b"]
        total += logits[target] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
        before = target
    return total / math.log(10)


@pytest.mark.parametrize("lanes,window", [(512, 32), (3, 7), (1, 1), (4, 1000)])
def test_state_is_carried_over_whole_documents(lanes, window):
    net, many = GatedNetwork(9, seed=3), sequences()
    for v in net.weights.values():
        v *= 3
    got = class_log10(net, many, lanes, window)
    assert got == pytest.approx([plain_log10(net, s) for s in many], rel=1e-4)


def test_slopes_agree_with_differences():
    net = GatedNetwork(4, seed=1)
    net.weights = {k: v.astype(np.float64) * 2 for k, v in net.weights.items()}
    draw = np.random.default_rng(2)
    inputs, targets = draw.integers(0, CLASSES + 1, (6, 3)), draw.integers(0, CLASSES, (6, 3))
    mask = (draw.random((6, 3)) > 0.2).astype(float)
    state = draw.normal(size=(3, 4))
    slopes, _, _ = net.slopes(inputs, targets, mask, state)
    for name, value in net.weights.items():
        flat = value.reshape(-1)
        places = draw.choice(flat.size, min(20, flat.size), replace=False) if name != "x" else [inputs[0, 0] * 12 + i for i in range(12)]
        for at in places:
            old = flat[at]
            losses = []
            for step in (1e-5, -1e-5):
                flat[at] = old + step
                losses.append(net.slopes(inputs, targets, mask, state)[2])
            flat[at] = old
            assert slopes[name].reshape(-1)[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_training_learns_a_rule():
    rule = [np.array([(start + 5 * i) % CLASSES for i in range(60)]) for start in range(40)]
    net = train_network(rule, 24, epochs=30)
    before = class_log10(GatedNetwork(24), rule).sum()
    assert class_log10(net, rule).sum() > 0.6 * before
    again = train_network(rule, 24, epochs=30)
    assert all((again.weights[k] == net.weights[k]).all() for k in net.weights)


def test_classes_of_known_and_unknown_words():
    words = Vocabulary.of([b"the cat the dog the end"] * 3, 100)
    assert words.frequent[:2] == [b"\n", b"the"] and words.word_class(b"\n") == 0 and words.word_class(b"the") == 1
    assert all(0 <= words.word_class(w) < CLASSES for w in (b"zebra", b"", b"x" * 500))


def test_words_by_columns_are_those_of_plain_splitting():
    texts = [b"", b" ", b"  a  b\n", b"\xff\xfe a\x00b", b"a\x0b\x0cb\rc", " x  y\x1f z\x85\u00a0".encode(), b"w" * 5000 + b" w"]
    words, ends = gated_lm.split_words(pa.array([b"sliced off", *texts], pa.binary())[1:])
    assert words.to_pylist() == [w for t in texts for w in t.split()]
    assert ends.tolist() == np.cumsum([len(t.split()) for t in texts]).tolist()
    empty, none = gated_lm.split_words(pa.array([], pa.binary()))
    assert len(empty) == len(none) == 0 and len(gated_lm.word_hashes(empty)) == 0


def test_words_described_together_as_one_by_one():
    draw = random.Random(8)
    words = sorted({bytes(draw.choices(b"abcde\xc3\xa9", k=draw.randrange(1, 7))) for _ in range(3000)} | {b"x" * n for n in range(40, 60)})
    known = Vocabulary([gated_lm.END, *draw.sample(words, 200)])
    column = pa.array([b"before", *words, gated_lm.END], pa.binary())[1:]
    hashes, classes, numbers = known.described(column)
    assert classes.tolist() == [known.word_class(w) for w in column.to_pylist()]
    assert numbers.tolist() == [known.number.get(w, -1) for w in column.to_pylist()]
    assert len(set(hashes.tolist())) == len(column)
    assert hashes[:9].tolist() == gated_lm.word_hashes(pa.array(words[:9], pa.binary())).tolist()


def test_flushes_change_nothing(monkeypatch):
    draw = random.Random(14)
    texts = [prose(draw, draw.randrange(0, 60)).encode() for _ in range(150)]
    words = Vocabulary.of(texts[:50], 30)
    monkeypatch.setattr(gated_lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))

    def counted():
        parts = [
            pa.record_batch([pa.array(range(k, k + 10)), pa.array([i % 7 == 2 for i in range(k, k + 10)]), pa.array(texts[k : k + 10], pa.binary())],
                            ["doc", "held_out", "text"]) for k in range(0, 150, 10)
        ]
        rows = [r for b in gated_lm._count(words, 4)(iter(parts)) for r in b.to_pylist()]
        docs = [tuple(r[k] for k in ("row", "doc", "held_out", "n")) for r in rows if r["kind"] == "doc"]
        posted = Counter()
        for r in rows:
            if r["kind"] == "word":
                columns = (np.frombuffer(r[k], t) for k, t in zip("abcd", (np.uint64, np.uint32, np.uint32, np.uint8)))
                posted.update((r["doc"], int(h), r["row"] + int(o), int(n), int(m)) for h, o, n, m in zip(*columns))
        return docs, posted, [(r["a"], r["b"]) for r in rows if r["kind"] == "sum"], len(rows)

    whole = counted()
    monkeypatch.setattr(gated_lm, "FLUSH_TOKENS", 50)
    cut = counted()
    assert cut[:3] == whole[:3] and cut[3] > whole[3] and sum(n for *_, n, _ in whole[1]) > 0


def brute(rows, held):
    counts, tokens = Counter(), []
    for i, t in rows:
        words = (t or "").encode().translate(LOWER).split() + [b"\n"]
        tokens.append(words)
        if not held(i):
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        for (i, _), w in zip(rows, tokens)
    ]


def remainder(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def condition():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def key(row):
    return (repr(row[0]), row[2], round(row[5], 4))


def test_counts_and_base_follow_the_formula(make_docs, awkward):
    draw = random.Random(4)
    rows = awkward + [(100 + i, prose(draw, draw.randrange(0, 60))) for i in range(150)]
    got = language_model_scores(make_docs(rows).repartition(3), condition(), sample_docs=40, frequent_words=30).collect()
    got = sorted((tuple(r)[:6] for r in got), key=key)
    want = sorted(brute(rows, remainder), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_held_out_documents_are_better_explained_than_by_the_base(make_docs):
    draw = random.Random(6)
    kinds = [[f"{k}{i}" for i in range(40)] for k in ("red", "green", "blue")]
    rows = [(i, " ".join(draw.choices(kinds[i % 3], k=40))) for i in range(500)]
    got = language_model_scores(make_docs(rows), condition(), epochs=8).collect()
    out = [r for r in got if r["held_out"]]
    assert len(out) > 30 and sum(r["score"] for r in out) > 0.93 * sum(r["base_score"] for r in out)
    changed = [(i, "other words" if remainder(i) else t) for i, t in rows]
    again = {r["doc_id"]: r for r in language_model_scores(make_docs(changed), condition(), epochs=8).collect()}
    assert all(again[r["doc_id"]]["score"] == pytest.approx(r["score"]) for r in got if not r["held_out"])


def test_probabilities_of_words_add_up(make_docs):
    """Over all texts of one word the training words' probabilities stay under one, and near it."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    rows = [(1000 + i, " ".join(draw.choices(words, k=30))) for i in range(60) if not remainder(1000 + i)]
    probes = [i for i in range(4000) if remainder(i)][: len(words)]
    rows += list(zip(probes, words))
    got = {r["doc_id"]: r for r in language_model_scores(make_docs(rows), condition()).collect()}
    first_and_end = sum(10 ** got[i]["score"] for i in probes)
    assert 0 < first_and_end < 1


def test_no_rows_and_nothing_to_learn_from(make_docs):
    assert language_model_scores(make_docs([]), condition()).count() == 0
    only = [(i, "a b") for i in range(200) if remainder(i)]
    for r in language_model_scores(make_docs(only), condition()).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0


def test_every_training_document_moves_the_weights_and_the_classes(make_docs, monkeypatch):
    """Each document that is learned from reaches the network, long ones too, whatever the sample is."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(draw.choices(words, k=25))) for i in range(60)]
    rows.append((next(i for i in range(500, 600) if not remainder(i)), "long " * 50_000))
    seen = []
    monkeypatch.setattr(gated_lm, "_averaged", lambda net, moves: seen.append(sum(int(m[1][0]) for m in moves)) or net)
    chosen = []
    monkeypatch.setattr(gated_lm, "_count", lambda v, n, f=gated_lm._count: chosen.append(v) or f(v, n))
    docs = make_docs(rows).repartition(3)
    got = language_model_scores(docs, condition(), sample_docs=0).collect()
    assert seen == [sum(r["n_tokens"] for r in got if not r["held_out"])]
    assert chosen[0].word_class(b"long") == 1 and len(chosen[0].frequent) == 32
