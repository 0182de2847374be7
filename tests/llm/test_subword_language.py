import random
import zlib

import numpy as np

from tidegrid.llm.subword_language import GRAMS, SubwordModel, fit_language, predict_language, subwords, train

STEMS = {
    "en": "the ing tion and that with from ly ed wh".split(), "de": "der ung sch ein ich über keit ver zu ä".split(),
    "fr": "le que eau ère é tion pour avec oui ç".split(),
}


def text_in(draw, lang, n):
    return " ".join("".join(draw.choices(STEMS[lang], k=draw.randint(1, 3))) for _ in range(n))


def corpus(n, seed=1):
    draw = random.Random(seed)
    return [(lang := draw.choice(list(STEMS)), text_in(draw, lang, draw.randint(4, 80))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, 3, "old") for i, (lang, t) in enumerate(rows)],
        "doc_id long, text string, lang string, lang_score int, _text string",
    )


def test_held_out_accuracy(spark):
    docs = frame(spark, corpus(600))
    rows = predict_language(docs, fit_language(docs)).collect()
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97
    assert np.mean([r["lang_rejected"] for r in out]) < 0.02
    assert all(0 <= r["lang_score"] <= 1 and r["_text"] == "old" for r in rows)


def test_held_out_documents_are_not_learned_from(spark):
    rows = corpus(200)
    swapped = [("xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, t) for i, (lang, t) in enumerate(rows)]
    a, b = (fit_language(frame(spark, r)) for r in (rows, swapped))
    assert a.langs == b.langs == ["de", "en", "fr"] and (a.scores == b.scores).all()


def test_undetermined_and_awkward_texts(make_docs, awkward):
    rows = [(r["doc_id"], r["text"], r["lang_pred"], r["lang_score"], r["lang_rejected"]) for r in predict_language(
        make_docs(awkward + [(50, "42 !!"), (51, "日本")]), train([b"the and"] * 5 + ["über".encode()] * 5, ["en"] * 5 + ["de"] * 5)
    ).collect()]
    assert len(rows) == len(awkward) + 2
    for _, text, pred, score, rejected in rows:
        lettered = any(c.isalpha() for c in text or "")
        assert (pred in ("en", "de")) == lettered and (lettered or (pred == "und" and score == 0 and rejected))


def test_no_labels_and_no_rows(make_docs):
    docs = make_docs([(1, "text"), (2, None)], lang=None)
    assert fit_language(docs) is None
    assert {r["lang_pred"] for r in predict_language(docs, None).collect()} == {"und"}
    assert predict_language(make_docs([]), None).count() == 0


def test_unlike_anything_is_unsure():
    rows = corpus(300)
    model = train([t.encode() for _, t in rows], [lang for lang, _ in rows])
    known = model.probabilities([rows[0][1].encode()])[0].max()
    assert known > model.probabilities(["xqzj kkw bvp".encode()])[0].max()


def test_subwords_of_a_batch_are_those_of_each_text():
    texts = [b"", b"The cat", "über  42 straße".encode(), b"x" * 70, b" ", b"a"]
    codes, counts = subwords(texts, 1 << 12)
    at = np.cumsum(counts) - counts
    for i, text in enumerate(texts):
        alone, _ = subwords([text], 1 << 12)
        assert sorted(alone) == sorted(codes[at[i] : at[i] + counts[i]])
    assert counts[1] == sum(2 * (3 + 2) - 2 * (n - 1) for n in GRAMS) and counts[0] == 0


def test_calibration_keeps_the_best_language():
    model = SubwordModel(["a", "b"], np.zeros((8, 2), np.float32), np.array([0.0, 1.0]), temperature=2.0)
    assert model.probabilities([b"text"])[0].argmax() == 1


def gibberish(draw, n):
    return " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(n))


def test_gibberish_and_unlearned_languages_are_rejected_and_clean_texts_are_not():
    draw = random.Random(4)
    rows = corpus(600)
    clean = corpus(400, seed=2)
    junk = [gibberish(draw, draw.randint(5, 80)).encode() for _ in range(200)]
    model = train([t.encode() for _, t in rows], [lang for lang, _ in rows])
    assert model.judge(junk)[2].mean() > 0.98
    assert model.judge([t.encode() for _, t in clean])[2].mean() <= 0.01
    for left in STEMS:
        model = train([t.encode() for lang, t in rows if lang != left], [lang for lang, _ in rows if lang != left])
        assert model.judge([t.encode() for lang, t in clean if lang == left])[2].mean() > 0.95
        assert model.judge([t.encode() for lang, t in clean if lang != left])[2].mean() <= 0.01


def test_few_rows_also_set_a_limit():
    draw = random.Random(5)
    rows = corpus(16, seed=3)
    model = train([t.encode() for _, t in rows], [lang for lang, _ in rows])
    assert model.judge([gibberish(draw, 40).encode() for _ in range(20)])[2].mean() > 0.9


def test_slices_change_nothing(monkeypatch):
    from tidegrid.llm import subword_language as sl

    draw = random.Random(6)
    texts = [t.encode() for _, t in corpus(30)] + [b"", "日本語テキスト".encode() * 400, b"a" * 3000, b"  ", text_in(draw, "de", 900).encode()]
    model = train([t.encode() for _, t in corpus(60)], [lang for lang, _ in corpus(60)])
    whole = model.means(texts)
    plain = []
    for text in texts:  # gram by gram
        flat = bytes(sl._BYTE[np.frombuffer(b" " + text + b" ", np.uint8)])
        n = 0
        for size in GRAMS:
            for i in range(len(flat) - size + 1):
                gram = flat[i : i + size]
                n += 32 not in gram[1:-1] and not (size == 2 and gram == b"  ")
        plain.append(n)
    assert whole[2].tolist() == plain
    monkeypatch.setattr(sl, "SLICE_BYTES", 37)
    small = model.means(texts)
    assert small[2].tolist() == plain
    assert np.allclose(small[0], whole[0], rtol=1e-9, atol=1e-9) and np.allclose(small[1], whole[1], rtol=1e-9, atol=1e-9)
