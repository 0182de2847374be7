"""The clause grammar: its machines against plain rules, its learning on held-out documents."""

import random
import zlib

import numpy as np
import pytest

from tidegrid.llm import clause_grammar as g
from tidegrid.llm.queries import QUERIES

CLASS_WORDS = {g.OTHER: "river", g.INSULT: "idiot", g.THREAT: "kill", g.TARGET: "you", g.NEGATION: "not", g.REPORT: "said"}


def model():
    return g.train([])


def plain_outcomes(symbols):
    """How every insult and threat of one clause stands, by looking around it."""
    out = []
    for i, s in enumerate(symbols):
        near = g.TARGET in symbols[max(0, i - g.NEAR) : i]
        negated = g.NEGATION in symbols[max(0, i - g.SCOPE) : i]
        reported = g.REPORT in symbols[:i]
        if s == g.INSULT:
            out.append((i, "negated" if negated else "reported" if reported else "targeted" if near else "plain"))
        if s == g.THREAT and (near or g.TARGET in symbols[i + 1 : i + 1 + g.NEAR]):
            out.append((i, "idle_threat" if negated or reported else "threat"))
    return sorted(o for _, o in out)


def test_composed_machine_against_plain_rules():
    draw, made = random.Random(4), model()
    for _ in range(600):
        symbols = [draw.choice([0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(draw.randint(1, 14))]
        found = list(made.clauses(" ".join(CLASS_WORDS[s] for s in symbols) + "."))
        assert sorted(o for _, _, _, words in found for _, o, _ in words) == plain_outcomes(symbols)


def test_clauses_are_matched_on_their_own():
    found = list(model().clauses("You idiot! He said\nthe river is not stupid; moron"))
    assert [[(w, o) for w, o, _ in words] for _, _, _, words in found] == [
        [("idiot", "targeted")], [("stupid", "negated")], [("moron", "plain")],
    ]
    assert all(start < end for start, end, _, _ in found)


def test_context_changes_the_score():
    judge = model().judge
    plain, targeted, negated = (judge(t)[0] for t in ("the idiot is here", "you are an idiot", "this is not an idiot"))
    assert targeted > plain > negated
    assert judge("I will kill you")[0] > judge("he said he will kill you")[0] > judge("they beat the record")[0] - 1
    assert judge("")[0] == pytest.approx(judge("   ")[0], abs=0.2)


def test_long_texts_are_read_in_slices():
    text = ("word " * 30_000 + "you idiot. ") * 2 + "x" * 200_000
    assert list(g.tokens(text)) == g._TOKEN.findall(text.lower())
    assert [w for _, _, _, words in model().clauses(text) for w, _, _ in words] == ["idiot", "idiot"]


def test_words_fall_back_to_their_beginning():
    draw = random.Random(1)
    rows = []
    for i in range(300):
        words = [draw.choice("river stone cloud light tree".split()) for _ in range(30)]
        if i % 5 == 0:
            words[draw.randrange(30)] = "grobmen" + draw.choice(["ta", "ti", "to", "tu", "te", "ty", "la", "lo"])
        rows.append((" ".join(words), int(i % 5 == 0)))
    made = g.train(rows)
    assert made.trie.weight("grobmenxx") > 1 and made.trie.weight("river") == 0
    assert made.judge("river stone grobmenxx cloud")[0] > made.judge("river stone cloud")[0] + 0.3


def test_logistic_fit_finds_the_optimum():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, len(g.PRIOR)))
    y = (draw.random(400) < 1 / (1 + np.exp(-(x[:, 0] * 2 - 1)))).astype(float)
    w, bias = g.fit_logistic(x, y, g.PRIOR)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(x.T @ (p - y) + 0.3 * (w - g.PRIOR)).max() < 1e-5 and abs((p - y).sum()) < 1e-5


def test_awkward_tables(spark, make_docs, awkward):
    docs = make_docs([*awkward, (20, "you stupid idiot. you moron"), (21, "z" * 300_000)]).withColumnRenamed("n", "toxicity")
    labels = spark.createDataFrame([(20, 1), (5, 0), (None, 1), (6, None), (20, 0)], "doc_id long, toxic int")
    fitted = g.fit_toxicity(docs, labels)
    rows = g.score_toxicity(docs, fitted).collect()
    assert len(rows) == len(awkward) + 2 and all(0 <= r["toxicity"] <= 1 for r in rows)
    top = max(rows, key=lambda r: r["toxicity"])
    assert top["doc_id"] == 20 and top["matched"][0]["words"]
    none = {r["text"]: r["toxicity"] for r in rows}
    assert none[None] == none[""]
    assert g.score_toxicity(make_docs([]), fitted).collect() == []
    assert g.fit_toxicity(docs, labels.where("false")).bias == -2.0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op12_toxicity"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got) == sorted(r["doc_id"] for r in docs)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    out = [(t, got[i]["predicted"]) for i, t in labels if got[i]["held_out"]]
    assert sum(p for t, p in out if t == 0) <= 1
    assert sum(p for t, p in out if t) >= 0.75 * sum(t for t, _ in out)
