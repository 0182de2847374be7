import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidegrid.llm.site_quality import features, fit_evidence, fit_quality, score_quality


def junk(draw, n):
    kind = draw.randrange(3)
    words = prose(draw, n).split()
    if kind == 0:
        return " ".join(w + draw.choice(["###", "%%%", "$$$"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w for w in words[: max(1, n // 20)] for _ in range(20))


def corpus(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        bad = draw.random() < (0.9 if i % 10 == 0 else 0.15)
        rows.append((i, (junk if bad else prose)(draw, draw.randint(40, 200)), "en", f"site{i % 10}", int(not bad)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame(
        [(*r[:4], 1, "x", [2]) for r in rows],
        "doc_id long, text string, lang string, source string, good int, host string, row array<int>",
    )
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] is not None and r[4] is not None], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy_and_site_rates(spark):
    rows = corpus(900)
    docs, labels = frames(spark, rows)
    model = fit_quality(docs, labels, held_out=F.col("id") % 3 == 0)
    got = {r["doc_id"]: r for r in score_quality(docs, model).collect()}
    truth = {r[0]: r[4] for r in rows}
    out = [i for i in got if i % 3 == 0]
    assert np.mean([got[i]["quality_kept"] == bool(truth[i]) for i in out]) > 0.97
    assert np.mean([not got[i]["quality_kept"] for i in out if truth[i]]) < 0.02
    assert got[10]["host_rate"] < 0.4 < 0.7 < got[11]["host_rate"]
    assert got[1]["host"] == "x" and got[1]["row"] == [2]


def test_sparse_sites_shrink_toward_the_rate_of_all(spark):
    rows = corpus(600) + [(5000, junk(random.Random(2), 100), "en", "lonely", 0), (5001, prose(random.Random(2), 100), "en", "alone", 1)]
    docs, labels = frames(spark, rows)
    got = {r["doc_id"]: r for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    # A site of one document tells nothing about that document: its rate is that of all.
    assert got[5000]["host_rate"] == pytest.approx(got[5001]["host_rate"])
    assert abs(got[11]["host_rate"] - got[5001]["host_rate"]) > 0.02




def test_rates_follow_the_formula(spark):
    rows = corpus(200)
    docs, labels = frames(spark, rows)
    model = fit_quality(docs, labels)
    got = score_quality(docs, model).collect()
    p = {r["doc_id"]: 1 / (1 + np.exp(-(r["evidence"] + model.base))) for r in got}
    by_site = {}
    for r in rows:
        by_site.setdefault(r[3], []).append(p[r[0]])
    # Two documents of a site give the strength; it explains the others.
    for site, values in by_site.items():
        mine = [r for r in got if r["source"] == site]
        total, n = sum(values), len(values)
        a = np.array([[r["host_rate"] * (n - 1) - (total - p[r["doc_id"]])] for r in mine])
        b = np.array([np.clip(np.mean(list(p.values())), 1e-3, 1 - 1e-3) - r["host_rate"] for r in mine])
        fit = (a[:, 0] / b)
        assert fit == pytest.approx(fit[0], rel=1e-6)
    for r in got:
        odds = np.log(r["path_rate"] / (1 - r["path_rate"])) + r["evidence"]
        assert r["quality_score"] == pytest.approx(1 / (1 + np.exp(-odds)))


def test_awkward_rows(spark, make_docs, awkward):
    docs = make_docs(awkward, lang=None, source=None)
    draw = random.Random(1)
    rows = np.array([features(prose(draw, 50).encode()) for _ in range(40)] + [features(junk(draw, 50).encode()) for _ in range(40)])
    model = fit_evidence(rows, np.repeat([1.0, 0.0], 40))
    got = score_quality(docs, model).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(repr, awkward))
    assert all(0 < r["quality_score"] < 1 and np.isfinite(r["evidence"]) for r in got)


def test_no_labels_and_no_rows(make_docs, spark):
    docs = make_docs([(1, "some text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_quality(docs, none) is None
    assert all(r["quality_kept"] for r in score_quality(docs, None).collect())
    assert score_quality(make_docs([]), None).count() == 0
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert fit_quality(docs, one) is None
