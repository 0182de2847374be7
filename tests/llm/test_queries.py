"""Registered queries of this part over the small tables."""

import os

import pytest

import __spark_entry__ as contract
from tidegrid.llm.queries import ORACLES, QUERIES
from tools.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and "pipeline" in contract.queries()
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    relation = duck.sql(ORACLES[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert compare(QUERIES[name](spark, SF), relation.df(), types) == "ok"


def texts(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


def test_merge_dropout(spark, duck):
    got = QUERIES["op1_merge_dropout"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in texts(duck))
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"] or []) for r in got)


def test_packing(spark, duck):
    import numpy as np
    import public_tokenizers

    from tests.llm.test_curve_packing import check
    from tidegrid.llm.curve_packing import pack_along_curve

    got = QUERIES["op4_packing"](spark, SF).collect()
    import zlib

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts(duck)}
    for r in got:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    whole = pack_along_curve(spark.read.parquet(f"{SF}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    check(texts(duck), whole.collect(), 2048)


def test_quality_and_language(spark, duck):
    labels = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    got = QUERIES["op5_quality"](spark, SF).collect()
    known = [r for r in got if r["doc_id"] in labels]
    assert len(got) == len(texts(duck)) and sum(r["kept"] == bool(labels[r["doc_id"]]) for r in known) > 0.9 * len(known)
    langs = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["op8_language"](spark, SF).collect()
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in out) > 0.95 * len(out)


def test_jaccard(spark, duck):
    from tests.llm.test_signature_join import brute, found

    assert found(QUERIES["op6_jaccard_join"](spark, SF)) == brute(texts(duck))


def test_language_model(spark, duck):
    from tests.llm.test_gated_lm import brute, key, remainder

    got = sorted((tuple(r)[:6] for r in QUERIES["op7_language_model"](spark, SF).collect()), key=key)
    want = sorted(brute(texts(duck), remainder), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_embeddings(spark, duck):
    from tests.llm.test_cover_tree import brute, found

    rows = duck.sql("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert found(QUERIES["op9_embedding_dedup"](spark, SF)) == brute(rows)
