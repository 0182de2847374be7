"""The pipeline's stages against brute force, each on its own input."""

import os
import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import test_line_runs, test_signature_join
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    draw = random.Random(3)
    line = "the same line stands in several documents\n"
    base = prose(draw, 60)
    more = [
        (10_000, None, "en", "src1", 0), (10_001, "", None, None, 0), (None, "a text without an id " * 5, "en", "src1", 9),
        *[(10_010 + i, line + prose(draw, 30), "en", "src2", 1) for i in range(4)],
        *[(10_020 + i, base + f" ending {i}", "en", "src2", 1) for i in range(3)],
        (10_030, prose(draw, 40), "en", "src2", 1), (10_030, prose(draw, 40), "en", "src2", 1),
    ]
    return own.unionByName(spark.createDataFrame(more, own.schema)).repartition(3).cache()


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "language ID", "line dedup", "n-gram Jaccard join", "packing",
    ]


def test_quality_drops_junk_and_keeps_clean_documents(spark, docs):
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns and not as_rows(kept) - as_rows(docs)
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert sum((i in ids) == bool(q) for i, q in labels.items()) > 0.9 * len(labels)


def test_language_drops_what_has_no_letters(spark, docs):
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = as_rows(docs) - as_rows(kept)
    assert {r[0] for r in gone} >= {10_000, 10_001} and len(gone) <= 2 + 0.02 * docs.count()


def test_line_dedup(spark, docs):
    kept = corpus_pipeline.line_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    want = test_line_runs.brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(
        pair for (i, t, _, _), n in want.items() for pair in [(i, t)] * n
    )
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())


def shingles(text):
    words = (text or "").encode().translate(test_signature_join.LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def groups_of(rows):
    """Rows grouped by links of texts: a link is a similarity of 0.75 or more, an empty set has none."""
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and group[i] != group[j] and 100 * len(a & b) >= 75 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_one_document_of_each_group_stays(spark, docs):
    draw = random.Random(8)
    text, near = prose(draw, 50), prose(draw, 50)
    more = [
        (1, text), (1, text), (2, text + " more"), (None, near), (None, near), (3, None), (3, None), (4, ""), (4, ""), (5, "two words"),
        (6, "two words"), (7, near + " end"), (None, "alone without an id"), (None, "alone without an id"),
    ]
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], docs.schema)
    for table in (docs, extra, docs.where("doc_id < 40").unionByName(extra)):
        kept = corpus_pipeline.near_dedup(spark, table, SF)
        assert kept.columns == docs.columns and not as_rows(kept) - as_rows(table)
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        want = Counter()
        groups = {}
        for (i, t), g in zip(rows, groups_of(rows)):
            if shingles(t):
                groups.setdefault(g, []).append(i)
            else:
                want[i] += 1
        want.update(min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values())
        assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_whole_run(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and {r["length"] > 0 for r in pieces} == {True}
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0


def test_packing_yields_the_token_ids(spark, docs):
    pieces = corpus_pipeline.packing(spark, docs.where("doc_id >= 10000"), SF).collect()
    assert pieces and all(len(r["tokens"]) == 4 * r["length"] and zlib.crc32(r["tokens"]) == r["ids_crc32"] for r in pieces)
