import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidegrid.llm.line_runs import LineRuns, drop_repeated_lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    owner = {k: max(ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in owner or owner[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "line_count", "lines_dropped").collect())


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_random_documents(make_docs, batches, fanout):
    draw = random.Random(batches)
    pool = [f"  Shared line number {k} of the POOL, été " for k in range(25)] + ["short", "", "\t"]
    rows = [
        (None if i % 41 == 40 else i // (2 if i % 9 == 0 else 1), "\n".join(
            (x.upper() if draw.random() < 0.3 else x) for x in draw.choices(pool, k=draw.randrange(0, 7))))
        for i in range(120)
    ]
    docs = make_docs(rows)
    got = drop_repeated_lines(docs, batches=batches, fanout=fanout)
    assert found(got) == brute(rows)
    assert set(docs.columns) <= set(got.columns)


def test_awkward_rows(make_docs, awkward):
    rows = awkward + [(i, "a line that is in many documents\n" * 3) for i in range(20, 24)]
    assert found(drop_repeated_lines(make_docs(rows))) == brute(rows)


def test_empty_table(make_docs):
    assert drop_repeated_lines(make_docs([])).count() == 0


def test_runs_hold_each_hash_once_and_total_all_batches(spark):
    runs = LineRuns(spark, fanout=2, buckets=3)
    rows = spark.range(400).select((F.col("id") % 150).alias("h64"), (F.col("id") % 3).cast("int").alias("h32"), "id")
    for b in range(5):
        part = rows.where(F.col("id") % 5 == b).groupBy("h64", "h32")
        runs.add(part.agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("owner")))
    tables = [spark.table(t).select("h64", "h32") for t in runs._runs()]
    assert len(tables) < 5
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionAll(t)
    assert whole.count() == whole.distinct().count() == 150
    want = {(r["h64"], r["h32"], r["n"], r["m"]) for r in rows.groupBy("h64", "h32").agg(F.count("id").alias("n"), F.max("id").alias("m")).collect()}
    assert {tuple(r) for r in runs.totals().collect()} == want
    runs.close()


def test_documents_of_very_many_repeated_lines(make_docs):
    """Three documents of 50 thousand shared lines, one of them with own lines between: linear work."""
    shared = [f"a line of the log that others have too, number {k}" for k in range(50_000)]
    mixed = [line for k, x in enumerate(shared) for line in ((x, f"only here {k:012d} and nowhere else") if k % 50 == 0 else (x,))]
    rows = [(1, "\n".join(shared)), (2, "\n".join(mixed)), (3, "\n".join(reversed(shared))), (None, "\n".join(shared[:29_999]))]
    began = time.monotonic()
    assert found(drop_repeated_lines(make_docs(rows))) == brute(rows)
    assert time.monotonic() - began < 90
