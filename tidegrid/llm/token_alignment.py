"""Alignment of two tokenizers over a corpus, pairs counted by external merging.

Both tokenizers cut the same bytes; where tokens of both end, a group ends, and the two
tokens that end there are linked.  Map tasks write the pairs of a few documents at a time as
runs: sorted by (B id, A id, document), radix-partitioned by B id, compressed with zstd.
A k-way heap merge over the runs of a radix counts each pair; in the order of B ids the
largest count of a B id is known as soon as its pairs are through.  The counts then meet the
runs again, and every run sends back one sum for each of its documents.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.curve_packing import _byte_letters, load_encoder
from tidegrid.llm.shared import partitions, settle, stage

#: Documents and characters that one set of runs holds.
UNIT_DOCS, UNIT_CHARS = 2048, 1 << 21
#: Longer texts are cut at spaces between words, which no token of either tokenizer crosses.
SLICE_CHARS = 1 << 20
RADIXES = 32
#: Pairs of all its runs that one merge takes, and records that one task sends back.
MERGE_PAIRS, BACK_RECORDS = 1 << 22, 1 << 25
BLOCK = 4096
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Tokenizers:
    """Ids and token bytes of a byte-level BPE file (A) and a SentencePiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encode_a = load_encoder(path_a, special=False)
        with open(path_a, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in letters for c in token):
                self.bytes_a[i] = bytes(letters[c] for c in token)
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.model_b, self.bytes_b, self.cuttable = model, [], True
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            # A piece that goes on over a space would cross a cut.
            self.cuttable &= "▁" not in piece.lstrip("▁")
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.len_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.len_b = np.array([len(b) for b in self.bytes_b], np.int64)
        # Each id as it is written inside a side, at the end of A's side, and at the end of B's.
        self.written = [s for i in range(max(self.size_a, self.size_b)) for s in (b"%d," % i, b"%d|" % i, b"%d;" % i)]

    def both(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text under both, None where the tokens' bytes are not those of space+text."""
        out = []
        for text, ids in zip(texts, self.model_b.encode(texts, num_threads=1)):
            whole = b" " + text.encode()
            a = self.encode_a(" " + text)
            same = (
                b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole
                and b"".join(map(self.bytes_b.__getitem__, ids)) == whole
            )
            out.append((a.astype(np.int64), np.array(ids, np.int64)) if same else None)
        return out


@functools.cache
def load(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text cut at single spaces between words, which are left out: A is given a space
    before each slice and B puts one there itself."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


@dataclass
class Aligned:
    """Texts of one pass: sizes and written groups of each, and links as (document, A id, B id)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    written: list[bytes]
    doc: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(known: Tokenizers, ids: list[tuple[np.ndarray, np.ndarray] | None]) -> Aligned:
    """Groups and links of texts from their ids; all texts at a time, as if they were one."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sides = [none if pair is None else pair for pair in ids]
    n_a, n_b = (np.array([len(s[k]) for s in sides], np.int64) for k in (0, 1))
    a, b = (np.concatenate([s[k] for s in sides]) if sides else none[0] for k in (0, 1))
    ends_a, ends_b = np.cumsum(known.len_a[a]), np.cumsum(known.len_b[b])
    size = int(ends_a[-1]) + 1 if len(a) else 1
    at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
    at_a[ends_a] = True
    at_b[ends_b] = True
    last_a, last_b = at_b[ends_a], at_a[ends_b]
    doc_a = np.repeat(np.arange(len(sides)), n_a)
    doc = doc_a[last_a]
    # Where each token is written: A's side of a group, then B's.
    stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    order = np.zeros(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.append(0, stop_b)[group_a]] = 3 * a + last_a
    order[np.arange(len(b)) + stop_a[group_b]] = 3 * b + 2 * last_b
    bounds = np.append(0, np.cumsum(n_a + n_b))
    get = known.written.__getitem__
    written = [b"".join(map(get, order[s:e].tolist())) for s, e in zip(bounds, bounds[1:])]
    return Aligned(n_a, n_b, np.bincount(doc, minlength=len(sides)).astype(np.int64), written, doc, a[last_a], b[last_b])


# --------------------------------------------------------------------- runs


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _spread(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def radix_of(b: np.ndarray) -> np.ndarray:
    return ((b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59)).astype(np.int64) % RADIXES


def runs_of(known: Tokenizers, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(radix, pairs, records, heads, tails) of the links of some documents.

    Heads are pairs in order with their links and records; tails are the records, (document, links).
    """
    if not len(doc):
        return
    n_docs = int(doc.max()) + 1
    key = b * known.size_a + a
    span = known.size_a * known.size_b
    record, links = np.unique((radix_of(b) * span + key) * n_docs + doc, return_counts=True)
    doc, key = record % n_docs, record // n_docs
    first = np.append(True, key[1:] != key[:-1])
    at = np.flatnonzero(first)
    heads, sums, held = key[at], np.add.reduceat(links, at), np.diff(np.append(at, len(key)))
    radix = heads // span
    for r in np.unique(radix):
        lo, hi = np.searchsorted(radix, [r, r + 1])
        start, stop = at[lo], at[hi] if hi < len(at) else len(key)
        yield (
            int(r), int(hi - lo), int(stop - start), _heads(heads[lo:hi] - r * span, sums[lo:hi], held[lo:hi]),
            _squeeze(doc[start:stop].astype("<u4"), links[start:stop].astype("<i8")),
        )


def _heads(keys: np.ndarray, sums: np.ndarray, held: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=0)
    return _squeeze(steps.astype("<i8"), sums.astype("<i8"), held.astype("<i8"))


def read_heads(blob: bytes) -> np.ndarray:
    """Rows: keys, sums, records."""
    out = np.frombuffer(_spread(blob), "<i8").reshape(3, -1).copy()
    out[0] = np.cumsum(out[0])
    return out


def _in_order(blob: bytes) -> Iterator[tuple[int, int]]:
    rows = read_heads(blob)
    for at in range(0, rows.shape[1], BLOCK):
        yield from zip(rows[0, at : at + BLOCK].tolist(), rows[1, at : at + BLOCK].tolist())


def merged(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, links) over all runs, pairs in order: a k-way heap merge."""
    held, total = None, 0
    for key, n in heapq.merge(*map(_in_order, blobs)):
        if key == held:
            total += n
            continue
        if held is not None:
            yield held, total
        held, total = key, n
    if held is not None:
        yield held, total


def _grouped(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that follow each other and share their first ``n_keys`` values, group by group."""
    key, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != key:
                if group:
                    yield key, group
                key, group = row[:n_keys], []
            group.append(row[n_keys:])
    if group:
        yield key, group


def _merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (radix, _), group in _grouped(batches, 2):
        pairs = np.array(list(merged([blob for blob, in group])), np.int64).reshape(-1, 2)
        blob = _heads(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([blob], pa.binary())], ["radix", "heads"])


def _count(size_a: int):
    """All runs of a radix to its pairs with their counts and whether they are their B id's largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix,), group in _grouped(batches, 1):
            keys, counts, best = [], [], []
            start = most = 0
            side = None
            for key, n in merged([blob for blob, in group]):
                if key // size_a != side:  # the B id before is through
                    best += [c == most for c in counts[start:]]
                    side, start, most = key // size_a, len(counts), 0
                keys.append(key)
                counts.append(n)
                most = max(most, n)
            best += [c == most for c in counts[start:]]
            blob = _heads(np.array(keys, np.int64), np.array(counts, np.int64), np.array(best, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([blob], pa.binary())], ["radix", "heads"])

    return run


BACK = pa.schema([("unit", pa.int64()), ("docs", pa.binary()), ("best", pa.binary()), ("sums", pa.binary())])


def _send_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a radix come first, then its runs, each to sums for its documents."""
    at, table = None, None
    for batch in batches:
        out = []
        for radix, part, unit, heads, tails in zip(*(c.to_pylist() for c in batch.columns)):
            if unit is None:
                at, table = (radix, part), read_heads(heads)
                continue
            if at != (radix, part):
                raise ValueError("a run without its counts")
            keys, _, held = read_heads(heads)
            place = np.searchsorted(table[0], keys)
            raw = _spread(tails)
            n = len(raw) // 12
            doc, links = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<i8", n, 4 * n)
            docs, which = np.unique(doc, return_inverse=True)
            best, sums = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            np.add.at(best, which, links * np.repeat(table[2][place], held))
            np.add.at(sums, which, links * np.repeat(table[1][place], held))
            out.append((unit, docs.astype("<u4").tobytes(), best.tobytes(), sums.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), BACK)], schema=BACK)


# ----------------------------------------------------------------- operator


def _code(path_a: str, path_b: str, schema: pa.Schema, keep_groups: bool):
    none_doc, none_run = (None,) * 8, (None,) * 5

    def doc_row(unit, place, doc, n_a, n_b, n_groups, digest, groups) -> tuple:
        return (unit, place, doc, n_a, n_b, n_groups, digest, groups, *none_run)

    def small(known: Tokenizers, unit: int, docs: list[tuple]) -> Iterator[tuple]:
        some = [i for i, (_, text) in enumerate(docs) if text]
        ids: list = [None] * len(docs)
        for i, pair in zip(some, known.both([docs[i][1] for i in some])):
            ids[i] = pair
        found = align(known, ids)
        for i, (doc, _) in enumerate(docs):
            whole = found.written[i][:-1]
            yield doc_row(
                unit, i, doc, int(found.n_a[i]), int(found.n_b[i]), int(found.n_groups[i]),
                hashlib.sha256(whole).hexdigest() if whole else "", whole.decode() if keep_groups else None,
            )
        for run in runs_of(known, found.doc, found.link_a, found.link_b):
            yield (unit, *none_doc[1:], *run)

    def large(known: Tokenizers, unit: int, doc, text: str) -> Iterator[tuple]:
        """A long text in slices: first whether its bytes come back, then its runs."""
        sizes, digest, kept = np.zeros(3, np.int64), hashlib.sha256(), []
        held = b""
        if known.cuttable and all(known.both([part])[0] is not None for part in slices(text)):
            for part in slices(text):
                found = align(known, known.both([part]))
                sizes += [found.n_a[0], found.n_b[0], found.n_groups[0]]
                digest.update(held)  # the mark after the last group is not written
                digest.update(found.written[0][:-1])
                held = found.written[0][-1:]
                if keep_groups:
                    kept.append(found.written[0])
                for run in runs_of(known, found.doc, found.link_a, found.link_b):
                    yield (unit, *none_doc[1:], *run)
        whole = b"".join(kept)[:-1].decode() if keep_groups else None
        yield doc_row(unit, 0, doc, *map(int, sizes), digest.hexdigest() if held else "", whole)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = load(path_a, path_b)
        unit, docs, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text and len(text) > SLICE_CHARS and known.cuttable:
                    yield from large(known, unit, doc, text)
                    unit += 1
                    continue
                docs.append((doc, text))
                size += len(text or "")
                if len(docs) >= UNIT_DOCS or size >= UNIT_CHARS:
                    yield from small(known, unit, docs)
                    unit, docs, size = unit + 1, [], 0
        if docs:
            yield from small(known, unit, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in rows(batches):
            out.append(row)
            size += 200 + len(row[-1] or b"") + len(row[-2] or b"") + len(row[7] or "")
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


@dataclass(frozen=True)
class Alignment:
    """``documents``: a row for each document.  ``pairs``: ``b``, ``a``, their links corpus-wide
    (``n_links``) and whether no other A id has more with this B id (``best``)."""

    documents: DataFrame
    pairs: DataFrame


def align_tokenizers(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_groups: bool = False,
) -> Alignment:
    """Align a byte-level BPE (A, over space+text) with a SentencePiece model (B, over text).

    Per document: its id, ``n_a`` and ``n_b`` (tokens), ``n_groups`` (stretches between places
    where tokens of both end), ``n_links`` (pairs of tokens that end together), ``n_best``
    (links whose pair is the most frequent of its B id in the corpus, ties included),
    ``count_sum`` (corpus-wide links of the pairs of all its links) and ``groups_sha256`` of
    ``a1,a2|b1;a3|b2,b3``; ``groups`` holds that text itself with ``keep_groups``.

    Special tokens' strings are ordinary text.  A document whose text is null or empty, or whose
    tokens' bytes are not those of space+text under either tokenizer, has no tokens: zeros and
    an empty string.  Rows that share an id, or all of their columns, are documents of their
    own; an empty table gives empty results.  Other columns are not looked at.

    Runs are written, so that counting and sending back read them without coding again.  A
    radix whose runs hold more than ``MERGE_PAIRS`` pairs is merged in slices first; documents
    go back in slices of ``BACK_RECORDS`` records, so a B id that is everywhere burdens no one task.
    """
    spark = settle(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = T.StructType([
        T.StructField("unit", T.LongType()), T.StructField("place", T.IntegerType()),
        T.StructField("doc", texts.schema["doc"].dataType), T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
        T.StructField("digest", T.StringType()), T.StructField("groups", T.StringType()),
        T.StructField("radix", T.IntegerType()), T.StructField("n_pairs", T.LongType()),
        T.StructField("n_records", T.LongType()), T.StructField("heads", T.BinaryType()), T.StructField("tails", T.BinaryType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    coded = stage(texts.mapInArrow(_code(path_a, path_b, to_arrow_schema(made), keep_groups), made))
    runs = coded.where("radix IS NOT NULL")
    known = load(path_a, path_b)
    # One row a radix.
    sizes = {
        r["radix"]: (-(-r["p"] // MERGE_PAIRS), -(-r["r"] // BACK_RECORDS))
        for r in runs.groupBy("radix").agg(F.sum("n_pairs").alias("p"), F.sum("n_records").alias("r")).collect()
    }

    def part(k: int):
        each = F.array(*[F.lit(sizes.get(r, (1, 1))[k]) for r in range(RADIXES)])
        return F.pmod(F.xxhash64("unit", "heads"), F.element_at(each, F.col("radix") + 1)).cast("int")

    blobs = "radix int, heads binary"
    heads = runs.select("radix", part(0).alias("part"), "heads")
    wide = [r for r, (n, _) in sizes.items() if n > 1]
    n_tasks = partitions(spark)
    whole = heads.where(~F.col("radix").isin(wide)).select("radix", "heads") if wide else heads.select("radix", "heads")
    if wide:
        cut = heads.where(F.col("radix").isin(wide)).repartition(n_tasks, "radix", "part")
        whole = whole.unionByName(cut.sortWithinPartitions("radix", "part").mapInArrow(_merge_slices, blobs))
    counts = stage(
        whole.repartition(min(n_tasks, RADIXES), "radix").sortWithinPartitions("radix").mapInArrow(_count(known.size_a), blobs)
    )
    parts = F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(sizes.get(r, (1, 1))[1]) for r in range(RADIXES)]), F.col("radix") + 1) - 1)
    told = counts.select("radix", F.explode(parts).alias("part"), F.lit(None).cast("long").alias("unit"), "heads", F.lit(None).cast("binary").alias("tails"))
    sent = runs.select("radix", part(1).alias("part"), "unit", "heads", "tails").unionByName(told)
    back = stage(
        sent.repartition(n_tasks, "radix", "part").sortWithinPartitions("radix", "part", F.col("unit").asc_nulls_first())
        .mapInArrow(_send_back, "unit long, docs binary, best binary, sums binary")
    )
    rows = coded.where("radix IS NULL").select("unit", "place", "doc", "n_a", "n_b", "n_groups", "digest", "groups")
    out = T.StructType([
        T.StructField(id_col, made["doc"].dataType),
        *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()),
    ])
    arrow = to_arrow_schema(out)

    def joined(own: pa.Table, come: pa.Table) -> pa.Table:
        place = own.column("place").to_numpy()
        best, sums = np.zeros((2, int(place.max()) + 1 if len(place) else 0), np.int64)
        for docs_, best_, sums_ in zip(*(come.column(c).to_pylist() for c in ("docs", "best", "sums"))):
            at = np.frombuffer(docs_, "<u4")
            best[at] += np.frombuffer(best_, np.int64)
            sums[at] += np.frombuffer(sums_, np.int64)
        return pa.Table.from_arrays(
            [*[own.column(c) for c in ("doc", "n_a", "n_b", "n_groups", "n_groups")], pa.array(best[place]), pa.array(sums[place]),
             own.column("digest"), own.column("groups")],
            schema=arrow,
        )

    found = rows.groupBy("unit").cogroup(back.groupBy("unit")).applyInArrow(joined, out)
    return Alignment(found, counts.mapInArrow(_pairs(known.size_a), "b long, a long, n_links long, best boolean"))


def _pairs(size_a: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                keys, counts, best = read_heads(blob)
                columns = (keys // size_a, keys % size_a, counts, best.astype(bool))
                for at in range(0, len(keys), 1 << 16):
                    part = [pa.array(c[at : at + (1 << 16)]) for c in columns]
                    yield pa.RecordBatch.from_arrays(part, ["b", "a", "n_links", "best"])

    return run
