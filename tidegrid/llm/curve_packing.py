"""Sequence packing along a space-filling curve.

A document's token counts are hashed into a vector, the vector is projected to a few
dimensions, and its cell on a grid gives a Hilbert key.  Documents are range-sorted by
that key; every range is cut into sequences in its order, so that neighbours on the
curve share sequences.  Cuts are free, so only the end of a range is not full; it is
cut into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import settle, stage

OUT_BYTES = 8 << 20


#: A run of white space this long is left to the library: the faster one's pattern search
#: keeps a step for each of its characters and gives up at about a million.
LONG_BLANK = re.compile(r"\s{100000}")


@functools.cache
def load_encoder(path: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """Text to ids for a tokenizer file, as the ``tokenizers`` library codes it.

    ``special`` says whether special tokens' strings in a text become their ids (the
    library's default) or are ordinary text.  A plain byte-level BPE is run by the faster of
    the two libraries that know it; the ids are the same, which a test shows for every code point.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    before, model = described.get("pre_tokenizer") or {}, described["model"]
    added = described.get("added_tokens", [])
    plain = (
        described.get("normalizer") is None
        and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        and all(model["vocab"].get(a + b, -1) == 256 + i for i, (a, b) in enumerate(map(_pair, model["merges"])))
        and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
    )
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not special

    def slow(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    if not plain:
        return slow
    import public_tokenizers
    import tiktoken

    marks = {t["content"]: t["id"] for t in added}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in marks}
    fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
    allowed = set(marks) if special else set()

    def encode(text: str) -> np.ndarray:
        if len(text) >= 100_000 and LONG_BLANK.search(text):
            return slow(text)
        return fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())

    return encode


def _pair(merge) -> list[str]:
    return merge.split(" ") if isinstance(merge, str) else merge


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1
    bytes for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates (Skilling 2004)."""
    x = [np.array(c, np.int64) for c in cells.T]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> b) & 1)
    return key


class Projection:
    """Hashed token counts to a cell of a grid of ``2**bits`` steps a side."""

    def __init__(self, dims: int = 4, bits: int = 10, buckets: int = 1024, seed: int = 7):
        self.bits, self.buckets = bits, buckets
        self.axes = np.random.default_rng(seed).standard_normal((buckets, dims))

    def vector(self, ids: np.ndarray) -> np.ndarray:
        hashed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(self.buckets)
        counts = np.bincount(hashed.astype(np.int64), minlength=self.buckets).astype(np.float64)
        return counts / max(np.sqrt(counts @ counts), 1.0)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        steps = 1 << self.bits
        # Every axis is about standard normal over directions.
        cells = ((np.clip(vectors @ self.axes, -3, 3) + 3) / 6 * steps).astype(np.int64)
        return hilbert_keys(np.minimum(cells, steps - 1), self.bits)


CODED = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECE = pa.schema([
    ("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tokens", pa.binary()),
])


def _code(path: str, end_id: int, projection: Projection):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            coded = [np.concatenate([encode(t), end]) for t in batch.column(1).to_pylist()]
            vectors = np.array([projection.vector(ids) for ids in coded]).reshape(len(coded), -1)
            keys = projection.keys(vectors) if coded else np.zeros(0, np.int64)
            # Two bytes an id where they are enough; the length tells which.
            packed = [ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes() for ids in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys), pa.array([len(i) for i in coded], pa.int64()), pa.array(packed, pa.binary())],
                schema=CODED,
            )

    return run


def _cut(capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId() << 33
        sequence, fill, open_pieces = 0, 0, []
        for batch in batches:
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "ids"))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    length = min(n - at, capacity - fill)
                    open_pieces.append((doc, at, n, ids[at : at + length]))
                    at, fill = at + length, fill + length
                    if fill == capacity:
                        yield from _closed(open_pieces, part + sequence)
                        sequence, fill, open_pieces = sequence + 1, 0, []
        # The end of the range, in sequences of the powers of two that add up to it.
        while fill:
            length = 1 << (fill.bit_length() - 1)
            first, open_pieces = _split(open_pieces, length)
            yield from _closed(first, part + sequence)
            sequence, fill = sequence + 1, fill - length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in rows(batches):
            out.append(row)
            size += len(row[-1]) + 100
            if size > OUT_BYTES:
                yield _record(out)
                out, size = [], 0
        if out:
            yield _record(out)

    return run


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE)], schema=PIECE)


def _closed(pieces: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc, start, n, ids in pieces:
        yield doc, start, len(ids), n, sequence, offset, ids.tobytes()
        offset += len(ids)


def _split(pieces: list[tuple], length: int) -> tuple[list[tuple], list[tuple]]:
    """The pieces of the first ``length`` ids, and the rest."""
    first, rest = [], []
    for doc, start, n, ids in pieces:
        if length:
            first.append((doc, start, n, ids[:length]))
        if len(ids) > length:
            rest.append((doc, start + length, n, ids[length:]))
        length = max(0, length - len(ids))
    return first, rest


def pack_along_curve(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    dims: int = 4,
    bits: int = 10,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    One row per piece: the id column, ``start`` and ``length`` in the document's ids,
    ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` in the sequence, and
    ``tokens`` (the ids, little-endian unsigned 32-bit).  Every id lies in one piece.
    A sequence is full, or its length is a power of two at the end of a range.

    A null or empty text is the end id alone.  Null and repeated ids are packed like
    others; rows that are alike in everything may change places.  An empty table gives
    an empty result; other columns are not looked at.
    """
    settle(docs.sparkSession)
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    # Written once: the range bounds are sampled from the keys, which cost a tokenization.
    coded = stage(
        texts.mapInArrow(_code(tokenizer_path, end_id, Projection(dims, bits)), "doc long, key long, n long, ids binary")
    )
    ordered = coded.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc", "ids")
    pieces = ordered.mapInArrow(
        _cut(capacity),
        "doc long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary",
    )
    return pieces.withColumnRenamed("doc", id_col)
