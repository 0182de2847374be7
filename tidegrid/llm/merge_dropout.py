"""SentencePiece BPE with seeded merge-dropout, and lossless decoding.

Adjacent symbols whose union is a piece are candidates; the best is merged, the
leftmost of equals, until none is left.  A candidate is skipped for good when the keyed
hash of its place (key, document, word, which of the word's occurrences in the document,
start, middle, end) falls under the dropout rate, so a segmentation depends on the key
and the document alone, never on the machine or the order of work.  Occurrences in which
nothing is skipped share a remembered segmentation, the others are segmented anew.
Words are segmented in lockstep, a matrix of linked symbols for each range of lengths;
very long ones one by one with a heap.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.shared import packed, settle, unpacked

#: A segment: the spaces before a word, and the word.  No piece reaches over its end.
SEGMENT = re.compile(" +[^ ]*")
SPACE = "▁"
#: Symbols from here on are characters without a piece.
CHARACTER = 1 << 19
NONE = np.int64(1) << 40
WIDTHS = (6, 9, 12, 16, 24, 40, 64)
OUT_BYTES = 8 << 20
#: Occurrences of words whose candidates are looked at in one go.
PART = 100_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _place(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)


class PieceModel:
    """Pieces, merges and byte pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > CHARACTER:
            raise ValueError("too many pieces")
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        byte = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("lossless coding needs a piece for every byte")
        plain = {
            self.pieces[i]: i for i in range(n)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("pieces reach over the end of a word")
        self.byte_ids = np.zeros(256, np.int32)
        for i, b in byte.items():
            self.byte_ids[b] = i
        self.bytes = [
            bytes([byte[i]]) if i in byte else (p.replace(SPACE, " ").encode() if p in plain else b"")
            for i, p in enumerate(self.pieces)
        ]
        self.symbol = np.arange(CHARACTER, CHARACTER + 0x110000, dtype=np.int64)
        single = {p: i for p, i in plain.items() if len(p) == 1}
        for p, i in single.items():
            self.symbol[ord(" " if p == SPACE else p)] = i
        self.symbol[ord(SPACE)] = CHARACTER + ord(SPACE)  # the character itself is not a space
        # The better the score, the lower the rank; the piece's number settles equal scores.
        ranked = sorted(plain.values(), key=lambda i: (-model.get_score(i), i))
        self.by_rank = np.array(ranked, np.int64)
        rank = {i: r for r, i in enumerate(ranked)}
        pairs = {}
        for p, i in plain.items():
            for cut in range(1, len(p)):
                left, right = self._known(p[:cut], plain), self._known(p[cut:], plain)
                if left is not None and right is not None:
                    pairs[left << 21 | right] = rank[i]
        self.rank_of = pairs
        self._hash(pairs)

    def _hash(self, pairs: dict[int, int]) -> None:
        """An open hash table of the pairs; few probes find any of them, or that there is none."""
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_ranks = np.full(1 << self.bits, NONE)
        codes = np.array(list(pairs), np.int64)
        ranks = np.array(list(pairs.values()), np.int64)
        at, self.probes = self._slot(codes), 0
        while len(codes):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = codes[free]
            lost = self.slots[at] != codes  # another one has the place
            self.slot_ranks[at[~lost]] = ranks[~lost]
            codes, ranks, at = codes[lost], ranks[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _known(self, part: str, plain: dict[str, int]) -> int | None:
        if part in plain:
            return plain[part]
        return int(self.symbol[ord(part)]) if len(part) == 1 else None

    def _rank(self, left, right, key, start, middle, end, limit) -> np.ndarray:
        """Rank of each candidate; NONE where there is no such piece or it is skipped."""
        code = left << 21 | right
        at = self._slot(code)
        there = self.slots[at]
        found = np.where(there == code, self.slot_ranks[at], NONE)
        more = np.flatnonzero((there != code) & (there >= 0))
        for _ in range(self.probes - 1):
            if not len(more):
                break
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            there = self.slots[at[more]]
            hit = there == code[more]
            found[more[hit]] = self.slot_ranks[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        if limit:
            found = np.where(_mix(key + _place(start, middle, end) * _M1) >> np.uint64(32) < np.uint64(limit), NONE, found)
        return found

    def segment(
        self, words: list[str], key: int, rate: float, keys: np.ndarray | None = None, seen: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in turn, and how many each word has.

        ``keys`` holds a key for each word in place of those that follow from ``key``.  ``seen``
        gets (words, places) of all candidates that came up, but for words over ``WIDTHS``.
        """
        limit = int(rate * 2**32)
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        if keys is None:
            keys = np.array([xxhash.xxh64_intdigest(w, key) for w in words], np.uint64) if limit else np.zeros(len(words), np.uint64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (words, their symbols in turn, how many each)
        low = 0
        for high in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for chosen in np.array_split(rows, len(rows) // 20_000 + 1):
                if len(chosen):
                    parts.append((chosen, *self._lockstep(chosen, symbols, starts, lengths, keys, high, limit, seen)))
            low = high
        for i in np.flatnonzero(lengths > low):
            mine = symbols[starts[i] : starts[i] + lengths[i]]
            merged = self._agenda(mine.tolist(), int(keys[i]), limit)
            parts.append((np.array([i]), merged, np.array([len(merged)])))
        counts = np.zeros(len(words), np.int64)
        for chosen, _, n in parts:
            counts[chosen] = n
        ends = np.cumsum(counts)
        flat = np.empty(ends[-1] if len(ends) else 0, np.int64)
        for chosen, merged, n in parts:
            flat[np.repeat(ends[chosen] - np.cumsum(n), n) + np.arange(len(merged))] = merged
        return self._spelled(flat, counts)

    def _lockstep(self, chosen, symbols, starts, lengths, keys, width, limit, seen) -> tuple[np.ndarray, np.ndarray]:
        """Merge in all chosen words at a time, one merge a word and step."""
        size, key = lengths[chosen], keys[chosen]

        def offer(r, x, y, end) -> None:
            rank[r, x] = found = self._rank(sym[r, x], sym[r, y], key[r], x, y, end, limit)
            if seen is not None:
                some = found < NONE
                seen.append((chosen[r[some]], _place(x[some], y[some], end[some])))

        column = np.arange(width)
        at = np.minimum(starts[chosen][:, None] + column, len(symbols) - 1)
        live = column < size[:, None]
        sym = np.where(live, symbols[at], -1)
        after = np.broadcast_to(column + 1, sym.shape).copy()
        before = np.broadcast_to(column - 1, sym.shape).copy()
        rank = np.full(sym.shape, NONE)
        r, j = np.nonzero(column < (size - 1)[:, None])
        offer(r, j, j + 1, j + 2)
        rows = np.arange(len(chosen))
        while len(rows):
            best = rank[rows].argmin(axis=1)
            value = rank[rows, best]
            going = value < NONE
            rows, j, value = rows[going], best[going], value[going]
            if not len(rows):
                break
            k = after[rows, j]
            m = after[rows, k]
            sym[rows, j] = self.by_rank[value]
            sym[rows, k] = -1
            rank[rows, k] = NONE
            rank[rows, j] = NONE
            after[rows, j] = m
            some = m < size[rows]
            r, x, y = rows[some], j[some], m[some]
            before[r, y] = x
            offer(r, x, y, after[r, y])
            p = before[rows, j]
            some = p >= 0
            r, x, y = rows[some], p[some], j[some]
            offer(r, x, y, after[r, y])
        return sym[sym >= 0], (sym >= 0).sum(axis=1)

    def _agenda(self, sym: list[int], key: int, limit: int) -> np.ndarray:
        """The same, for one long word, with a heap of candidates."""
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(x: int, y: int) -> None:
            found = self.rank_of.get(sym[x] << 21 | sym[y])
            if found is None:
                return
            if limit:
                place = (x << 42) ^ (y << 21) ^ after[y]
                drawn = np.array([(key + place * int(_M1)) % 2**64], np.uint64)
                if int(_mix(drawn)[0]) >> 32 < limit:
                    return
            heapq.heappush(heap, (found, x, y, after[y]))

        for x in range(n - 1):
            offer(x, x + 1)
        while heap:
            found, x, y, end = heapq.heappop(heap)
            if sym[x] < 0 or sym[y] < 0 or after[x] != y or after[y] != end:
                continue  # one of the two has been merged meanwhile
            sym[x], sym[y] = int(self.by_rank[found]), -1
            after[x] = end
            if end < n:
                before[end] = x
                offer(x, end)
            if before[x] >= 0:
                offer(before[x], x)
        return np.array([s for s in sym if s >= 0], np.int64)

    def _spelled(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols; characters without a piece become their bytes."""
        odd = flat >= CHARACTER
        if odd.any():
            width = np.ones(len(flat), np.int64)
            spelled = [chr(c).encode() for c in (flat[odd] - CHARACTER).tolist()]
            width[odd] = [len(s) for s in spelled]
            owner = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)
            inside = np.repeat(odd, width)
            flat = np.repeat(flat, width)
            flat[inside] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return flat.astype(np.int32), counts

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded: pieces put together, without the space put before it."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode()


@functools.cache
def load_pieces(path: str) -> PieceModel:
    return PieceModel(path)


class Numbers(dict):
    """Numbers for words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all parts in turn that begin at ``starts`` and have ``sizes``."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Coder:
    """Encodes texts, remembering up to ``most`` words between batches.

    What is remembered of a word is its segmentation without dropout, and the places of the
    candidates on the way there: while none of them is skipped, the way is the same.
    """

    def __init__(self, model: PieceModel, rate: float, seed: int, variants: int, most: int = 400_000):
        self.model, self.rate, self.most = model, rate, most
        self.limit = int(rate * 2**32)
        self.keys = [xxhash.xxh64_intdigest(f"{seed}/{v}") for v in range(variants if rate else 1)]
        self.seed = seed
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.words: list[str] = []
        self.long = np.zeros(0, bool)
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.places, self.candidates = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.word_keys = np.zeros(0, np.uint64)

    def variant(self, doc) -> int:
        """Which of the keys a document gets."""
        return xxhash.xxh64_intdigest(str(doc), self.seed) % len(self.keys)

    def _learn(self) -> None:
        """Segment the words that are new, without dropout."""
        new = list(islice(self.known, len(self.sizes), None))
        if not new:
            return
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        flat, sizes = self.model.segment(new, 0, 0.0, seen=seen if self.limit else None)
        self.words += new
        self.long = np.concatenate([self.long, np.array([len(w) > WIDTHS[-1] for w in new], bool)])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        if self.limit:
            owner = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in seen)])
            places = np.concatenate([np.zeros(0, np.uint64), *(p for _, p in seen)])
            self.places = np.concatenate([self.places, places[np.argsort(owner, kind="stable")]])
            self.candidates = np.concatenate([self.candidates, np.bincount(owner, minlength=len(new))])
            hashed = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in new], np.uint64)
            self.word_keys = np.concatenate([self.word_keys, hashed])

    def _occurrence_keys(self, words: np.ndarray, docs: np.ndarray, doc_keys: np.ndarray) -> np.ndarray:
        """A key for each word of the documents: by document, word and how often it came before."""
        order = np.argsort(docs * len(self.words) + words, kind="stable")
        run = np.r_[True, (np.diff(words[order]) != 0) | (np.diff(docs[order]) != 0)]
        first = np.flatnonzero(run)
        before = np.empty(len(words), np.uint64)
        before[order] = np.arange(len(words)) - np.repeat(first, np.diff(np.r_[first, len(words)]))
        return _mix(doc_keys[docs] ^ _mix(self.word_keys[words] + before * _M1))

    def _cut(self, words: np.ndarray, keys: np.ndarray, at: np.ndarray, place_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and how many each has."""
        sizes, starts, flat = self.sizes[words], at[words], self.flat
        if self.limit:
            many = self.candidates[words]
            places = self.places[_spread(place_at[words], many)]
            skipped = _mix(np.repeat(keys, many) + places * _M1) >> np.uint64(32) < np.uint64(self.limit)
            skips = np.r_[0, np.cumsum(skipped)]
            ends = np.cumsum(many)
            anew = skips[ends] > skips[ends - many]
            anew |= self.long[words]
            again = np.flatnonzero(anew)
            if len(again):
                fresh, n = self.model.segment([self.words[w] for w in words[again].tolist()], 0, self.rate, keys[again])
                starts[again], sizes[again] = len(flat) + np.cumsum(n) - n, n
                flat = np.concatenate([flat, fresh])
        return flat[_spread(starts, sizes)], sizes

    def encode(self, docs: list, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self._forget()
        number = self.known.__getitem__
        rows = [np.array(list(map(number, SEGMENT.findall(" " + text))) if text else [], np.int64) for text in texts]
        self._learn()
        if not rows:
            return []
        words = np.concatenate(rows)
        lengths = np.array([len(r) for r in rows], np.int64)
        keys = np.zeros(len(words), np.uint64)
        if self.limit and len(words):
            doc_keys = np.array([xxhash.xxh64_intdigest(str(d), self.keys[self.variant(d)]) for d in docs], np.uint64)
            keys = self._occurrence_keys(words, np.repeat(np.arange(len(rows)), lengths), doc_keys)
        at, place_at = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.candidates) - self.candidates
        coded = [self._cut(words[i : i + PART], keys[i : i + PART], at, place_at) for i in range(0, len(words), PART)]
        flat = np.concatenate([np.zeros(0, np.int32), *(c for c, _ in coded)])
        ends = np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in coded)]))]
        last = np.cumsum(lengths)
        return [flat[ends[e - n] : ends[e]] for e, n in zip(last, lengths)]


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
    rate: float = 0.1, seed: int = 17, variants: int = 4,
) -> DataFrame:
    """The columns of ``docs`` with ``variant`` and ``ids`` (array of int).

    ``rate`` is the probability that a candidate merge is skipped; 0 gives the library's
    own segmentation.  A document's draws follow from ``seed``, one of ``variants`` keys
    picked by its id, the id itself and, for every word, which of its occurrences in the
    document it is: change the seed for another epoch.  The white square that stands
    for a space is spelled in bytes where it occurs in a text, so that decoding is exact.

    A null text has null ids, an empty one none.  Rows that share an id share the draws; a
    null id is an id like others.  Columns named like the new ones are replaced.
    """
    settle(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("variant", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(load_pieces(model_path), rate, seed, variants)
        for whole in batches:
            at = 0
            sizes = pc.fill_null(pc.binary_length(whole.column(2)), 0).to_numpy()
            while at < whole.num_rows:  # parts of bounded size: ids take more room than text
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), OUT_BYTES // 2)))
                batch = whole.slice(at, n)
                at += n
                keys, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                coded = coder.encode(keys, [t or "" for t in texts])
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
                values = np.concatenate(coded) if coded else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array([t is None for t in texts])
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([coder.variant(d) for d in keys], pa.int32()), lists],
                    ["row", "variant", "ids"],
                )

    rows = docs.select(packed(names), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([
        rows.schema["row"], T.StructField("variant", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    return rows.mapInArrow(run, schema).select(*unpacked(names), "variant", "ids")


def decode_pieces(coded: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The columns of ``coded`` with the text its ids stand for; null ids give null."""
    names = [c for c in coded.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(model_path)
        for batch in batches:
            lists = batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            texts = [
                model.decode(values[a:b].tolist()) if there else None
                for a, b, there in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lists.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    rows = coded.select(packed(names), F.col(f"`{ids_col}`").alias("ids"))
    schema = T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema).select(*unpacked(names), F.col("decoded").alias(into))
