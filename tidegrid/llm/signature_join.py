"""Similarity join of documents on word shingles, by signature trees.

Documents with equal shingle sets are one.  Two sets that are similar enough share a
shingle among the first few of each in any one order of all shingles, so documents meet
in blocks, one for each such shingle.  The order puts shingles last that are frequent in
a sample, which keeps blocks small; any order gives the same links.

A block too large for a task is cut into parts, and never compared as a whole: links
inside parts come first, then links between one set of each component of each part, and
last the sets outside the block's largest component meet all others.  So a group of near
copies of any size costs about as much as its sets, and no link is lost.

In a block the sets' bitmaps are the leaves of signature trees, one for each bitmap
width.  An inner node holds the bitwise OR of what is below it and the range of set
sizes.  Two trees are traversed together; a pair of nodes is dropped when not even the
largest possible overlap below it is enough.  Bitmaps alone tell which sets may be linked
in a block.  Sets that may be linked by any way are a pool; the few sets in pools are
fetched whole, once, and links are found in each pool by the same traversal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import components
from tidegrid.llm.shared import ascii_lower, fresh_name, partitions, settle, shared_folder, stage

FAN = 8
#: Parts whose components' representatives meet in one part of the next level.
JOINED = 64
FLUSH_POSTINGS = 1 << 19
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

# ------------------------------------------------------------------ shingles


class Shingler:
    """Distinct 64-bit hashes of all runs of ``width`` words of a text, in ascending order."""

    def __init__(self, width: int, most: int = 400_000):
        self.width, self.most = width, most
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.most:  # words are only remembered to save hashing
            self.known, self.hashes = {}, self.hashes[:0]
        known = self.known
        rows = [[known.setdefault(w, len(known)) for w in text.split()] for text in texts]
        fresh = list(known)[len(self.hashes) :] if len(known) > len(self.hashes) else []
        if fresh:
            new = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
            self.hashes = np.concatenate([self.hashes, new])
        return [self._shingles(self.hashes[np.array(row, np.int64)]) for row in rows]

    def _shingles(self, words: np.ndarray) -> np.ndarray:
        n = len(words) - self.width + 1
        if n < 1:  # fewer words are one shingle, no words none
            return np.array([xxhash.xxh3_64_intdigest(words.tobytes(), 1)], np.uint64) if len(words) else words
        x = words[:n] * _K[0]
        for i in range(1, self.width):
            x = (x ^ (x >> np.uint64(29))) * _K[i % len(_K)] + words[i : i + n]
        x = (x ^ (x >> np.uint64(32))) * _K[0]
        return np.unique(x ^ (x >> np.uint64(29)))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), 2))))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of a set, three to six for each element, in 64-bit words; a power of two of them."""
    words = 1
    while words * 64 < 3 * len(shingles):
        words *= 2
    # The bit within a word does not depend on the width, so that words can be folded.
    out = np.zeros(words, np.uint64)
    word = ((shingles >> np.uint64(11)) & np.uint64(words - 1)).astype(np.int64)
    np.bitwise_or.at(out, word, np.uint64(1) << ((shingles >> np.uint64(5)) & np.uint64(63)))
    return out


def fold(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width: what stands in either half."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


# ------------------------------------------------------------------ trees


class SignatureTree:
    """Levels of nodes over the sets of one width, the leaves first.

    ``slack``: the most elements of a set beyond its bits, which share a bit with another.
    """

    def __init__(self, members: np.ndarray, bits: np.ndarray, sizes: np.ndarray):
        # Neighbours have similar sizes and, by the first bits, similar sets.
        order = np.lexsort((bits[:, 0], sizes))
        self.members, self.bits, self.sizes = members[order], bits[order], sizes[order]
        slack = self.sizes - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.slack = slack
        self.levels = []
        ors, low, high = self.bits, self.sizes, self.sizes
        while True:
            cut = np.arange(0, len(ors), FAN)
            ors = np.bitwise_or.reduceat(ors, cut, axis=0)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            slack = np.maximum.reduceat(slack, cut)
            self.levels.append((ors, low, high, slack))
            if len(ors) == 1:
                return

    def __len__(self) -> int:
        return len(self.members)


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap that links sets of sizes ``a`` and ``b``."""
    return -(-num * (a + b) // (den + num))


def dual(a: SignatureTree, b: SignatureTree, num: int, den: int, skip: Callable, visit: Callable) -> None:
    """Traverse two trees together (a tree with itself: each pair once).

    ``skip(members of a, members of b)`` says for whole leaf pairs, as arrays (pairs, FAN)
    of places with -1 for none, which need no look.  ``visit(places in a, places in b)``
    gets the pairs of sets whose bitmaps leave room for a link.
    """
    same = a is b
    depth = max(len(a.levels), len(b.levels)) - 1
    left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        la, lb = min(depth, len(a.levels) - 1), min(depth, len(b.levels) - 1)
        keep = _possible(a.levels[la], b.levels[lb], left, right, num, den)
        left, right = left[keep], right[keep]
        if not len(left):
            return
        if depth == 0:
            break
        left, right = _expand(left, right, *(
            len(t.levels[depth - 1][0]) if depth < len(t.levels) else 0 for t in (a, b)
        ))
        if same:
            once = left <= right
            left, right = left[once], right[once]
        depth -= 1
    # Leaves next to each other first: what they settle saves looks at others.
    order = np.argsort(np.abs(left - right) if same else left, kind="stable")
    left, right = left[order], right[order]
    few = max(1, (1 << 19) // (a.bits.shape[1] * FAN * FAN))  # pairs whose bitmaps are laid out at a time
    inner = np.arange(FAN)
    for at in range(0, len(left), 1 << 12):
        x = left[at : at + (1 << 12), None] * FAN + inner
        y = right[at : at + (1 << 12), None] * FAN + inner
        x, y = np.where(x < len(a), x, -1), np.where(y < len(b), y, -1)
        while len(x):
            unsettled = ~skip(x, y)
            x, y = x[unsettled], y[unsettled]
            _look(a, b, x[:few], y[:few], num, den, visit)
            x, y = x[few:], y[few:]


def _look(a: SignatureTree, b: SignatureTree, x, y, num: int, den: int, visit: Callable) -> None:
    """Visit the pairs of sets of these leaf pairs that their bitmaps leave room for."""
    i, j = np.repeat(x, FAN, axis=1).ravel(), np.tile(y, FAN).ravel()
    fine = (i >= 0) & (j >= 0)
    if a is b:
        fine &= i < j
    i, j = i[fine], j[fine]
    least = needed(a.sizes[i], b.sizes[j], num, den)
    near = np.minimum(a.sizes[i], b.sizes[j]) >= least
    i, j, least = i[near], j[near], least[near]
    p, q = a.bits[i], b.bits[j]
    most = np.minimum(
        a.sizes[i] - np.bitwise_count(p & ~q).sum(axis=1).astype(np.int64),
        b.sizes[j] - np.bitwise_count(q & ~p).sum(axis=1).astype(np.int64),
    )
    room = most >= least
    if room.any():
        visit(i[room], j[room])


def _possible(x, y, left, right, num: int, den: int) -> np.ndarray:
    """Node pairs that may hold a link, by size ranges and by the bits they share."""
    out = np.zeros(len(left), bool)
    width = x[0].shape[1]
    step = max(1, (1 << 20) // width)
    for at in range(0, len(left), step):
        i, j = left[at : at + step], right[at : at + step]
        shared = np.bitwise_count(x[0][i] & y[0][j]).sum(axis=1).astype(np.int64)
        most = np.minimum(shared + np.minimum(x[3][i], y[3][j]), np.minimum(x[2][i], y[2][j]))
        sized = (x[2][i] * den >= num * y[1][j]) & (y[2][j] * den >= num * x[1][i])
        out[at : at + step] = sized & (most >= needed(x[1][i], y[1][j], num, den))
    return out


def _expand(left, right, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of node pairs; a tree that has no level below (0) keeps its node."""
    fans = [np.arange(FAN) if n else np.zeros(1, np.int64) for n in (na, nb)]
    x = left[:, None] * (FAN if na else 1) + fans[0]
    y = right[:, None] * (FAN if nb else 1) + fans[1]
    i = np.repeat(x, len(fans[1]), axis=1).ravel()
    j = np.tile(y, len(fans[0])).ravel()
    fine = (i < (na or len(left) + i.max() + 1)) & (j < (nb or len(left) + j.max() + 1))
    return i[fine], j[fine]


def trees(bits: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[SignatureTree, SignatureTree]]:
    """Pairs of trees that between them hold every pair of sets near enough in size.

    Sets of one width are a tree; a tree of a larger width within reach is folded down.
    """
    widths = np.array([len(b) for b in bits])
    kinds = np.unique(widths)
    groups = {}
    for w in kinds:
        at = np.flatnonzero(widths == w)
        groups[int(w)] = (at, np.stack([bits[i] for i in at]), sizes[at])
    for w in groups:
        own = SignatureTree(*groups[w])
        yield own, own
        for v in groups:
            if v <= w or groups[w][2].max() * den < num * groups[v][2].min():
                continue
            at, wide, n = groups[v]
            some = n * num <= groups[w][2].max() * den
            at, wide, n = at[some], wide[some], n[some]
            while wide.shape[1] > w:
                wide = fold(wide)
            yield own, SignatureTree(at, wide, n)


def spanning_pairs(
    bits: list[np.ndarray], sizes: np.ndarray, num: int, den: int, linked: Callable[[int, int], bool] | None = None
) -> list[tuple[int, int]]:
    """Pairs that hold together the components of the graph of linked pairs.

    ``linked`` tells of a pair that its bitmaps do not rule out whether it is one; without
    it all such pairs are.  Pairs inside a component are not looked at again.
    """
    label = np.arange(len(bits) + 1)  # the last for no set
    pairs: list[tuple[int, int]] = []
    for a, b in trees(bits, sizes, num, den):

        def skip(x, y, a=a, b=b):
            both = np.concatenate(
                [np.where(x < 0, -1, label[a.members[x]]), np.where(y < 0, -1, label[b.members[y]])], axis=1
            )
            return ((both == both.max(axis=1)[:, None]) | (both < 0)).all(axis=1)

        def visit(i, j, a=a, b=b):
            i, j = a.members[i], b.members[j]
            apart = label[i] != label[j]
            for p, q in zip(i[apart].tolist(), j[apart].tolist()):
                if label[p] != label[q] and (linked is None or linked(p, q)):
                    pairs.append((p, q))
                    label[label == label[q]] = label[p]

        dual(a, b, num, den, skip, visit)
    return pairs


def linked_pairs(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that hold the components of these sets together, found by counting whole sets."""
    sizes = np.array([len(s) for s in sets], np.int64)

    def linked(p: int, q: int) -> bool:
        shared = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        return shared * den >= num * (sizes[p] + sizes[q] - shared)

    return spanning_pairs([bitmap(s) for s in sets], sizes, num, den, linked)


# ------------------------------------------------------------------ on Spark

ROWS = pa.schema([
    ("kind", pa.string()), ("doc", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()),
    ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()),
])
ROWS_DDL = "kind string, doc long, hash long, n long, sid long, a binary, b binary, c binary"


def size_class(n: int, num: int, den: int) -> int:
    """Sets that are linked are of the same class or of neighbouring ones."""
    return int(np.log(n) / np.log(max(den / num, 1.1)) + 1e-9)


def _sketch(width: int, num: int, den: int, buckets: int, known):
    """(doc, hash, text) to ``doc`` rows, ``sig`` rows (bitmap a) and ``post`` rows by bucket (n).

    Postings are shingles' low halves (a), sets (b) and their size classes (c); a set sends
    them once a task, or once in a million sets.
    Shingles that the sample says are in very many documents (``parts`` over 1) go out as
    ``hot`` rows instead: whole shingles (a), sets (b), so that no task gathers their blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, times, parts = known.value
        hot_shingles = frequent[parts > 1]
        shingler = Shingler(width)
        sent: set[int] = set()
        code, owner, gathered = [], [], 0

        def postings() -> list[tuple]:
            names, classes, counts = map(np.array, zip(*owner))
            c, o, k = np.concatenate(code), np.repeat(names, counts), np.repeat(classes.astype(np.uint8), counts)
            out = []
            if len(hot_shingles):
                place = np.minimum(np.searchsorted(hot_shingles, c), len(hot_shingles) - 1)
                hot = hot_shingles[place] == c
                if hot.any():
                    out.append(("hot", None, None, int(hot.sum()), None, c[hot].tobytes(), o[hot].tobytes(), None))
                    c, o, k = c[~hot], o[~hot], k[~hot]
            bucket = (c >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            low = c.astype(np.uint32)
            return out + [
                ("post", None, None, b, None, low[at].tobytes(), o[at].tobytes(), k[at].tobytes())
                for b in range(buckets) if len(at := order[ends[b] : ends[b + 1]])
            ]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS)

        for batch in batches:
            out = []
            sets = shingler(batch.column(2).to_pylist())
            for doc, text_hash, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets):
                if not len(x):
                    out.append(("doc", doc, text_hash, 0, None, None, None, None))
                    continue
                name = set_id(x)
                out.append(("doc", doc, text_hash, len(x), name, None, None, None))
                if name in sent:
                    continue
                sent.add(name)
                out.append(("sig", None, None, len(x), name, bitmap(x).tobytes(), None, None))
                size = size_class(len(x), num, den)
                prefix = len(x) - -(-num * len(x) // den) + 1
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    often = frequent[place] == x
                    if often.any():
                        late = x[often]
                        x = np.concatenate([x[~often], late[np.argsort(times[place[often]], kind="stable")]])
                code.append(x[:prefix])
                owner.append((np.int64(name), size, prefix))
                gathered += prefix
            if out:
                yield batch_of(out)
            if gathered > FLUSH_POSTINGS:
                yield batch_of(postings())
                code, owner, gathered = [], [], 0
                if len(sent) > 1 << 20:
                    sent = set()
        if gathered:
            yield batch_of(postings())

    return run


BLOCK = pa.schema([("b1", pa.int64()), ("b2", pa.int64()), ("large", pa.bool_()), ("members", pa.list_(pa.int64()))])
BLOCK_DDL = "b1 long, b2 long, large boolean, members array<long>"


def _named(members: np.ndarray) -> tuple[int, int]:
    """A name for the block of these members."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(members.tobytes()), np.int64).tolist())


def _block_rows(name: int, members: np.ndarray, part: int, seen: set) -> Iterator[tuple]:
    """A block unless the task has had the same, or the parts of a large one under ``name``."""
    if len(members) > part:
        for k, at in enumerate(range(0, len(members), part)):
            yield (name, k, True, members[at : at + part])
        return
    own = _named(members)
    if own not in seen:
        seen.add(own)
        yield (*own, False, members)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[-1])
        if size > most or len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _blocks(part: int):
    """Postings of whole buckets to blocks: sets of like sizes that share a shingle, two or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        code, owner, size = [], [], []
        for batch in batches:
            for bucket, a, b, k in zip(*(batch.column(x).to_pylist() for x in ("n", "a", "b", "c"))):
                code.append(np.frombuffer(a, np.uint32) | np.uint64(bucket << 32))
                owner.append(np.frombuffer(b, np.int64))
                size.append(np.frombuffer(k, np.uint8))
        if not code:
            return
        c, o, k = np.concatenate(code), np.concatenate(owner), np.concatenate(size).astype(np.int64)
        order = np.lexsort((o, k, c))
        c, o, k = c[order], o[order], k[order]
        first = np.r_[True, (c[1:] != c[:-1]) | (o[1:] != o[:-1])]  # a set once in a block
        c, o, k = c[first], o[first], k[first]
        # A block ends where sizes leap: nothing on one side is linked with the other.
        starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (k[1:] - k[:-1] > 1)])
        ends = np.r_[starts[1:], len(c)]
        several = ends - starts > 1
        seen: set = set()
        for s, e in zip(starts[several], ends[several]):
            name = int((c[s] * _K[0] + np.uint64(k[s])).astype(np.int64))
            yield from _block_rows(name, o[s:e], part, seen)

    return lambda batches: _batched(rows(batches), BLOCK)


def _hot_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (a, b)], ["b1", "sid"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Rows (b1, b2, sid, payload…) in order of b1, b2 to one (sids, payloads) for each block."""
    name, sids, rest = None, [], []
    for batch in batches:
        for b1, b2, sid, *payload in zip(*(c.to_pylist() for c in batch.columns)):
            if (b1, b2) != name:
                if len(sids) > 1:
                    yield sids, rest
                name, sids, rest = (b1, b2), [], []
            sids.append(sid)
            rest.append(payload)
    if len(sids) > 1:
        yield sids, rest


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(find: Callable[[list], list[tuple[int, int]]]):
    """Blocks, row after row, to the pairs of sets that ``find`` picks from each block's payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for sids, rest in _groups(batches):
            out += [(sids[i], sids[j]) for i, j in find(rest)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=LINK)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=LINK)

    return run


def _sets(width: int):
    """(text) to (sid, whole set), each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(width), set()
        for batch in batches:
            out = []
            for x in shingler(batch.column(0).to_pylist()):
                if len(x) and (name := set_id(x)) not in seen:
                    seen.add(name)
                    out.append((name, x.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], ["sid", "shingles"])

    return run


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for x in shingler(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64))], ["shingle"])

    return run


class _Linker:
    """Finds pairs in blocks given as members (b1, b2, sid): possible ones by bitmaps, links by whole sets."""

    def __init__(self, texts: DataFrame, of_docs: DataFrame, bitmaps: DataFrame, width: int, num: int, den: int):
        self.texts, self.of_docs, self.bitmaps = texts, of_docs, bitmaps
        self.width, self.num, self.den = width, num, den

    def possible(self, members: DataFrame) -> DataFrame:
        num, den = self.num, self.den

        def find(rest: list) -> list[tuple[int, int]]:
            sizes = np.array([n for n, _ in rest], np.int64)
            return spanning_pairs([np.frombuffer(raw, np.uint64) for _, raw in rest], sizes, num, den)

        return self._found(members, self.bitmaps, ["n", "a"], find)

    def links(self, members: DataFrame) -> DataFrame:
        num, den = self.num, self.den

        def find(rest: list) -> list[tuple[int, int]]:
            return linked_pairs([np.frombuffer(raw, np.uint64) for (raw,) in rest], num, den)

        return self._found(members, self._whole_sets(members.select("sid").distinct()), ["shingles"], find)

    def _found(self, members: DataFrame, of_sets: DataFrame, payload: list[str], find: Callable) -> DataFrame:
        """Each block's rows meet one after the other in a task."""
        together = (
            members.join(of_sets, "sid").repartition("b1", "b2").sortWithinPartitions("b1", "b2", "sid")
            .select("b1", "b2", "sid", *payload)
        )
        return stage(together.mapInArrow(_pairs(find), "a long, b long").distinct())

    def _whole_sets(self, wanted: DataFrame) -> DataFrame:
        """Sets from the texts, which are read again: few are left by now."""
        holders = stage(
            self.of_docs.join(wanted, "sid").groupBy("sid").agg(F.min("doc").alias("_doc")).select("_doc").distinct()
        )
        again = self.texts.join(holders, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
        return again.select("text").mapInArrow(_sets(self.width), "sid long, shingles binary").dropDuplicates(["sid"])


def _in_parts(large: DataFrame, find: Callable[[DataFrame], DataFrame], pairs: DataFrame, part: int) -> DataFrame:
    """Pairs that ``find`` finds in blocks cut into parts (b1 block, b2 part, sid), added to ``pairs``.

    Parts first.  Then a set of each component of each part, parts by the dozen, up to
    the whole block: by then near copies are one component wherever they lie.  What
    stands outside a block's largest component meets every set of the block at last.
    """
    def labelled(rows: DataFrame) -> DataFrame:
        known = components(pairs).withColumnRenamed("node", "sid")
        return rows.join(known, "sid", "left").withColumn("component", F.coalesce("component", "sid"))

    level = large
    while True:
        pairs = stage(pairs.unionByName(find(level.select("b1", "b2", "sid"))))
        if not level.agg(F.max("b2")).first()[0]:
            break
        one = labelled(level).groupBy("b1", "b2", "component").agg(F.min("sid").alias("sid"))
        level = stage(one.select("b1", F.floor(F.col("b2") / JOINED).alias("b2"), "sid").distinct())
        # Where sets are not alike, one of each component may be many: these are dealt again.
        many = level.groupBy("b1", "b2").agg(F.ceil(F.count(F.lit(1)) / part).alias("cut")).where("cut > 1")
        dealt = level.join(many, ["b1", "b2"], "left")
        salt = F.coalesce(F.pmod(F.xxhash64("sid", F.lit(5)), F.col("cut")), F.lit(0))
        level = dealt.select(F.when(salt > 0, F.xxhash64("b1", salt)).otherwise(F.col("b1")).alias("b1"), "b2", "sid")
    members = stage(labelled(large))
    sizes = members.groupBy("b1", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("b1").agg(
        F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), F.max("n").alias("main")
    )
    open_blocks = largest.where(F.col("main") < F.col("all")).select(
        "b1", "most", F.ceil(F.col("all") / part).alias("parts"),
        F.ceil((F.col("all") - F.col("main")) / part).alias("others"),
    )
    rows = members.join(open_blocks, "b1")
    place = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(n))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = rows.select("b1", "sid", place("parts", 1).alias("p"), up_to("others").alias("o"))
    beside = rows.where(F.col("component") != F.col("most")).select(
        "b1", "sid", up_to("parts").alias("p"), place("others", 2).alias("o")
    )
    met = every.unionByName(beside).distinct()
    outside = met.select(F.xxhash64("b1", "p", "o").alias("b1"), F.xxhash64("p", "o", "b1").alias("b2"), "sid")
    return pairs.unionByName(find(outside))


def shingle_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
    num: int = 75, den: int = 100, sample_share: float = 1 / 16, ordered: int = 1 << 20, part: int = 2048,
) -> DataFrame:
    """Documents linked by Jaccard similarity of at least ``num / den`` on word shingles.

    Words are what lies between ASCII white space, A-Z lower-cased; a set holds the distinct
    runs of ``width`` words.  One row per document: the id column, ``n_shingles``,
    ``component_id`` (the smallest id reachable by links, itself included), ``text_hash``
    (xxhash64 of the text, to find the row again where ids repeat), ``group_id`` (a number
    that the documents of a component share, whatever their ids; null for empty sets).

    Fewer words than ``width`` are one shingle.  A text that is null or without words has
    an empty set and is linked with nothing.  A null id names no component; a component of
    null ids alone has a null name.  Rows that share an id are documents of their own.
    ``sample_share`` and ``ordered`` only say which shingles are known as frequent, and so
    put last, and ``part`` how many sets meet in one task; every set and every block is
    gone through, and the result is the same for all.  An empty table gives an empty result.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be over 0 and at most 1")
    spark = settle(docs.sparkSession)
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"),
        ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary").alias("text"),
    )
    drawn = F.pmod(F.xxhash64("doc", F.lit(6)), F.lit(1 << 30)) < int(sample_share * (1 << 30))
    often = (
        texts.where(drawn).select("text").mapInArrow(_sampled(width), "shingle long")
        .groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
        .orderBy(F.desc("n"), "shingle").limit(ordered).toArrow()
    )
    frequent, times = (often.column(c).combine_chunks().to_numpy() for c in ("shingle", "n"))
    order = np.argsort(frequent.view(np.uint64))
    frequent, times = frequent.view(np.uint64)[order], times[order]
    expected = times / max(sample_share, 1e-9)  # documents, by the sample
    parts = np.where(expected > 4 * part, np.ceil(expected / part), 1).astype(np.int64)
    known = spark.sparkContext.broadcast((frequent, times, parts))  # of at most ``ordered`` shingles

    buckets = 4 * partitions(spark)
    path = shared_folder(spark, fresh_name("shingles"))
    (
        texts.mapInArrow(_sketch(width, num, den, buckets, known), ROWS_DDL)
        .write.partitionBy("kind").parquet(path)
    )
    rows = spark.read.schema(ROWS_DDL).parquet(path)
    of_docs = rows.where("kind = 'doc'").select("doc", "hash", "n", "sid")
    bitmaps = rows.where("kind = 'sig'").select("sid", "n", "a").dropDuplicates(["sid"])
    linker = _Linker(texts, of_docs, bitmaps, width, num, den)
    blocks = stage(
        rows.where("kind = 'post'").select("n", "a", "b", "c").repartition(partitions(spark), "n")
        .mapInArrow(_blocks(part), BLOCK_DDL).dropDuplicates(["b1", "b2"])
    )
    possible = linker.possible(blocks.where("NOT large").select("b1", "b2", F.explode("members").alias("sid")))
    large = blocks.where("large").select("b1", "b2", F.explode("members").alias("sid"))
    if (parts > 1).any():
        hot = rows.where("kind = 'hot'").select("a", "b").mapInArrow(_hot_postings, "b1 long, sid long").distinct()
        of_hot = spark.createDataFrame(
            [(int(h), int(p)) for h, p in zip(frequent[parts > 1].view(np.int64), parts[parts > 1])], "h long, parts long"
        )
        dealt = hot.join(of_hot, F.col("b1") == F.col("h")).select(
            "b1", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("parts")).alias("b2"), "sid"
        )
        large = large.unionByName(dealt)
    large = stage(large)
    if not large.isEmpty():
        possible = _in_parts(large, linker.possible, possible, part)
    pools = stage(components(possible).select(F.col("component").alias("b1"), F.col("node").alias("sid")))
    counts = pools.groupBy("b1").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    dealt = stage(pools.join(counts, "b1").select(
        "b1", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("parts")).alias("b2"), "sid", (F.col("parts") > 1).alias("large")
    ))
    links = linker.links(dealt.where("NOT large").drop("large"))
    large = dealt.where("large").drop("large")
    if not large.isEmpty():
        links = _in_parts(large, linker.links, links, part)
    groups = components(links)
    named = (
        of_docs.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc").alias("least"))
        .join(groups, F.col("sid") == F.col("node"), "left")
        .select("sid", "least", F.coalesce("component", "sid").alias("component"))
    )
    names = stage(named)
    name_of = names.groupBy("component").agg(F.min("least").alias("name"))
    of_sid = names.join(name_of, "component").select(F.col("sid").alias("_sid"), "component", "name")
    return of_docs.join(of_sid, F.col("sid") == F.col("_sid"), "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc")).otherwise(F.col("name")).alias("component_id"),
        F.col("hash").alias("text_hash"), F.col("component").alias("group_id"),
    )
