"""A gated recurrent language model with a class-factored softmax, scoring whole documents.

A word's probability is that of its class, given everything before it in the document,
times that of the word in its class: P(class | state) * (c + 1) / (N_class + V_class + 1),
c being the word's count in the training documents and one word of every class unknown.
The recurrent part reads classes and is trained by truncated backpropagation in numpy;
counts are taken over all training documents.

Words are known by 64-bit hashes.  Frequent words, found by a count of all training
documents, are counted in each task; all other words go with their counts in the documents to a partition of
their hash, where the corpus count is summed and sent back as a sum of logarithms for
each document.  Classes follow from a word's form, so that unknown words have one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import ascii_lower, fresh_name, partitions, settle, shared_folder, stage

#: The end of a text, a token like others; no word can contain white space.
END = b"\n"
CLASSES = 64
#: Classes of the most frequent words' own; the first is the end's.
OWN = 32
#: Tokens a task gathers before it writes them out.
FLUSH_TOKENS = 1 << 21
#: Bytes of words a task gathers at most before it writes them out.
FLUSH_BYTES = 1 << 25
#: Words a task counts before it sends the counts on.
COUNT_TOKENS = 1 << 22
#: Longer words are hashed one by one.
LONG_WORD = 48
#: Sequences side by side where tasks train.
TASK_LANES = 256


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column, where its words start in them, and their lengths."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8), ends[:-1], np.diff(ends)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, a byte of all words at a time."""
    if not len(words):
        return np.zeros(0, np.uint64)
    data, starts, lengths = _bytes_of(words)
    code = np.full(len(words), 0xCBF29CE484222325, np.uint64)
    for k in range(min(int(lengths.max()), LONG_WORD)):
        on = np.flatnonzero(lengths > k)
        code[on] = (code[on] ^ data[starts[on] + k]) * np.uint64(0x100000001B3)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    for i in np.flatnonzero(lengths > LONG_WORD):
        code[i] = xxhash.xxh3_64_intdigest(words[i].as_py())
    return code


def form_class(word: bytes) -> int:
    """Class of a word without one of its own, by its ending."""
    return OWN + xxhash.xxh32_intdigest(word[-3:]) % (CLASSES - OWN)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of a binary column of texts, one after the other, and where each text's words end."""
    parts = pc.ascii_split_whitespace(texts.view(pa.string()))
    words, ends = parts.flatten(), np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    there = pc.not_equal(pc.binary_length(words), 0)  # white space at an end leaves an empty part
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return words.filter(there).view(pa.binary()), before[ends]


@dataclass
class Vocabulary:
    """The frequent words, most frequent first, and classes of all words."""

    frequent: list[bytes]
    number: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        self.number = {w: i for i, w in enumerate(self.frequent)}

    def word_class(self, word: bytes) -> int:
        i = self.number.get(word, OWN)
        return i if i < OWN else form_class(word)

    def described(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, classes and numbers (-1 if not frequent) of a binary column of different words."""
        number = pc.fill_null(pc.index_in(words, value_set=pa.array(self.frequent, words.type)), -1).to_numpy(zero_copy_only=False)
        if not len(words):
            return word_hashes(words), np.zeros(0, np.uint8), number
        data, starts, lengths = _bytes_of(words)
        ending = np.minimum(lengths, 3) << 24
        for k in range(3):
            on = np.flatnonzero(lengths > k)
            ending[on] |= data[starts[on] + lengths[on] - 1 - k].astype(np.int64) << (8 * k)
        _, example, which = np.unique(ending, return_index=True, return_inverse=True)
        form = np.array([form_class(words[i].as_py()) for i in example.tolist()], np.uint8)[which]
        return word_hashes(words), np.where((number >= 0) & (number < OWN), number, form).astype(np.uint8), number.astype(np.int32)

    @staticmethod
    def of(texts: list[bytes], most: int) -> Vocabulary:
        seen: Counter[bytes] = Counter()
        for text in texts:
            seen.update(text.split())
        ranked = sorted((w for w, n in seen.items() if n > 1), key=lambda w: (-seen[w], w))
        return Vocabulary([END, *ranked[: most - 1]])

    @staticmethod
    def of_all(texts: DataFrame, most: int) -> Vocabulary:
        """The most frequent words of all texts (one binary column), counted in tasks and then by word.

        A histogram of the counts, at most a few thousand rows, tells the count from which on
        there are fewer than ``most`` words; only these come to the driver.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Array] = []
            for batch in batches:
                held.append(split_words(batch.column(0))[0])
                if sum(map(len, held)) > COUNT_TOKENS or sum(h.nbytes for h in held) > 2 * FLUSH_BYTES:
                    yield counted(held)
                    held = []
            if held:
                yield counted(held)

        def counted(held: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(pc.value_counts(pa.concat_arrays(held)).flatten(), ["word", "n"])

        words = stage(
            texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where("n > 1").withColumn("level", F.floor(64 * F.log2("n")).cast("int"))
        )
        held, level = 0, 1 << 30
        for r in sorted(words.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
            held += r["words"]
            if held >= most:
                break
            level = r["level"]
        found = words.where(F.col("level") >= level).select("word", "n").collect()
        ranked = sorted((-r["n"], bytes(r["word"])) for r in found)
        return Vocabulary([END, *(word for _, word in ranked)])


# ------------------------------------------------------------------ the network


class GatedNetwork:
    """One gated recurrent layer over classes; the input that starts a text is class ``CLASSES``."""

    def __init__(self, hidden: int = 24, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {
            "x": draw.normal(0, 0.1, (CLASSES + 1, 3 * hidden)).astype(np.float32),
            "u": (draw.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
            "o": draw.normal(0, 0.1, (hidden, CLASSES)).astype(np.float32),
            "b": np.zeros(CLASSES, np.float32),
        }
        self.rooms: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "rooms": {}}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array of this shape, zeros at first, that windows use again: fresh memory costs more than the sums."""
        room = self.rooms.get(name)
        if room is None or room.shape != shape or room.dtype != self.weights["u"].dtype:
            room = self.rooms[name] = np.zeros(shape, self.weights["u"].dtype)
        return room

    def states(self, inputs: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the window's steps, (steps, hidden, lanes), from (lanes, hidden).

        Lanes come last, so that gates are whole rows.  The next call writes over the result and ``keep``.
        """
        x, u, n = np.ascontiguousarray(self.weights["x"].T), np.ascontiguousarray(self.weights["u"].T), self.hidden
        steps, lanes = inputs.shape
        out = self._room("states", steps, n, lanes)
        kept = self._room("kept", steps if keep is not None else 1, 4 * n, lanes)
        state = np.ascontiguousarray(state.T)
        for t in range(steps):
            now = kept[t if keep is not None else 0]
            gates, new, pull = now[: 2 * n], now[2 * n : 3 * n], now[3 * n :]
            given, pulled = x.take(inputs[t], axis=1), u @ state
            np.add(given[: 2 * n], pulled[: 2 * n], out=gates)
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:n], gates[n:]
            pull[:] = pulled[2 * n :]
            np.multiply(r, pull, out=new)
            new += given[2 * n :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((state, z, r, new, pull))
            after = np.subtract(state, new, out=out[t])
            after *= z
            after += new
            state = after
        return out

    def classes(self, states: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities after each state (a column), and natural logarithms of the targets'."""
        out, bias = self.weights["o"], self.weights["b"]
        share = np.matmul(out.T, states, out=self._room("share", CLASSES, len(targets)))
        share += bias[:, None]
        # States lie between -1 and 1; only large weights can make exponentials overflow.
        if float((np.abs(out).sum(axis=0) + np.abs(bias)).max()) > 60:
            share -= share.max(axis=0)
        logs = share[targets, np.arange(len(targets))]
        np.exp(share, out=share)
        total = share.sum(axis=0)
        logs -= np.log(total)
        share /= total
        return share, logs

    def target_logs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' class probabilities, (steps, lanes)."""
        return np.stack([self.classes(h, y)[1] for h, y in zip(states, targets)])

    def slopes(self, inputs, targets, mask, state) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean loss over a window, the last state, and the loss."""
        keep: list = []
        states = self.states(inputs, state, keep)
        n, u, o = self.hidden, self.weights["u"], self.weights["o"]
        steps, lanes = inputs.shape
        count, loss = max(float(mask.sum()), 1.0), 0.0
        out = {"o": np.zeros_like(o), "b": np.zeros_like(self.weights["b"]), "u": np.zeros_like(u)}
        behind = np.zeros((n, lanes), u.dtype)
        inner, through = self._room("inner", 3 * n, steps, lanes), self._room("through", 3 * n, lanes)
        for t in range(steps - 1, -1, -1):
            error, logs = self.classes(states[t], targets[t])
            loss -= float((logs * mask[t]).sum()) / count
            error[targets[t], np.arange(lanes)] -= 1
            error *= (mask[t] / count).astype(error.dtype)
            out["o"] += states[t] @ error.T
            out["b"] += error.sum(axis=1)
            before, z, r, new, pull = keep[t]
            d = o @ error + behind
            d_new = d * (1 - z) * (1 - new * new)
            through[:n] = d * (before - new) * z * (1 - z)
            through[n : 2 * n] = d_new * pull * r * (1 - r)
            through[2 * n :] = d_new
            inner[:, t] = through
            through[2 * n :] *= r
            out["u"] += before @ through.T
            behind = d * z + u @ through
        hot, places = self._room("hot", steps * lanes, CLASSES + 1), (np.arange(steps * lanes), inputs.reshape(-1))
        hot[places] = 1
        out["x"] = (inner.reshape(3 * n, -1) @ hot).T
        hot[places] = 0
        return out, states[-1].T, loss


class Lanes:
    """Class sequences side by side, cut into windows; a state goes on until its sequence ends."""

    def __init__(self, sequences: list[np.ndarray], lanes: int, window: int):
        self.most, self.window = lanes, window
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.targets = np.concatenate([np.zeros(0, np.uint8), *sequences]).astype(np.uint8)
        self.inputs = np.roll(self.targets, 1)
        self.inputs[self.starts] = CLASSES
        # The longest first, so that none is left running alone for long.
        self.waiting = np.argsort(self.lengths, kind="stable").tolist()

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(sequence of each lane, inputs, targets, mask, whether each lane goes on after the window).

        Lanes that go on come first in the next window, in the order they had.
        """
        ids = at = np.zeros(0, np.int64)
        while len(ids) or self.waiting:
            fresh = [self.waiting.pop() for _ in range(min(self.most - len(ids), len(self.waiting)))]
            ids = np.concatenate([ids, np.array(fresh, np.int64)])
            at = np.concatenate([at, np.zeros(len(fresh), np.int64)])
            left = self.lengths[ids] - at
            step = np.arange(min(self.window, int(left.max())))[:, None]
            there = step < left
            place = np.where(there, self.starts[ids] + at + step, 0)
            inputs, targets = np.where(there, self.inputs[place], CLASSES), np.where(there, self.targets[place], 0)
            going = left > len(step)
            yield ids, inputs, targets, there.astype(np.float32), going
            ids, at = ids[going], at[going] + len(step)


def train_network(
    sequences: list[np.ndarray], hidden: int, epochs: int, lanes: int = 32, window: int = 32, rate: float = 0.01,
    net: GatedNetwork | None = None,
) -> GatedNetwork:
    """Truncated backpropagation with Adam; states, not slopes, go from window to window.

    Goes on from ``net`` if there is one.
    """
    if net is None:
        net = GatedNetwork(hidden)
        counts = np.bincount(np.concatenate(sequences), minlength=CLASSES) + 1.0
        net.weights["b"][:] = np.log(counts / counts.sum())
    total = epochs * max(1, sum(map(len, sequences)) // (lanes * window))
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for epoch in range(epochs):
        draw = np.random.default_rng(epoch)
        mixed = [sequences[i] for i in draw.permutation(len(sequences))]
        state = np.zeros((0, hidden), np.float32)
        source = Lanes(mixed, lanes, window)
        draw.shuffle(source.waiting)
        for ids, inputs, targets, mask, going in source.windows():
            start = np.zeros((len(ids), hidden), np.float32)
            start[: len(state)] = state
            slopes, last, _ = net.slopes(inputs, targets, mask, start)
            state = last[going]
            step += 1
            pace = rate * max(0.05, 1 - step / total)
            size = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
            for k, g in slopes.items():
                g *= min(1.0, 1.0 / max(size, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.weights[k] -= (
                    pace * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                ).astype(np.float32)
    return net


def class_log10(net: GatedNetwork, sequences: list[np.ndarray], lanes: int = 512, window: int = 32) -> np.ndarray:
    """log10 probability of each whole sequence of classes."""
    out = np.zeros(len(sequences))
    state = np.zeros((0, net.hidden), np.float32)
    for ids, inputs, targets, mask, going in Lanes(sequences, lanes, window).windows():
        start = np.zeros((len(ids), net.hidden), np.float32)
        start[: len(state)] = state
        states = net.states(inputs, start)
        out[ids] += (net.target_logs(states, targets) * mask).sum(axis=0, dtype=np.float64)
        state = states[-1].T[going]
    return out / np.log(10)


# ------------------------------------------------------------ counting on Spark

PARTS = pa.schema([
    ("kind", pa.string()), ("row", pa.int64()), ("doc", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()),
    ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()),
])
PARTS_DDL = "kind string, row long, doc long, held_out boolean, n long, a binary, b binary, c binary, d binary"


def _count(vocabulary: Vocabulary, buckets: int):
    """(doc, held_out, text) to document rows, postings of rare words by bucket, and counts.

    ``doc`` rows: classes (a), frequent words' numbers (b) and times (c).  ``word`` rows,
    by bucket: hashes (a), offsets from ``row`` (b), times (c), 2 * class + 1 if learned
    from (d).  ``sum`` rows: training counts of frequent words (a) and of classes (b).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 33
        times, in_class = np.zeros(len(vocabulary.frequent), np.int64), np.zeros(CLASSES, np.int64)

        def postings(base: int, held: list[tuple], hashes: np.ndarray, classes: np.ndarray) -> Iterator[tuple]:
            """``held``: a document's row, whether it is learned from, its rare words and their times."""
            rows = np.repeat(np.array([h[0] - base for h in held], np.uint32), [len(h[2]) for h in held])
            learn = np.repeat(np.array([h[1] for h in held], np.uint8), [len(h[2]) for h in held])
            words = np.concatenate([h[2] for h in held])
            count = np.concatenate([h[3] for h in held]).astype(np.uint32)
            code = hashes[words]
            bucket = (code >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                at = order[ends[k] : ends[k + 1]]
                if len(at):
                    mark = classes[words[at]] * 2 + learn[at]
                    yield ("word", base, k, None, len(at), *(x.tobytes() for x in (code[at], rows[at], count[at], mark.astype(np.uint8))))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PARTS)], schema=PARTS)

        def coded(texts: list[tuple], base: int) -> Iterator[pa.RecordBatch]:
            words = pa.concat_arrays([t[2] for t in texts]).dictionary_encode()
            ends = np.concatenate([t[3] + before for t, before in zip(texts, np.cumsum([0, *(len(t[2]) for t in texts)]))])
            # The end is one more word, after the last of each text.
            hashes, classes, numbers = vocabulary.described(pa.concat_arrays([words.dictionary, pa.array([END], pa.binary())]))
            found = np.insert(words.indices.to_numpy().astype(np.int64), ends, len(words.dictionary))
            out, held = [], []
            docs = ((doc, out_of) for t in texts for doc, out_of in zip(t[0].to_pylist(), t[1].to_pylist()))
            for row, ((doc, out_of), codes) in enumerate(zip(docs, np.split(found, (ends + np.arange(1, len(ends) + 1))[:-1])), base):
                sequence = classes[codes]
                unique, count = np.unique(codes, return_counts=True)
                number = numbers[unique]
                common = number >= 0
                if not out_of:
                    np.add.at(times, number[common], count[common])
                    in_class[:] += np.bincount(sequence, minlength=CLASSES)
                held.append((row, not out_of, unique[~common], count[~common]))
                out.append((
                    "doc", row, doc, out_of, len(codes), sequence.tobytes(),
                    number[common].astype(np.uint16).tobytes(), count[common].astype(np.uint32).tobytes(), None,
                ))
            if out:
                yield batch_of(out)
                if rows := list(postings(base, held, hashes, classes)):
                    yield batch_of(rows)

        texts: list[tuple] = []  # ids, held_out, words, ends
        for batch in batches:
            texts.append((batch.column(0), batch.column(1), *split_words(batch.column(2))))
            if sum(len(t[2]) for t in texts) > FLUSH_TOKENS or sum(t[2].nbytes for t in texts) > FLUSH_BYTES:
                yield from coded(texts, next_row)
                next_row += sum(len(t[0]) for t in texts)
                texts = []
        if texts:
            yield from coded(texts, next_row)
        yield batch_of([("sum", None, None, None, None, times.tobytes(), in_class.tobytes(), None, None)])

    return run


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of whole buckets to sums for each document, and counts of word types."""
    code, row, count, mark = [], [], [], []
    for batch in batches:
        for base, a, b, c, d in zip(*(batch.column(k).to_pylist() for k in ("row", "a", "b", "c", "d"))):
            code.append(np.frombuffer(a, np.uint64))
            row.append(np.frombuffer(b, np.uint32) + np.int64(base))
            count.append(np.frombuffer(c, np.uint32))
            mark.append(np.frombuffer(d, np.uint8))
    if not code:
        return
    code, row, count, mark = (np.concatenate(x) for x in (code, row, count, mark))
    words, which = np.unique(code, return_inverse=True)
    learn = (mark & 1).astype(bool)
    total = np.bincount(which[learn], weights=count[learn], minlength=len(words))
    kind = np.zeros(len(words), np.int64)
    kind[which] = mark >> 1
    docs, place = np.unique(row, return_inverse=True)
    logs = np.bincount(place, weights=count * np.log10(total[which] + 1), minlength=len(docs))
    known = np.bincount(place, weights=count * (total[which] > 0), minlength=len(docs)).astype(np.int64)
    # One row for the documents of each task that counted them; word types of a class
    # go under the negative number of the class less one, as if they were documents.
    parts = docs >> 33
    starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
    ends = np.r_[starts[1:], len(docs)]
    out = [(int(parts[s]), docs[s:e].tobytes(), logs[s:e].tobytes(), known[s:e].tobytes()) for s, e in zip(starts, ends)]
    types = np.bincount(kind[total > 0], minlength=CLASSES).astype(np.int64)
    out.append((-1, np.arange(-1, -1 - CLASSES, -1, np.int64).tobytes(), np.zeros(CLASSES).tobytes(), types.tobytes()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
        ["part", "rows", "logs", "known"],
    )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of whole parts, one row for each document."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, *packed in zip(*(c.to_pylist() for c in batch.columns)):
            rows, logs, known = (np.frombuffer(x, t) for x, t in zip(packed, (np.int64, np.float64, np.int64)))
            sums.setdefault(part, []).append((rows, logs, known))
    for many in sums.values():
        rows, which = np.unique(np.concatenate([m[0] for m in many]), return_inverse=True)
        logs = np.bincount(which, weights=np.concatenate([m[1] for m in many]))
        known = np.bincount(which, weights=np.concatenate([m[2] for m in many])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(logs), pa.array(known)], ["row", "rare_logs", "rare_known"])


def _summed(rows: DataFrame, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of fixed size (``a`` of ``kind``, ``b`` whole numbers), added up in at most 16 tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = None
        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(x, kind), np.frombuffer(y, np.int64)
                a, b = (x, y) if a is None else (a + x, b + y)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (a, b)], ["a", "b"])

    added = rows.select("a", "b").repartition(16).mapInArrow(run, "a binary, b binary").collect()
    return [(np.frombuffer(r["a"], kind), np.frombuffer(r["b"], np.int64)) for r in added]


def _tuned(net_of, rate: float):
    """Class sequences of a task to the network as that task would have it, weighed by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = [np.frombuffer(x, np.uint8) for batch in batches for x in batch.column(0).to_pylist()]
        if not sequences:
            return
        start: GatedNetwork = net_of.value
        net = GatedNetwork(start.hidden)
        net.weights = {k: v.copy() for k, v in start.weights.items()}
        train_network(sequences, net.hidden, 1, lanes=TASK_LANES, rate=rate, net=net)
        tokens = sum(map(len, sequences))
        moved = np.concatenate([(net.weights[k] - start.weights[k]).ravel() for k in net.weights]).astype(np.float64) * tokens
        yield pa.RecordBatch.from_arrays(
            [pa.array([moved.tobytes()], pa.binary()), pa.array([np.array([tokens], np.int64).tobytes()], pa.binary())], ["a", "b"]
        )

    return run


def _averaged(net: GatedNetwork, moves: list[tuple[np.ndarray, np.ndarray]]) -> GatedNetwork:
    """The network moved by the mean of the tasks' moves."""
    if moves:
        step = sum(m[0] for m in moves) / sum(int(m[1][0]) for m in moves)
        at = 0
        for w in net.weights.values():
            w += step[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
    return net


@dataclass
class Model:
    """What scoring needs beside a document: the network, log counts, class sizes, N and V."""

    net: GatedNetwork
    logs: np.ndarray
    class_sizes: np.ndarray
    tokens: int
    types: int


def _score(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_of.value
        sizes = np.log10(model.class_sizes)
        per_token = np.log10(model.tokens + model.types + 1)

        def scored(rows: list[tuple]) -> pa.RecordBatch:
            sequences = [r[4] for r in rows]
            flow = class_log10(model.net, sequences)
            base, score, known = [], [], []
            for (_, _, _, n, sequence, number, count), p in zip(rows, flow):
                logs = model.logs[number]
                common = float((count * logs).sum())
                base.append(common - n * per_token)
                score.append(common + p - float(np.bincount(sequence, minlength=CLASSES) @ sizes))
                known.append(int(count[logs > 0].sum()))
            head = list(zip(*(r[:4] for r in rows)))
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(head, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))),
                 pa.array(known, pa.int64()), pa.array(base), pa.array(score)],
                ["row", "doc", "held_out", "n_tokens", "known", "base", "score"],
            )

        rows, tokens = [], 0
        for batch in batches:
            for row, doc, held, n, a, b, c in zip(*(batch.column(k).to_pylist() for k in ("row", "doc", "held_out", "n", "a", "b", "c"))):
                rows.append((row, doc, held, n, np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint16), np.frombuffer(c, np.uint32)))
                tokens += n
            if tokens > 4 * FLUSH_TOKENS:
                yield scored(rows)
                rows, tokens = [], 0
        if rows:
            yield scored(rows)

    return run


def language_model_scores(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
    sample_docs: int = 1200, frequent_words: int = 1 << 14, hidden: int = 24, epochs: int = 2,
) -> DataFrame:
    """log10 probability of every whole text under the recurrent model and the base model.

    ``held_out`` is a condition on the id column; such documents are scored, not learned
    from.  Tokens are words between ASCII white space, A-Z lower-cased, then one end.
    One row per document: the id column, ``held_out``, ``n_tokens``, ``n_known`` (tokens
    with a training count), ``train_tokens`` (N), ``base_score`` (add-one unigrams over
    the V training types and one unknown), ``score``.

    Counts and the frequent-word list come from all training documents.  The network's
    first weights come from the classes of about ``sample_docs`` of them, drawn by a hash
    of the id; every task then trains on with all its training documents, whole.
    A null text counts as empty (its end alone); rows that
    share an id are documents of their own; a null id is learned from if ``held_out`` is
    not true for it.  Without a training document every count is zero and classes are
    taken as equally likely.
    """
    spark = settle(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"),
    )
    training = rows.where("NOT held_out")
    vocabulary = Vocabulary.of_all(training.select(F.col("text").cast("binary").alias("text")), frequent_words)
    buckets = partitions(spark)
    path = shared_folder(spark, fresh_name("lm_counts"))
    (
        rows.select("doc", "held_out", F.col("text").cast("binary").alias("text"))
        .mapInArrow(_count(vocabulary, buckets), PARTS_DDL).write.partitionBy("kind").parquet(path)
    )
    parts = spark.read.schema(PARTS_DDL).parquet(path)
    kind = lambda name: parts.where(F.col("kind") == name)
    rare = stage(
        kind("word").withColumn("bucket", F.col("doc")).repartition(buckets, "bucket")
        .select("row", "a", "b", "c", "d").mapInArrow(_rare, "part long, rows binary, logs binary, known binary")
        .repartition(partitions(spark), "part").mapInArrow(_gathered, "row long, rare_logs double, rare_known long")
    )
    sums = _summed(kind("sum"), np.int64)
    counts = sum((s[0] for s in sums), np.zeros(len(vocabulary.frequent), np.int64))
    in_class = sum((s[1] for s in sums), np.zeros(CLASSES, np.int64))
    types = np.bincount(
        [vocabulary.word_class(w) for w, n in zip(vocabulary.frequent, counts) if n > 0] or [0], minlength=CLASSES
    ) * (counts.max() > 0)
    for r in rare.where("row < 0").collect():  # one row a class
        types[-1 - r["row"]] += r["rare_known"]
    # A sample of class sequences gives the first weights; then every task goes on training
    # with all its training documents, and the network moves by the mean of their moves.
    learned = kind("doc").where(~F.col("held_out"))
    there = int(counts[0])  # every training document has one end
    drawn = F.pmod(F.xxhash64("doc", F.lit(4)), F.lit(1 << 30)) < int(min(1.0, sample_docs / max(there, 1)) * (1 << 30))
    sample = sorted(bytes(r["a"]) for r in learned.where(drawn).select("a").collect())
    net = train_network([np.frombuffer(x, np.uint8) for x in sample], hidden, epochs) if sample else GatedNetwork(hidden)
    moved = learned.select("a").mapInArrow(_tuned(spark.sparkContext.broadcast(net), 0.002), "a binary, b binary")
    net = _averaged(net, _summed(moved, np.float64))
    model = Model(net, np.log10(counts + 1.0), in_class + types + 1.0, int(in_class.sum()), int(types.sum()))
    scored = kind("doc").select("row", "doc", "held_out", "n", "a", "b", "c").mapInArrow(
        _score(spark.sparkContext.broadcast(model)),
        "row long, doc long, held_out boolean, n_tokens long, known long, base double, score double",
    )
    zero = F.lit(0.0)
    return scored.join(rare.where("row >= 0"), "row", "left").select(
        F.col("doc").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_logs", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_logs", zero)).alias("score"),
    )
