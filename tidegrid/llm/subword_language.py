"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte n-grams inside words, word ends included.  Embeddings and softmax
are trained together by stochastic gradient descent in numpy.  A temperature and limits
of rejection are then set on documents kept out of the descent, against the same documents
with shuffled letters and with their own language left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.shared import packed, settle, unpacked

GRAMS = (2, 3, 4)
#: Texts are put together up to this many bytes for one pass of numpy, which goes by slices.
PASS_BYTES = 1 << 20
SLICE_BYTES = 1 << 15
#: ASCII letters in lower case and all bytes beyond ASCII stand for themselves, the rest are gaps.
_BYTE = np.full(256, 32, np.uint8)
_BYTE[97:123] = np.arange(97, 123)
_BYTE[65:91] = np.arange(97, 123)
_BYTE[128:] = np.arange(128, 256)


def sliced_subwords(texts: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers of subwords and the text that each is of, in the order of the texts,
    for every slice of bytes and every length of subword."""
    starts = np.cumsum([0, *(len(t) + 2 for t in texts)])
    flat = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
    for lo in range(0, len(flat), SLICE_BYTES):
        part = _BYTE[flat[lo : lo + SLICE_BYTES + max(GRAMS) - 1]]
        gap, wide = part == 32, part.astype(np.uint32)
        for n in GRAMS:
            last = min(SLICE_BYTES, len(part) - n + 1)
            if last <= 0:
                continue
            code = np.full(last, n, np.uint32)
            inner = np.zeros(last, bool)
            for i in range(n):
                code = code * np.uint32(0x01000193) ^ wide[i : i + last]
                if 0 < i < n - 1:
                    inner |= gap[i : i + last]
            if n == 2:
                inner = gap[:last] & gap[1 : 1 + last]
            at = np.flatnonzero(~inner)
            if len(at):
                code = code[at] * np.uint32(0x9E3779B1)
                yield ((code >> np.uint32(7)) % np.uint32(buckets)).astype(np.int64), np.searchsorted(starts, lo + at, side="right") - 1


def subwords(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all subwords of the texts in turn, and how many each text has."""
    found = list(sliced_subwords(texts, buckets))
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    codes, owner = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(owner, kind="stable")
    return codes[order], np.bincount(owner, minlength=len(texts))


@dataclass
class SubwordModel:
    """``scores`` holds each bucket's embedding already times the softmax weights.

    ``usual`` holds log shares of the buckets in each language's training texts; a text's mean
    of them under its best language, less that language's ``center`` and over the ``spread``
    of a text of its length, is its familiarity.  A text is rejected if its probability is
    under ``limit`` or its familiarity under ``strange``.
    """

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0
    usual: np.ndarray | None = None
    center: np.ndarray | None = None
    spread: tuple[float, float] = (1.0, 0.0)
    strange: float = -np.inf

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits before the temperature, mean log shares of each language, and numbers of subwords.

        Subwords are looked up a slice of the texts at a time, summed in double precision, so
        that a text of any length takes no more memory than its bytes and a slice.
        """
        tables = [self.scores, self.usual]
        sums = np.zeros((2, len(texts), len(self.langs)))
        counts = np.zeros(len(texts), np.int64)
        for codes, owner in sliced_subwords(texts, len(self.scores)):
            new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            whose = owner[new]
            counts[whose] += np.diff(np.append(new, len(owner)))
            for table, held in zip(tables, sums):
                if table is not None:
                    held[whose] += np.add.reduceat(table[codes], new, axis=0, dtype=np.float64)
        sums /= np.maximum(counts, 1)[:, None]
        return sums[0] + self.bias, sums[1], counts

    def familiarity(self, usual: np.ndarray, counts: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How far each text is from usual texts of its best language, in standard deviations."""
        if self.center is None:
            return np.zeros(len(best))
        far = usual[np.arange(len(best)), best] - self.center[best]
        return far / np.sqrt(self.spread[0] + self.spread[1] / np.maximum(counts, 1))

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and whether it is rejected, of each text."""
        logits, usual, counts = self.means(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        score = p.max(axis=1)
        return best, score, (score < self.limit) | (self.familiarity(usual, counts, best) < self.strange)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.means(texts)[0] / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    texts: list[bytes], labels: list[str], buckets: int = 1 << 16, dim: int = 16,
    epochs: int = 8, rate: float = 0.5, window: int = 400, seed: int = 11,
) -> SubwordModel:
    """Fit on whole texts and on random windows of them, so that short texts work too.

    A fifth of the texts is kept out and calibrates the model.  Of fewer than 20, all are
    learned from, and models without a quarter each calibrate on that quarter.
    """
    langs = sorted(set(labels))
    index = {lang: i for i, lang in enumerate(langs)}
    truth = np.array([index[label] for label in labels])
    place = np.arange(len(texts))

    def fitted(learn: np.ndarray) -> SubwordModel:
        return _descent(texts, truth, langs, learn, buckets, dim, epochs, rate, window, seed)

    if len(texts) >= 20:
        hold = place % 5 == 4
        model = fitted(np.flatnonzero(~hold))
        parts = [(model, np.flatnonzero(hold))]
    else:
        model = fitted(place)
        parts = [(fitted(place[place % 4 != k]), place[place % 4 == k]) for k in range(4) if len(texts) > k and len(texts) > 1]
    _calibrate(model, [(m, [texts[i] for i in at], truth[at]) for m, at in parts], window, seed)
    return model


def _descent(texts, truth, langs, learn, buckets, dim, epochs, rate, window, seed) -> SubwordModel:
    draw = np.random.default_rng(seed)
    table = draw.normal(0, 1.0 / dim, (buckets, dim))
    weights, bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
    steps, step = epochs * max(len(learn), 1), 0
    for _ in range(epochs):
        for i in draw.permutation(learn):
            text = texts[i]
            if len(text) > window and draw.random() < 0.7:
                at = draw.integers(0, len(text) - window)
                text = text[at : at + int(draw.integers(window // 8, window))]
            codes, _ = subwords([text], buckets)
            pace = rate * (1 - step / steps)
            step += 1
            if not len(codes):
                continue
            used, counts = np.unique(codes, return_counts=True)
            share = counts / counts.sum()
            mean = share @ table[used]
            slope = softmax(mean @ weights + bias)
            slope[truth[i]] -= 1
            back = weights @ slope
            weights -= pace * np.outer(mean, slope) * dim
            bias -= pace * 0.01 * slope
            table[used] -= pace * dim * share[:, None] * back
    seen = np.zeros((len(langs), buckets))
    for i in learn:
        seen[truth[i]] += np.bincount(subwords([texts[i]], buckets)[0], minlength=buckets)
    usual = np.log((seen + 0.1) / (seen.sum(axis=1, keepdims=True) + 0.1 * buckets)).T
    return SubwordModel(langs, (table @ weights).astype(np.float32), bias, usual=usual.astype(np.float32))


def shuffled(text: bytes, draw: np.random.Generator) -> bytes:
    """The text with its letters dealt anew; gaps stay where they are."""
    chars = np.array(list(text.decode(errors="ignore")))
    at = np.flatnonzero([c.isalpha() for c in chars])
    chars[at] = chars[draw.permutation(at)]
    return "".join(chars).encode()


def _between(clean: np.ndarray, other: np.ndarray, lose: float) -> float:
    """A limit under which at most the share ``lose`` of ``clean`` falls; lower, halfway to the
    upper hundredth of ``other``, where the two are apart."""
    high = float(np.quantile(clean, lose, method="lower"))
    low = float(np.quantile(other, 0.99)) if len(other) else -np.inf
    return (high + low) / 2 if -np.inf < low < high else high


def _calibrate(
    model: SubwordModel, parts: list[tuple[SubwordModel, list[bytes], np.ndarray]], window: int, seed: int,
    lose: float = 0.001, cuts: int = 3,
) -> None:
    """Temperature of least surprise, and limits of the probability and the familiarity.

    ``parts`` are models with texts that they have not learned from.  Each text counts whole
    and in windows.  Together the limits reject at most the share ``lose`` of the texts that
    get their own language.  Texts that should be rejected are those texts with their letters
    shuffled, and as they look where their own language has not been learned.
    """
    draw = np.random.default_rng(seed)
    logits, usual, counts, truth, junk = [], [], [], [], []
    for made, texts, right in parts:
        rows = [(text, r) for text, r in zip(texts, right)]
        for text, r in zip(texts, right):
            for _ in range(cuts if len(text) > window else 0):
                at = int(draw.integers(0, len(text) - window))
                rows.append((text[at : at + int(draw.integers(window // 8, window))], r))
        found = made.means([text for text, _ in rows])
        some = found[2] > 0
        for kept, new in zip((logits, usual, counts), found):
            kept.append(new[some])
        truth.append(np.array([r for _, r in rows], np.int64)[some])
        found = made.means([shuffled(text, draw) for text, _ in rows])
        junk.append(tuple(x[found[2] > 0] for x in found))
    if not sum(map(len, truth)):
        return
    logits, usual, counts, truth = (np.concatenate(x) for x in (logits, usual, counts, truth))
    every = np.arange(len(truth))
    grid = np.geomspace(0.05, 20, 61)
    surprise = [-np.log(np.maximum(softmax(logits / t)[every, truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(surprise))])
    clean = logits.argmax(axis=1) == truth
    if not clean.any():
        return
    own = usual[every, truth]
    model.center = np.array([
        own[clean & (truth == i)].mean() if (clean & (truth == i)).any() else own[clean].mean() for i in range(len(model.langs))
    ])
    # Squared distances as a part that every text has and one that shrinks with its length.
    square = (own - model.center[truth])[clean] ** 2
    terms = np.stack([np.ones(len(square)), 1 / counts[clean]], axis=1)
    fit = np.linalg.lstsq(terms, square, rcond=None)[0]
    if fit.min() < 0:  # one part alone
        fit = np.array([square.mean(), 0.0]) if fit[1] < 0 else np.array([0.0, square.mean() / terms[:, 1].mean()])
    model.spread = (float(fit[0]) + 1e-4, float(fit[1]))

    def measured(logits, usual, counts):
        best = logits.argmax(axis=1)
        return softmax(logits / model.temperature).max(axis=1), model.familiarity(usual, counts, best)

    top, near = measured(logits[clean], usual[clean], counts[clean])
    others = [measured(*(np.concatenate(x) for x in zip(*junk)))]
    if len(model.langs) > 2:  # without the text's own language
        left = logits.copy()
        left[every, truth] = -np.inf
        others.append(measured(left, usual, counts))
    elif len(model.langs) == 2:  # the other language is the only one, and sure
        best = 1 - truth
        others.append((np.ones(len(truth)), model.familiarity(usual, counts, best)))
    model.limit = _between(top, np.concatenate([o[0] for o in others]), lose / 2)
    model.strange = _between(near, np.concatenate([o[1] for o in others]), lose / 2)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def training_rows(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int, max_chars: int,
) -> list:
    """At most about ``max_rows`` labelled documents, the languages as even as they allow.

    Documents are taken by a hash of their id, so a hot source weighs no more than its
    share.  Rows over ``max_chars`` are not learned from: the sample has to fit the driver.
    """
    known = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")
    ).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.char_length("text") <= max_chars)
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    each = max(1, max_rows // len(counts))
    chosen = F.lit(False)
    drawn = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (drawn < int(min(1.0, each / n) * (1 << 30))))
    return known.where(chosen & F.col("text").rlike(r"\p{L}")).collect()


def fit_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    modulus: int = 4, remainder: int = 2, max_rows: int = 2400, max_chars: int = 40_000,
) -> SubwordModel | None:
    """Train on a bounded sample of the documents that are not held out; None without any."""
    settle(docs.sparkSession)
    open_docs = docs.where(~held_out(F.col(f"`{id_col}`"), modulus, remainder))
    rows = training_rows(open_docs, id_col, text_col, lang_col, max_rows, max_chars)
    # In a fixed order: the descent takes them one after the other.
    rows = sorted(rows, key=lambda r: (r["id"], r["lang"], r["text"]))
    return train([r["text"].encode() for r in rows], [r["lang"] for r in rows]) if rows else None


def passes(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > PASS_BYTES:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def predict_language(docs: DataFrame, model: SubwordModel | None, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``lang_pred``, ``lang_score`` and ``lang_rejected``.

    Columns of those names are replaced.  Whole texts are read and nothing but the text.
    A text that is null or has no letter is ``und`` with score 0 and rejected, and so is
    every text without a model.  A text whose calibrated probability or whose familiarity
    is under the model's limit is rejected but has its best language.  Ties go to the first name.
    """
    spark = settle(docs.sparkSession)
    added = ["lang_pred", "lang_score", "lang_rejected"]
    names = [c for c in docs.columns if c not in added]
    lettered = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    sent = spark.sparkContext.broadcast(model)  # buckets x languages, a size set by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            texts, use = batch.column(1), batch.column(2).to_pylist()
            best_names: list[str] = ["und"] * len(use)
            score, rejected = np.zeros(len(use)), np.ones(len(use), bool)
            at = np.array([i for i, u in enumerate(use) if u and fitted is not None], np.int64)
            done = 0
            for part in passes([texts[int(i)].as_py() for i in at]):
                best, scores, rejects = fitted.judge(part)
                here = at[done : done + len(part)]
                score[here], rejected[here] = scores, rejects
                for i, b in zip(here, best):
                    best_names[i] = fitted.langs[b]
                done += len(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best_names, pa.string()), pa.array(score), pa.array(rejected)], ["row", *added]
            )

    rows = docs.select(packed(names), F.col(f"`{text_col}`").cast("binary").alias("text"), lettered.alias("lettered"))
    schema = T.StructType([
        rows.schema["row"], T.StructField("lang_pred", T.StringType()),
        T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType()),
    ])
    return rows.mapInArrow(run, schema).select(*unpacked(names), *added)
