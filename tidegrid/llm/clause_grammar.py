"""Toxicity by a weighted finite-state grammar of clauses.

Small transducers read a clause word by word: one finds insults, one threats, one whether a
target is near, one the scope of a negation, one reported speech.  Their composition is one
deterministic machine whose output names how a word stands in its clause.  Insults are words
of a letter trie: its arcs carry weights learned from labelled documents, a word's own
evidence drawn towards that of its longest known beginnings.  A document is scored by the
summed weights of its matched clauses, by how they were matched, under a logistic model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.shared import packed, settle, unpacked

# Fixed word lists of the grammar (English, German, French, Spanish).
INSULTS = """idiot idiots moron morons stupid dumb fool loser losers pathetic worthless disgusting scum trash garbage
clown coward jerk imbecile filth vermin dummkopf idioten trottel abschaum versager widerlich erbärmlich wertlos
imbécile stupide ordure minable idiota estúpido estúpida imbécil basura inútil asqueroso""".split()
THREATS = """kill killing hurt destroy beat burn shoot stab murder strangle töten umbringen vernichten schlagen
tuer détruire frapper brûler matar destruir golpear quemar""".split()
TARGETS = """you your yours yourself u he she they him her them his their this these those people everyone
du dich dir dein deine ihr euch sie er tu toi ton ta vous votre il elle ils elles tú te usted ustedes él ella ellos""".split()
NEGATIONS = """not no never none without isn aren wasn weren don doesn didn won cannot nicht kein keine nie niemals
ohne ne pas jamais sans sin nunca jamás tampoco""".split()
REPORTS = """said says say saying told tells called calls quoted quote quotes claims claimed wrote writes according
sagte sagt sagen nannte schrieb dit disait écrit appelle dijo dice escribió llamó""".split()

#: Classes of words that the machines read.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: How an insult or a threat can stand in its clause.
OUTCOMES = ["plain", "targeted", "negated", "reported", "threat", "idle_threat"]
NEAR, SCOPE = 4, 3

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_GAP = re.compile(r"[\W\d_]")
SLICE = 1 << 16
_ENDS = frozenset(".!?;:\n")


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine: ``step[state][symbol]`` is (next state, output)."""

    start: int
    step: list[list[tuple[int, object]]]


def finder(symbol: int) -> Transducer:
    """Outputs True at the given class of words."""
    return Transducer(0, [[(0, s == symbol) for s in range(6)]])


def recent(symbol: int, reach: int) -> Transducer:
    """Outputs whether the class was read at most ``reach`` words ago."""
    return Transducer(0, [
        [(reach if s == symbol else max(left - 1, 0), left > 0) for s in range(6)] for left in range(reach + 1)
    ])


def opened(symbol: int) -> Transducer:
    """Outputs whether the class was read before in the clause."""
    return Transducer(0, [[(int(seen or s == symbol), bool(seen)) for s in range(6)] for seen in (0, 1)])


def compose(machines: list[Transducer]) -> Transducer:
    """The machine that runs all of them side by side; outputs are tuples.  Only states
    that can be reached are built."""
    start = tuple(m.start for m in machines)
    number, step, open_states = {start: 0}, [], [start]
    for state in open_states:
        row = []
        for symbol in range(6):
            moves = [m.step[s][symbol] for m, s in zip(machines, state)]
            lands = tuple(to for to, _ in moves)
            if lands not in number:
                number[lands] = len(number)
                open_states.append(lands)
            row.append((number[lands], tuple(out for _, out in moves)))
        step.append(row)
    return Transducer(0, step)


def _outcome(insult: bool, threat: bool, target: bool, negated: bool, reported: bool) -> int | None:
    if threat:
        return 5 if negated or reported else 4
    if insult:
        return 2 if negated else 3 if reported else 1 if target else 0
    return None


def clause_machine() -> tuple[list[list[tuple[int, int | None]]], list[bool]]:
    """The composition of all machines with its outputs read as places in OUTCOMES, and the
    states in which a target is near."""
    made = compose([finder(INSULT), finder(THREAT), recent(TARGET, NEAR), recent(NEGATION, SCOPE), opened(REPORT)])
    return [[(to, _outcome(*out)) for to, out in row] for row in made.step], [row[OTHER][1][2] for row in made.step]


MACHINE, MACHINE_TARGET = clause_machine()
#: A threat counts only with a target near it in its clause, before or after.
THREAT_WEIGHT = 2.5
#: What the fixed insults are drawn to.
FIXED_ODDS = 3.0
CLASSES = {
    **{w: TARGET for w in TARGETS}, **{w: NEGATION for w in NEGATIONS}, **{w: REPORT for w in REPORTS},
    **{w: THREAT for w in THREATS},
}


def tokens(text: str) -> Iterator[str]:
    """Lower-cased words (letters only) and the marks that end clauses, a slice of the text at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):  # never inside a word
            gap = _GAP.search(text, end)
            end = gap.end() if gap else len(text)
        yield from _TOKEN.findall(text[at:end].lower())
        at = end


@dataclass
class InsultTrie:
    """Weights of words, and of beginnings of words for those that were not learned."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    least: int = 4

    def __post_init__(self):
        self.heads = {s[: self.least] for s in self.stems}
        self.longest = max(map(len, self.stems), default=0)

    def weight(self, word: str) -> float:
        """Of a word: its own, or that of its longest known beginning; 0 for none."""
        own = self.words.get(word)
        if own is not None:
            return own
        if word[: self.least] in self.heads:
            for n in range(min(len(word) - 1, self.longest), self.least - 1, -1):
                stem = self.stems.get(word[:n])
                if stem is not None:
                    return stem
        return 0.0


def _odds(hits: int, toxic: int, misses: int, clean: int) -> float:
    return float(np.log((hits + 0.5) / (toxic + 1)) - np.log((misses + 0.5) / (clean + 1)))


def learn_trie(
    docs: Iterable[tuple[frozenset[str], int]], least_docs: int = 4, least_odds: float = 1.5, strength: float = 4.0, least: int = 4, most: int = 9,
) -> InsultTrie:
    """Weights from (words, toxic) pairs by the documents that hold a word or a beginning.

    A word's log odds are drawn towards those of its beginnings, the longer the nearer, with
    the weight of ``strength`` documents.  The fixed insults count as seen in two toxic ones.
    """
    words, stems = (Counter(), Counter()), (Counter(), Counter())
    size = [0, 0]
    for own, toxic in docs:
        size[toxic] += 1
        words[toxic].update(own)
        stems[toxic].update({w[:n] for w in own for n in range(least, min(len(w) - 1, most) + 1)})
    words[1].update({w: 2 for w in INSULTS})
    clean, toxic = size

    def odds(counts, x) -> float:
        return _odds(counts[1][x], toxic, counts[0][x], clean)

    held: dict[str, float] = {}
    for stem in sorted((s for s, n in stems[1].items() if n >= least_docs), key=len):
        n = stems[1][stem] + stems[0][stem]
        above = held.get(stem[:-1])
        own = odds(stems, stem)
        held[stem] = own if above is None else (n * own + strength * above) / (n + strength)
    known: dict[str, float] = {}
    for word, hits in words[1].items():
        n = hits + words[0][word]
        above = next((held[word[:k]] for k in range(min(len(word) - 1, most), least - 1, -1) if word[:k] in held), 0.0)
        if word in INSULTS:
            above = max(above, FIXED_ODDS)
        value = (n * odds(words, word) + strength * above) / (n + strength)
        if (hits >= least_docs or word in INSULTS) and value >= least_odds:
            known[word] = value
    # What clean documents hold is known as well: it must not fall back to a beginning.
    kept = {s: v for s, v in held.items() if v >= least_odds}
    trie = InsultTrie(known, kept, least)
    for word, misses in words[0].items():
        if word not in known and misses >= least_docs and trie.weight(word) > 0:
            known[word] = max(0.0, odds(words, word))
    return InsultTrie(known, kept, least)


@dataclass
class ToxicityModel:
    trie: InsultTrie
    weights: np.ndarray
    bias: float

    def clauses(self, text: str) -> Iterator[tuple[int, int, float, list[tuple[str, str, float]]]]:
        """Matched clauses: (first token, one after the last, weight, [(word, outcome, weight)])."""
        start, i, state = 0, -1, 0
        clause: list[tuple[str, str, float]] = []
        waiting: list[tuple[int, tuple[str, str, float]]] = []  # threats that have met no target so far
        look, weight = CLASSES.get, self.trie.weight
        for i, word in enumerate(tokens(text)):
            if word in _ENDS:
                if clause:
                    yield start, i, sum(w for _, _, w in clause), clause
                start, state, clause, waiting = i + 1, 0, [], []
                continue
            symbol, value = look(word, OTHER), 0.0
            if symbol == OTHER:
                value = weight(word)
                if value > 0:
                    symbol = INSULT
            elif symbol == TARGET and waiting:
                clause += [match for last, match in waiting if i <= last]
                waiting = []
            near = MACHINE_TARGET[state]
            state, outcome = MACHINE[state][symbol]
            if outcome is None:
                continue
            if symbol != THREAT:
                clause.append((word, OUTCOMES[outcome], value))
            elif near:
                clause.append((word, OUTCOMES[outcome], THREAT_WEIGHT))
            else:
                waiting.append((i + NEAR, (word, OUTCOMES[outcome], THREAT_WEIGHT)))
        if clause:
            yield start, i + 1, sum(w for _, _, w in clause), clause

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float, list[tuple[str, str, float]]]]]:
        """Probability of the label and the matched clauses that it comes from."""
        found = list(self.clauses(text))
        return float(_logistic(features(found, text) @ self.weights + self.bias)), found


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


N_FEATURES = len(OUTCOMES) + 3
#: Where the weights are drawn to when labels say little: outcomes, best clause, distinct words, length.
PRIOR = np.array([0.8, 1.0, 0.3, 0.3, 1.6, 0.3, 0.5, 0.5, -0.3])


def features(clauses: list, text: str) -> np.ndarray:
    """Log sums of weights by outcome, the best clause, the distinct words' sum, and the length."""
    sums = dict.fromkeys(OUTCOMES, 0.0)
    best, different = 0.0, {}
    for _, _, _, words in clauses:
        heard = 0.0
        for word, outcome, value in words:
            sums[outcome] += value
            if outcome in ("plain", "targeted", "threat"):
                heard += value
                different[word] = value
        best = max(best, heard)
    length = text.count(" ") + text.count("\n") + 1
    out = [np.log1p(v) for v in sums.values()]
    return np.array([*out, np.log1p(best), np.log1p(sum(different.values())), np.log(length)])


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.3, steps: int = 40) -> tuple[np.ndarray, float]:
    """Newton's method for a logistic model drawn towards ``prior``; the constant is free."""
    x1 = np.column_stack([x, np.ones(len(x))])
    goal, pull = np.append(prior, 0.0), np.append(np.full(len(prior), ridge), 1e-6)
    w = goal.copy()
    for _ in range(steps):
        p = _logistic(x1 @ w)
        slope = x1.T @ (p - y) + pull * (w - goal)
        curve = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pull) + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w = w - move * min(1.0, 3.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(rows: list[tuple[str, int]], folds: int = 3) -> ToxicityModel:
    """Trie and logistic model.  The model learns from features that tries of the other folds
    give, so that it does not take a word's own documents for proof."""
    if not rows or len({t for _, t in rows}) < 2:
        # Nothing to tell apart: the fixed lists and the weights they are drawn to.
        return ToxicityModel(learn_trie([]), PRIOR, -2.0)
    bags = [(frozenset(w for w in tokens(text) if len(w) >= 3), toxic) for text, toxic in rows]
    whole = learn_trie(bags)
    x, y = [], []
    for k in range(folds):
        enough = len(rows) >= 10 * folds
        trie = learn_trie(row for i, row in enumerate(bags) if i % folds != k) if enough else whole
        for text, toxic in rows[k::folds]:
            x.append(features(list(ToxicityModel(trie, PRIOR, 0.0).clauses(text)), text))
            y.append(toxic)
    return ToxicityModel(whole, *fit_logistic(np.array(x), np.array(y), PRIOR))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 6000,
    max_chars: int = 10_000,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled documents: at most about ``max_rows`` rows of at
    most ``max_chars`` characters, half of them toxic where there are enough.

    ``labels`` has the id and a 0/1 column.  ``held_out`` is a condition over ``id``; where it
    holds, labels are not read.  An id with several labels counts as toxic if any says so; null
    ids, texts and labels are not learned from, and of documents that share an id one text is.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    known = known.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    if held_out is not None:
        known = known.where(~F.coalesce(held_out, F.lit(False)))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(f"`{id_col}`").alias("own"), F.col(f"`{text_col}`").alias("text")).where(
        F.col("own").isNotNull() & (F.length("text") > 0) & (F.length("text") <= max_chars)
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen, drawn = F.lit(False), F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30))
    toxic = min(counts.get(1, 0), max_rows // 2)
    for label, take in ((1, toxic), (0, max_rows - toxic)):
        share = min(1.0, take / counts[label]) if counts.get(label) else 0.0
        chosen = chosen | ((F.col("toxic") == label) & (drawn < int(share * (1 << 30))))
    # At most max_rows rows by the draw, so the join sends them to the documents.
    picked = known.where(chosen)
    found = texts.join(F.broadcast(picked), F.col("own") == F.col("id")).groupBy("id").agg(
        F.max("toxic").alias("toxic"), F.min("text").alias("text")
    )
    rows = sorted((r["id"], r["text"], r["toxic"]) for r in found.collect())
    return train([(text, toxic) for _, text, toxic in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """The columns of ``docs`` with ``toxicity`` (0 to 1), ``toxic`` (whether it is ``limit`` or
    more) and ``matched``, the clauses that matched: place of their first token, words with how
    they stand, and weight.

    Columns of those names are replaced.  Whole texts are read, nothing but the text.  A null
    text counts as empty and gets the model's score of nothing.  Equal texts score alike.
    """
    spark = settle(docs.sparkSession)
    added = ["toxicity", "toxic", "matched"]
    names = [c for c in docs.columns if c not in added]
    sent = spark.sparkContext.broadcast(model)  # a trie of a bounded sample's words
    matched = T.ArrayType(T.StructType([
        T.StructField("at", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("weight", T.DoubleType()),
    ]))
    arrow = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.list_(pa.string())), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            scores, found = np.zeros(batch.num_rows), []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                scores[i], clauses = fitted.judge(text)
                found.append([
                    {"at": start, "words": [f"{word}/{outcome}" for word, outcome, _ in words], "weight": weight}
                    for start, _, weight, words in clauses
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array(scores >= limit), pa.array(found, arrow)], ["row", *added]
            )

    rows = docs.select(packed(names), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([
        rows.schema["row"], T.StructField("toxicity", T.DoubleType()), T.StructField("toxic", T.BooleanType()),
        T.StructField("matched", matched),
    ])
    return rows.mapInArrow(run, schema).select(*unpacked(names), *added)
