"""Quality scores by hierarchical empirical Bayes.

A logistic classifier gives each document's evidence.  Evidence is summed by site and
by path in grouped aggregates; a site's rate of good documents is shrunk toward the
global one, a path's toward its site's, the more the fewer documents there are.  The
path's rate, without the document itself, is the prior that the evidence updates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.shared import packed, settle, stage, unpacked

# ------------------------------------------------- evidence of one document

_KIND = np.zeros(256, np.uint8)  # 0: white space and control bytes
_KIND[97:123] = 1
_KIND[128:] = 1  # bytes of letters beyond ASCII, nearly always
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 4
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
FEATURES = 12


def features(text: bytes) -> np.ndarray:
    """Shares and rates that tell prose from junk, of the whole text."""
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6) / max(len(text), 1)
    words = text.split()
    n = max(len(words), 1)
    different = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [line for line in text.split(b"\n") if line]
    letters = max(kinds[1] + kinds[2], 1e-9)
    return np.array([
        kinds[0], kinds[1], kinds[2] / letters, kinds[3], kinds[4], kinds[5],
        again, different / n, different / n**0.7,
        len(text) / n, len(set(lines)) / max(len(lines), 1), np.log1p(len(words)),
    ])


@dataclass
class Evidence:
    """Logistic regression on features cut into bins at quantiles."""

    cuts: np.ndarray
    weights: np.ndarray
    base: float  # log odds of good documents among those it learned from

    def log_ratio(self, rows: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad."""
        return self._design(rows) @ self.weights - self.base

    def _design(self, rows: np.ndarray) -> np.ndarray:
        steps = (rows[:, :, None] > self.cuts[None]).reshape(len(rows), -1)
        return np.hstack([np.ones((len(rows), 1)), steps])


def fit_evidence(rows: np.ndarray, good: np.ndarray, bins: int = 12, ridge: float = 1.0) -> Evidence:
    """Newton's method on the ridge-penalised likelihood."""
    share = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = np.quantile(rows, [*share, 0.01, 0.99], axis=0).T
    rate = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    model = Evidence(cuts, np.zeros(1), float(np.log(rate / (1 - rate))))
    x = model._design(rows)
    w = np.zeros(x.shape[1])
    w[0] = model.base
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(hold), x.T @ (good - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = 6000, max_chars: int = 200_000, held_out: Column | None = None,
) -> Evidence | None:
    """Fit the evidence on about ``max_rows`` labelled documents, drawn by a hash of the id.

    Rows where ``held_out`` (a condition on the id, named ``id``) is true are not learned
    from, nor are null texts or those over ``max_chars`` (the sample has to fit the driver).
    None if there is no label of either kind.
    """
    settle(docs.sparkSession)
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("good"))
    marks = marks.where(F.col("id").isNotNull() & F.col("good").isin(0, 1))
    if held_out is not None:
        marks = marks.where(~held_out)
    n = marks.count()
    drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 30))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    # Written, so that the planner sees how small the sample is and does not move the texts.
    sample = stage(marks.where(drawn))
    rows = (
        texts.where(F.octet_length("text") <= max_chars).join(sample, "id").select("id", "good", "text").collect()
    )
    rows = sorted(rows, key=lambda r: (r["id"], r["good"], r["text"]))
    good = np.array([r["good"] for r in rows], float)
    if not len(good) or good.min() == good.max():
        return None
    return fit_evidence(np.array([features(bytes(r["text"])) for r in rows]), good)


# ------------------------------------------------------------ site posteriors


def _with_evidence(rows: DataFrame, model: Evidence | None) -> DataFrame:
    """``rows`` with their last column, the text as bytes, replaced by ``evidence``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if fitted is None or not texts:
                ratio = np.zeros(len(texts))
            else:
                ratio = np.clip(fitted.log_ratio(np.array([features(t or b"") for t in texts])), -20, 20)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(ratio)], [*batch.schema.names[:-1], "evidence"]
            )

    kept = rows.schema.fields[:-1]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("evidence", T.DoubleType())]))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, rate: str, n: str) -> float:
    """Prior strength by moments: how many documents the rate of all is worth.

    The variance of site means beyond what chance gives tells how much sites differ.
    """
    mean = F.sum(F.col(rate) * F.col(n)) / F.sum(n)
    row = sites.where(F.col(n) > 0).agg(
        mean.alias("mean"), F.sum(n).alias("all"), F.sum(F.col(n) * F.col(n)).alias("squares"),
        F.count(F.lit(1)).alias("sites"),
        (F.sum(F.col(rate) * F.col(rate) * F.col(n)) / F.sum(n)).alias("second"),
    ).first()
    if not row["sites"] or row["sites"] < 2:
        return 1.0
    chance = row["mean"] * (1 - row["mean"])
    between = row["second"] - row["mean"] ** 2 - chance * (row["sites"] - 1) / row["all"]
    between /= max(1 - row["squares"] / row["all"] ** 2, 1e-9)
    return float(np.clip(chance / between - 1, 1.0, 10_000.0)) if between > 0 else 10_000.0


def score_quality(
    docs: DataFrame, model: Evidence | None, text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", least: float = 0.5, prior: float = 0.85,
) -> DataFrame:
    """The columns of ``docs`` with ``evidence``, ``host_rate``, ``path_rate``, ``quality_score``, ``quality_kept``.

    ``quality_score`` is the posterior probability of a good document; documents at
    ``least`` or above are kept.  Columns of these names are replaced.  A null host or
    path is a site of its own; a null text counts as empty.  Without a model the evidence
    is nothing and the score is the prior ``prior``.  ``host_rate`` and ``path_rate``
    leave the document itself out.  An empty table gives an empty result.
    """
    settle(docs.sparkSession)
    added = ["evidence", "host_rate", "path_rate", "quality_score", "quality_kept"]
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(
        packed(names), F.col(f"`{host_col}`").cast("string").alias("host"),
        F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").cast("binary").alias("text"),
    )
    if model is not None:
        prior = float(1 / (1 + np.exp(-model.base)))
    start = float(np.log(prior / (1 - prior)))
    good = 1 / (1 + F.exp(-(F.col("evidence") + start)))
    # Narrow pass: sums by path, combined before they are shuffled; a hot site is one row a task.
    paths = stage(
        _with_evidence(rows.select("host", "path", "text"), model)
        .groupBy("host", "path").agg(F.sum(good).alias("good"), F.count(F.lit(1)).alias("n"))
    )
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    row = paths.agg(F.sum("good"), F.sum("n")).first()
    overall = float(np.clip(row[0] / row[1], 1e-3, 1 - 1e-3)) if row[1] else prior
    of_hosts = _strength(hosts.select((F.col("host_good") / F.col("host_n")).alias("r"), F.col("host_n").alias("n")), "r", "n")
    of_paths = _strength(paths.select((F.col("good") / F.col("n")).alias("r"), "n"), "r", "n")
    site_hosts = hosts.withColumnRenamed("host", "of_host")
    sites = stage(
        paths.join(site_hosts, F.col("host").eqNullSafe(F.col("of_host")))
        .select("of_host", F.col("path").alias("of_path"), F.col("good").alias("path_good"), F.col("n").alias("path_n"), "host_good", "host_n")
    )
    # Broadcast only if the written table is small enough by its size.
    joined = _with_evidence(rows, model).join(
        sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left"
    )

    def shrunk(total: str, n: str, strength: float, toward: Column) -> Column:
        """Rate of a site without the document, drawn toward the rate above it."""
        rate = (F.col(total) - good + strength * toward) / (F.col(n) - 1 + strength)
        return F.greatest(F.least(rate, F.lit(1 - 1e-6)), F.lit(1e-6))

    rated = joined.withColumn("host_rate", shrunk("host_good", "host_n", of_hosts, F.lit(overall)))
    rated = rated.withColumn("path_rate", shrunk("path_good", "path_n", of_paths, F.col("host_rate")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_rate")))))
    return rated.select(
        *unpacked(names), "evidence", "host_rate", "path_rate",
        score.alias("quality_score"), (score >= least).alias("quality_kept"),
    )
