"""Toxicity as an ordinal severity: a cumulative-link regression on sparse text features.

Grades 0 (clean) to 3.  One weight vector is shared by all thresholds:
P(grade > k) = sigmoid(w . x - theta_k) with theta_0 < theta_1 < theta_2, so the
expected severity is the sum of the three probabilities.

Features are word beginnings of several lengths and whole words, as hashes; a
document's value of a feature is given by three numbers: that it occurs, the
logarithm of how often, and of how often per thousand words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize
from .text import MULTIPLIERS, mix, span_hashes, string_bytes, word_bounds

#: Lengths of word beginnings in bytes; 0 is the whole word.
LENGTHS = (4, 5, 6, 7, 8, 10, 0)
GRADES = 4
#: Bytes of all texts that a model is fitted on.
MAX_BYTES = 64 << 20
#: Thresholds of a model without features: every text has grade 0.
NEVER = np.array([40.0, 41.0, 42.0])
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def word_features(column):
    """``(hashes, text numbers, words per text)``: all features of all words, A-Z in lower case.

    ASCII punctuation at either end of a word is no part of it.
    """
    raw, offsets = string_bytes(column)
    starts, ends, rows = word_bounds(raw, offsets)
    text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    starts, ends = starts.copy(), ends.copy()
    while len(m := np.flatnonzero((starts < ends) & _PUNCTUATION[raw[np.minimum(starts, len(raw) - 1)]])):
        starts[m] += 1
    while len(m := np.flatnonzero((ends > starts) & _PUNCTUATION[raw[np.maximum(ends - 1, 0)]])):
        ends[m] -= 1
    full = np.flatnonzero(ends > starts)
    starts, ends, text = starts[full], ends[full], text[full]
    hashes, texts = [], []
    for n in LENGTHS:
        has = slice(None) if n == 0 else np.flatnonzero(ends - starts >= n)
        s = starts[has]
        hashes.append(mix(span_hashes(raw, s, ends[has] if n == 0 else s + n) + MULTIPLIERS[n]))
        texts.append(text[has])
    return np.concatenate(hashes), np.concatenate(texts), np.diff(rows)


class Model:
    """Chosen features (sorted hashes), three weights each, and the thresholds."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, theta: np.ndarray):
        self.keys, self.weights, self.theta = keys, weights, theta
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def design(self, column):
        """Entries ``(text, column, value)`` of the sparse design matrix."""
        hashes, texts, sizes = word_features(column)
        near = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        hashes, texts = hashes[near], texts[near]
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == hashes if len(self.keys) else np.zeros(len(at), bool)
        cell, counts = np.unique(texts[hit] * len(self.keys) + at[hit], return_counts=True)
        text, key = cell // max(len(self.keys), 1), cell % max(len(self.keys), 1)
        rate = 1000 * counts / np.maximum(sizes[text], 1)
        values = [np.ones(len(counts)), np.log(counts), np.log1p(rate)]
        return np.tile(text, 3), np.concatenate([key + i * len(self.keys) for i in range(3)]), np.concatenate(values)

    def over(self, column) -> np.ndarray:
        """P(grade > k) for each text and k."""
        text, key, value = self.design(column)
        score = np.bincount(text, weights=self.weights[key] * value, minlength=len(column))
        return _sigmoid(score[:, None] - self.theta)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(text, key, value, grades: np.ndarray, n_columns: int, *, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of least penalised negative log-likelihood.

    Weights are not negative: the features were chosen as signs of toxicity, and a long
    text must not be cleared by what else it holds.  Projected accelerated gradient
    (Nesterov) with a diagonal scaling.  The thresholds are a
    first one and the logarithms of the steps between them, so they stay ordered.
    """
    n, k = len(grades), GRADES - 1
    weights, base, gaps = np.zeros(n_columns), 2.0, np.full(k - 1, 0.0)
    p = np.concatenate([weights, [base], gaps])
    scale = np.concatenate([0.25 * np.bincount(key, weights=value * value, minlength=n_columns) / n * 4 + l2 + 1e-3, [1.0], np.full(k - 1, 1.0)])
    q, previous, momentum = p.copy(), p.copy(), 1.0
    for _ in range(steps):
        w, theta = q[:n_columns], q[n_columns] + np.concatenate([[0.0], np.cumsum(np.exp(q[n_columns + 1 :]))])
        score = np.bincount(text, weights=w[key] * value, minlength=n)
        over = _sigmoid(score[:, None] - theta)
        edges = np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), over * (1 - over), np.zeros((n, 1))], axis=1)
        row = np.arange(n)
        prob = np.maximum(edges[row, grades] - edges[row, grades + 1], 1e-12)
        d_score = -(slope[row, grades] - slope[row, grades + 1]) / prob / n
        d_theta = np.zeros(k + 2)
        np.add.at(d_theta, grades, slope[row, grades] / prob / n)
        np.add.at(d_theta, grades + 1, -slope[row, grades + 1] / prob / n)
        d_theta = d_theta[1 : k + 1]
        grad = np.bincount(key, weights=d_score[text] * value, minlength=n_columns) + l2 * w
        steps_up = np.exp(q[n_columns + 1 :])
        d_gaps = steps_up * np.cumsum(d_theta[::-1])[::-1][1:]
        g = np.concatenate([grad, [d_theta.sum()], d_gaps])
        p = q - g / scale / 4
        p[:n_columns] = np.maximum(p[:n_columns], 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        q = p + (momentum - 1) / following * (p - previous)
        previous, momentum = p, following
    return p[:n_columns], p[n_columns] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_columns + 1 :]))])


def grade_documents(toxic: np.ndarray, cue_rate: np.ndarray) -> np.ndarray:
    """Severity grades of labelled texts: 0 if not toxic, else 1 to 3 by thirds of the
    rate of cue words among the toxic ones."""
    grades = np.zeros(len(toxic), np.int64)
    if toxic.any():
        cuts = np.quantile(cue_rate[toxic], [1 / 3, 2 / 3])
        grades[toxic] = 1 + np.searchsorted(cuts, cue_rate[toxic], side="left")
    return grades


def train(texts: pa.ChunkedArray | pa.Array, toxic: np.ndarray, *, max_features: int, least_ratio: float = 4.0, min_docs: int = 5, l2: float = 1e-4, steps: int = 400, batch: int = 400) -> Model:
    """Chooses features, grades the toxic texts, and fits the regression.

    Features are kept by their chi-squared statistic against the label, if
    ``min_docs`` toxic texts have them and their share of toxic texts is ``least_ratio``
    times that of others; cue features for grading are those that are
    eight times as frequent in toxic texts as in others.  Where no feature is kept, nothing tells
    texts apart, and the model has every text at grade 0.
    """
    toxic = np.asarray(toxic, bool)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())

    def pairs(lo):
        hashes, text, sizes = word_features(texts.slice(lo, batch))
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        return hashes[fresh], text[fresh] + lo

    spans = range(0, len(texts), batch)
    none = np.empty(0, np.uint64)
    held = [h[toxic[t]] for h, t in map(pairs, spans)]
    keys, in_toxic = np.unique(np.concatenate([none, *held]), return_counts=True)
    keys, in_toxic = keys[in_toxic >= min_docs], in_toxic[in_toxic >= min_docs].astype(float)
    in_clean = np.zeros(len(keys))
    if len(keys):
        for h, t in map(pairs, spans):
            h = h[~toxic[t]]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            in_clean += np.bincount(at[keys[at] == h], minlength=len(keys))
    share = (in_toxic + in_clean) / max(n1 + n0, 1)
    chi = (in_toxic - n1 * share) ** 2 / np.maximum(share * (1 - share) * n1 * max(n0, 1) / max(n1 + n0, 1), 1e-9)
    more = in_toxic * max(n0, 1) > least_ratio * (in_clean + 0.5) * max(n1, 1)
    ranked = np.lexsort((keys, -np.where(more, chi, 0)))
    chosen = np.sort(ranked[more[ranked]][:max_features])
    cue = in_toxic[chosen] * max(n0, 1) >= 8 * (in_clean[chosen] + 0.5) * max(n1, 1)
    model = Model(keys[chosen], np.zeros(3 * len(chosen)), NEVER)
    entries, rates = [], np.zeros(len(texts))
    for lo in spans:
        part = texts.slice(lo, batch)
        text, key, value = model.design(part)
        first = key < len(chosen)
        third = len(text) // 3
        per_mille = np.expm1(value[2 * third :])
        rates[lo : lo + len(part)] = np.bincount(text[first], weights=per_mille * cue[key[first]], minlength=len(part))
        entries.append((text + lo, key, value))
    text, key, value = (np.concatenate([e[i] for e in entries]) if entries else np.empty(0, np.int64) for i in range(3))
    grades = grade_documents(toxic, rates)
    if len(texts) and len(chosen):
        model.weights, model.theta = fit_ordinal(text, key, value, grades, 3 * len(chosen), l2=l2, steps=steps)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int, seed: int, id_col: str, text_col: str, label_col: str, max_bytes: int = MAX_BYTES) -> pa.Table:
    """At most ``max_docs`` labelled texts of at most ``max_bytes`` together, drawn by a seeded hash of the id.

    Sizes are looked at first, and only then are texts of the documents that fit brought together.  A text of more than a hundredth of
    ``max_bytes`` is passed over.  The ids drawn are at most ``max_docs`` numbers, so they are broadcast.
    """
    drawn = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    drawn = drawn.orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))
    order = [F.xxhash64(F.lit(seed), "i"), "i", "h"]
    sizes = rows.select("i", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n")).join(F.broadcast(drawn), "i")
    # A repeated id must not lift the bound.
    sizes = sizes.where(F.col("n") <= max_bytes // 100).orderBy(*order).limit(max_docs)
    total = F.sum("n").over(Window.orderBy(*order, "n").rowsBetween(Window.unboundedPreceding, 0))
    picked = sizes.withColumn("total", total).where(F.col("total") <= max_bytes).groupBy("i", "h", "y").agg(F.count(F.lit(1)).alias("times"))
    picked = materialize(picked, "drawn")
    found = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["i", "h"])
    at = F.row_number().over(Window.partitionBy("i", "h").orderBy("text"))
    return found.withColumn("at", at).where(F.col("at") <= F.col("times")).orderBy(*order).select("text", "y").toArrow()


def score_toxicity(docs: DataFrame, model: Model, *, toxic_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, expected_severity, p_toxic, grade, toxic)`` for every row of ``docs``.

    ``grade`` is the most that is as likely as not exceeded or met; ``toxic`` is a
    probability of ``toxic_at`` or more for grade 1 and above.  A null or empty text has no features and is scored as such.  Null and repeated
    ids are kept, a row each; very long texts are scored whole, a table without rows gives none, other columns are not
    looked at; nothing is shuffled.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                over = model.over(part.column(1))
                grade = (over >= 0.5).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(grade.astype(np.int32)), pa.array(over[:, 0] >= toxic_at)], names=["id", "expected_severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)
