"""Toxicity as ordered severity grades: cumulative-link (proportional odds) regression on sparse text features.

P(grade >= j) = sigmoid(w . x - t_j) with one weight vector for all thresholds t_1 <= t_2 <= ... . The labels only
say toxic or not, so the grades above zero come from the data: a first fit of the single threshold orders the toxic
training rows by margin, and their terciles are grades 1, 2 and 3 of the second fit.

Features are words and word beginnings of 4 to 7 letters (compound vocabularies share beginnings), valued
log(1 + min(count, 8)). The model is fitted on a bounded sample of labelled rows; everything else covers whole texts
of all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.store import cut, free_names

#: Bounds of the training sample (labelled rows with the smallest hash of their id) and of the fitted vocabulary.
TRAIN_ROWS = 8000
FEATURES = 4096
#: A feature has to occur in so many sampled documents, and to speak for a class by so many standard deviations.
LEAST_DOCS = 4
LEAST_Z = 4.0
GRADES = 3
BEGINNINGS = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")
#: Characters of a text that are taken apart at a time, so that a very long one needs little memory beside itself.
PIECE = 1 << 16


def words_of(text: str | None) -> Iterator[list[str]]:
    """The lower-cased words of a text, in lists of bounded size."""
    at, end = 0, len(text or "")
    while at < end:
        stop = min(end, at + PIECE)
        # no word is cut in two
        while stop < end and _WORD.match(text, stop - 1, stop) and _WORD.match(text, stop, stop + 1):
            stop += 1
        yield _WORD.findall(text[at:stop].lower())
        at = stop


def features_of(text: str | None) -> Counter:
    """Counts of words, and of word beginnings (written with a trailing ``*``)."""
    words: Counter = Counter()
    for part in words_of(text):
        words.update(part)
    out: Counter = Counter(words)
    for word, n in words.items():
        for k in BEGINNINGS:
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


@dataclass
class OrdinalModel:
    """Weights of the features and the ordered thresholds; no thresholds means that nothing was learned."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def margin(self, counts: Counter) -> float:
        return sum(self.weights[f] * math.log1p(min(n, 8)) for f, n in counts.items() if f in self.weights)

    def above(self, margin: float) -> list[float]:
        """P(grade >= j) for j = 1, 2, ..."""
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - margin)))) for t in self.thresholds]


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, l2: float = 0.2, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Maximum penalised likelihood by Adam, on a sparse matrix given as triples; grades are 0 .. K. -> weights, thresholds."""
    n, k = len(grades), int(grades.max())
    share = np.array([(grades >= j).mean() for j in range(1, k + 1)])
    start = np.log((1 - share) / share)
    # thresholds as a first one and positive steps, kept in log scale
    params = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, first, gaps = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        t = np.concatenate([[first], first + np.cumsum(gaps)])
        margin = np.bincount(rows, weights=values * w[cols], minlength=n)
        # P(Y >= j) with 1 in front and 0 behind; the probability of a grade is the difference of neighbours
        upper = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(t[None, :] - margin[:, None], -50, 50))), np.zeros((n, 1))])
        at = np.arange(n)
        p_lo, p_hi = upper[at, grades], upper[at, grades + 1]
        prob = np.maximum(p_lo - p_hi, 1e-12)
        d_lo, d_hi = p_lo * (1 - p_lo), p_hi * (1 - p_hi)
        g_margin = -(d_lo - d_hi) / prob
        grad = np.zeros_like(params)
        grad[:n_features] = np.bincount(cols, weights=values * g_margin[rows], minlength=n_features) + l2 * w
        g_t = np.zeros(k + 2)
        np.add.at(g_t, grades, d_lo / prob)
        np.add.at(g_t, grades + 1, -d_hi / prob)
        g_t = g_t[1 : k + 1]
        grad[n_features] = g_t.sum()
        for j in range(k - 1):
            grad[n_features + 1 + j] = g_t[j + 1 :].sum() * gaps[j]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    first, gaps = params[n_features], np.exp(params[n_features + 1 :])
    return params[:n_features], np.concatenate([[first], first + np.cumsum(gaps)])


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``bound`` rows, one for each labelled id.

    Several labels of one id: the largest; several texts: the first in order; null labels and texts: none.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text is not null")
    return some.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on the bounded sample. Without rows of both classes, or without a telling feature, an empty model."""
    sample = cut(training_rows(docs, labels, bound), "toxicity-sample")
    n_pos, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < n_pos < n:
        return OrdinalModel()

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                (pos if toxic.as_py() else neg).update(features_of(text.as_py()).keys())
        names = list(pos.keys() | neg.keys())
        for a in range(0, len(names), 1 << 16):
            part = names[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([pos[f] for f in part], pa.int64()), pa.array([neg[f] for f in part], pa.int64())], ["feature", "pos", "neg"])

    share = n_pos / n
    df = F.col("pos") + F.col("neg")
    z = F.abs(F.col("pos") - df * share) / F.sqrt(df * share * (1 - share))
    counts = sample.select("text", "toxic").mapInArrow(document_counts, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    chosen = counts.where(df >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(FEATURES)
    vocabulary = {r.feature: i for i, r in enumerate(chosen.collect())}
    if not vocabulary:
        return OrdinalModel()

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hits = [sorted((vocabulary[f], math.log1p(min(c, 8))) for f, c in features_of(t).items() if f in vocabulary) for t in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id, "toxic": frame.toxic, "at": [[i for i, _ in h] for h in hits], "value": [[x for _, x in h] for h in hits]})

    got = sample.mapInPandas(vectors, "doc_id long, toxic int, at array<int>, value array<double>").toPandas().sort_values("doc_id", kind="stable")
    rows = np.repeat(np.arange(len(got)), [len(a) for a in got["at"]])
    cols = np.concatenate([np.asarray(a, int) for a in got["at"]])
    values = np.concatenate([np.asarray(a, float) for a in got["value"]])
    toxic = got.toxic.to_numpy().astype(int)
    w, _ = fit_cumulative_link(rows, cols, values, toxic, len(vocabulary))
    margin = np.bincount(rows, weights=values * w[cols], minlength=len(got))
    cuts = np.quantile(margin[toxic == 1], [i / GRADES for i in range(1, GRADES)])
    grades = np.where(toxic == 1, 1 + np.searchsorted(np.unique(cuts), margin, side="left"), 0)
    w, t = fit_cumulative_link(rows, cols, values, grades, len(vocabulary))
    return OrdinalModel({f: float(w[i]) for f, i in vocabulary.items()}, [float(x) for x in t])


def grader(spark: SparkSession, model: OrdinalModel):
    """The model as an Arrow function of a text column: ``expected_severity``, ``grade``, ``toxic``."""
    known = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_severity:double,grade:int,toxic:boolean>")
    def grade(texts: pa.Array) -> pa.Array:
        own = known.value
        # contribution of a word's features that the model knows; few distinct words have any
        memo: dict[str, tuple[str, ...]] = {}
        out = []
        for t in texts:
            counts: Counter = Counter()
            for part in words_of(t.as_py()) if own.thresholds else ():
                for word in part:
                    hit = memo.get(word)
                    if hit is None:
                        hit = tuple(f for f in (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)) if f in own.weights)
                        if len(memo) < 500_000:
                            memo[word] = hit
                    for f in hit:
                        counts[f] += 1
            above = own.above(own.margin(counts)) if counts else []
            probs = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
            out.append({"expected_severity": float(sum(above)), "grade": probs.index(max(probs)), "toxic": bool(above and above[0] >= 0.5)})
        return pa.array(out, pa.struct([("expected_severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())]))

    return grade


def severity(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_severity`` (sum of P(grade >= j)), ``grade`` (the most probable) and ``toxic`` (P(grade >= 1) >= 0.5).

    Null and empty texts and texts without a known feature get severity 0, grade 0, not toxic; so do all rows under
    an empty model. Columns of these names are replaced, others pass unchanged whatever their names; rows are
    independent, repeated ones get equal values, an empty table stays empty. Very long texts are taken apart in pieces.
    """
    grade = grader(docs.sparkSession, model)
    (graded,) = free_names(docs, "graded")
    new = ("expected_severity", "grade", "toxic")
    rows = docs.withColumn(graded, grade(F.col(text)))
    return rows.select(*[c for c in docs.columns if c.lower() not in new], *[F.col(graded)[c].alias(c) for c in new])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the fitted model calls toxic; columns unchanged, whatever their names.

    The model is fitted on the rows that ``labels`` has. Null and empty texts stay, and so does every row where nothing
    is labelled; repeated rows go or stay together, an empty table stays empty.
    """
    (verdict,) = free_names(docs, "verdict")
    model = fit(docs, labels)
    judged = docs.withColumn(verdict, grader(docs.sparkSession, model)(F.col("text")))
    return judged.where(~F.col(verdict)["toxic"]).select(docs.columns)
