"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

Severity grades are given from outside, as whole numbers from 0. The query takes them from both given labels: 0 for
good documents, 1 for those of bad quality, TOXIC for toxic ones. All thresholds share one weight vector:
P(grade > k) = sigmoid(score - threshold[k]), thresholds ascending. A feature is used if it tells apart the grades on
the two sides of any threshold: words for toxic documents, runs of symbols and words that follow themselves for bad
ones. A document's expected severity is the sum of these probabilities, and it is rejected where P(grade >= TOXIC) by
its words alone, without the marks of its form, reaches the cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossgraph.llm.common import cut, small_batches
from glossgraph.llm.simhash import WIDE_WORDS, shingle_hashes

#: Labelled documents that the model is fitted on, at most; they are chosen by a hash of their id.
SAMPLE = 12_000
PREFIXES = (4, 5, 6, 7)
#: Passes of the fit over the sampled rows.
STEPS = 400
CUT = 0.25
#: The grade from which on a document is toxic.
TOXIC = 2
#: Log-likelihood ratio statistic that a feature must reach: about one chance in 200,000.
LEAST_GAIN = 24.0
#: Everything that isn't part of an ASCII word ends it; bytes of other letters are kept.
_SEPARATORS = bytes(x for x in range(128) if not (chr(x).isalnum() or chr(x) == "'"))
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
#: Symbols, each after itself, and each between spaces.
_SYMBOLS = [bytes([x]) for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".'-"]
_DOUBLED, _ALONE = [x * 2 for x in _SYMBOLS], [b" " + x + b" " for x in _SYMBOLS]
_SPACED = bytes.maketrans(b"\t\n\r", b"   ")


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by word and the ascending thresholds between grades."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]


def features(text: str | None) -> set[bytes]:
    """The distinct lower-case words of a whole text, their prefixes with a star, and marks of its form; empty for null.

    Prefixes let inflected forms of a word share a weight; they are cut by bytes, whatever the letters. Marks are symbols
    that follow themselves, ALONE for one between spaces, CAPITALS for three such words in a row, and AGAIN for a word that
    follows itself; they begin with a space, which no word has.
    """
    raw = (text or "").encode()
    words = (text or "").lower().encode().translate(_TABLE).split()
    distinct = set(words)
    found = set(distinct)
    for n in PREFIXES:
        found |= {w[:n] + b"*" for w in distinct if len(w) > n}
    found |= {b" " + m[:1] for m in _DOUBLED if m in raw}
    spaced = raw.translate(_SPACED)
    if any(m in spaced for m in _ALONE):
        found.add(b" ALONE")
    if b"\1\1\1" in bytes(map(bytes.isupper, raw.translate(_TABLE).split())):
        found.add(b" CAPITALS")
    if any(map(bytes.__eq__, words, words[1:])):
        found.add(b" AGAIN")
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(rows: list[list[int]], grades: np.ndarray, width: int, ridge: float = 1.0, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood; rows have the present features' numbers.

    Gradient ascent with adaptive steps (Adam); thresholds are kept ascending as a first one and
    positive gaps. Grades that no row has leave their threshold where the penalty puts it.
    """
    top = int(max(grades.max(initial=0), 1))
    lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows)), lengths)
    theta = np.concatenate([np.zeros(width), [2.0], np.zeros(top - 1)])  # weights, first threshold, log gaps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(len(rows), 1)
    for step in range(1, steps + 1):
        w, gaps = theta[:width], np.exp(theta[width + 1 :])
        cuts = np.concatenate([[theta[width]], theta[width] + np.cumsum(gaps)])
        score = np.bincount(owner, weights=w[flat], minlength=len(rows))
        upper = np.concatenate([cuts, [np.inf]])[grades]  # P(grade) = S(upper - score) - S(lower - score)
        lower = np.concatenate([[-np.inf], cuts])[grades]
        su, sl = np.where(np.isinf(upper), 1.0, _sigmoid(upper - score)), np.where(np.isinf(lower), 0.0, _sigmoid(lower - score))
        p = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su) / p, sl * (1 - sl) / p
        g_score = dl - du
        g_cuts = np.bincount(np.minimum(grades, top - 1), weights=np.where(grades < top, du, 0), minlength=top) - np.bincount(np.maximum(grades - 1, 0), weights=np.where(grades > 0, dl, 0), minlength=top)
        g_w = np.bincount(flat, weights=g_score[owner], minlength=width) - ridge * w
        after = np.cumsum(g_cuts[::-1])[::-1]
        grad = np.concatenate([g_w, [after[0]], after[1:] * gaps - 0.1 * theta[width + 1 :]]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    gaps = np.exp(theta[width + 1 :])
    return theta[:width], np.concatenate([[theta[width]], theta[width] + np.cumsum(gaps)])


def given_grade() -> Column:
    """Grade by the labels `toxic` and `quality`; null without a label of toxicity."""
    return F.when(F.col("toxic") > 0, TOXIC).when(F.col("toxic").isNotNull(), F.when(F.col("quality") == 0, 1).otherwise(0))


def _least_shingle(text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([min(shingle_hashes(x, WIDE_WORDS), default=0) for x in texts.to_pylist()], dtype=np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(of, "long").asNondeterministic()(text)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grade: str = "grade") -> OrdinalModel:
    """Fit on at most `sample` graded documents (columns doc_id, text; doc_id, grade), chosen by a hash of the id.

    Spark counts the features of the sample's whole texts; the driver gets all telling ones, and for each sampled
    document the numbers of those that it has, so both are bounded by the sample. Null texts count as empty, null
    grades are left out, copies and near copies of one grade count once. Without graded rows, or with toxic ones or others
    alone, the model has no weights and rejects nothing.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("labelled"), F.greatest(F.col(grade).cast("int"), F.lit(0)).alias("grade"))
        .orderBy(F.xxhash64("labelled"), "labelled", "grade")
        .limit(sample)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # at most `sample` rows of two numbers
    # near copies would make their own words look telling: of those that share the least hash of a shingle one stays
    graded = joined.select("labelled", "grade", "text", _least_shingle(F.col("text")).alias("least"))
    alone = graded.groupBy("least", "grade").agg(F.min_by("text", F.struct(F.xxhash64("labelled"), "labelled", "text")).alias("text"))
    sampled = cut(alone.select("grade", "text"))
    sizes = {r.grade: r["count"] for r in sampled.groupBy("grade").count().collect()}  # as many rows as there are grades
    if not (any(g >= TOXIC for g in sizes) and any(g < TOXIC for g in sizes)):
        return OrdinalModel({}, (math.inf,) * TOXIC)
    telling = [bytes(r.feature) for r in _telling(sampled, sizes).collect()]
    number = {w: k for k, w in enumerate(telling)}

    def find(batches):
        for batch in batches:
            found = [sorted(number[w] for w in number.keys() & features(x)) for x in batch["text"].to_pylist()]
            yield pa.record_batch([batch["grade"], pa.array(found, pa.list_(pa.int32()))], ["grade", "found"])

    rows = sampled.mapInArrow(find, "grade int, found array<int>").collect()
    # in one order, whichever task came first
    rows.sort(key=lambda r: (r.found, r.grade))
    weights, thresholds = fit_cumulative_link([r.found for r in rows], np.array([r.grade for r in rows], dtype=np.int64), len(telling))
    return OrdinalModel({w: float(weights[k]) for w, k in number.items()}, tuple(float(x) for x in thresholds))


def _telling(sampled: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Features that stand above some threshold between grades more often than chance allows, the most telling first."""
    grades = sorted(sizes)

    def count(batches):
        for batch in batches:
            counts: dict[bytes, list[int]] = {}
            for text, grade in zip(batch["text"].to_pylist(), batch["grade"].to_pylist(), strict=True):
                for feature in features(text):
                    counts.setdefault(feature, [0] * len(grades))[grades.index(grade)] += 1
            yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.list_(pa.int64()))], ["feature", "counts"])

    each = [F.sum(F.get("counts", F.lit(k))).alias(f"g{k}") for k in range(len(grades))]
    sums = sampled.mapInArrow(count, "feature binary, counts array<long>").groupBy("feature").agg(*each)
    n = sum((F.col(f"g{k}") for k in range(len(grades))), F.lit(0))

    def gain(k: int) -> Column:
        """Log-likelihood ratio of the feature above threshold k; 0 if it is no more frequent there."""
        bad = sum((F.col(f"g{j}") for j in range(k, len(grades))), F.lit(0))
        good, share = n - bad, sum(sizes[g] for g in grades[k:]) / sum(sizes.values())
        ratio = 2 * (bad * F.log(bad / (n * share)) + F.when(good > 0, good * F.log(good / (n * (1 - share)))).otherwise(0.0))
        return F.when((bad > 0) & (bad > n * share), ratio).otherwise(0.0)

    best = F.greatest(*(gain(k) for k in range(1, len(grades))), F.lit(0.0))
    return sums.withColumn("gain", best).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "feature").select("feature")


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", cut: float = CUT) -> DataFrame:
    """Add `toxicity`: a struct of severity (expected grade), p_toxic (by words alone), grade (the likeliest) and rejected.

    Whole texts are read; null and empty ones have no features and get the model's floor. Of grades that are equally
    likely the lowest is taken. Rows stay as they are, repeated ones too; a column named `toxicity` is replaced.
    """
    small_batches(docs.sparkSession)
    weights, thresholds = model.weights, np.array(model.thresholds)

    def of(texts: pa.Array) -> pa.Array:
        found = [weights.keys() & features(x) for x in texts.to_pylist()]
        totals = np.array([sum(map(weights.__getitem__, x)) for x in found], dtype=float)
        worded = np.array([sum(weights[f] for f in x if not f.startswith(b" ")) for x in found], dtype=float)
        above = _sigmoid(totals[:, None] - thresholds[None, :])
        above[:, np.isinf(thresholds)] = 0.0
        each = np.hstack([np.ones((len(totals), 1)), above]) - np.hstack([above, np.zeros((len(totals), 1))])
        toxic = np.where(np.isinf(thresholds[TOXIC - 1]), 0.0, _sigmoid(worded - thresholds[TOXIC - 1]))  # a bad form alone isn't toxic
        columns = [above.sum(axis=1), toxic, each.argmax(axis=1).astype(np.int32), toxic >= cut]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["severity", "p_toxic", "grade", "rejected"])

    kind = "struct<severity:double,p_toxic:double,grade:int,rejected:boolean>"
    return docs.withColumn("toxicity", F.arrow_udf(of, kind).asNondeterministic()(F.col(text)))
